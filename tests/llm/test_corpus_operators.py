"""Operators across texts, against plain Python or SQL, on the odd rows and on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from noisemix.llm import contextmixing, decontamination, jaccard, topk
from noisemix.llm.components import components
from noisemix.sources.checkpoints import shared_folder


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


# --- n-gram Jaccard join


def plain_set(text):
    words = (text or "").encode().lower().split()
    n = min(3, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def plain_groups(rows, percent=90):
    sets = [plain_set(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[root(i)].append(i)
    out = [None] * len(rows)
    for group in members.values():
        ids = [rows[i][0] for i in group if rows[i][0] is not None]
        for i in group:
            out[i] = (rows[i][0], len(sets[i]), min(ids, default=None) if sets[i] else rows[i][0])
    return out


def near_copies(seed, families=6, size=14):
    """Families in which neighbours differ by a word or a few, so that links form chains."""
    rng = random.Random(seed)
    rows = []
    for f in range(families):
        words = [str(rng.randrange(10_000)) for _ in range(rng.choice([8, 25, 60, 200]))]
        for _ in range(size):
            rows.append((rng.randrange(10**6), " ".join(words)))
            if rng.random() < 0.7:
                words = list(words)
                for _ in range(rng.choice([1, 1, 2])):
                    words[rng.randrange(len(words))] = f"n{rng.randrange(10_000)}"
    rng.shuffle(rows)
    return rows


def test_jaccard_of_odd_rows(odd_docs, odd_rows, no_docs):
    assert rows_of(jaccard.join_documents(odd_docs)) == Counter(plain_groups(odd_rows))
    assert jaccard.join_documents(no_docs).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_of_chains(spark, seed):
    rows = near_copies(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert rows_of(jaccard.join_documents(docs)) == Counter(plain_groups(rows))


def test_jaccard_of_a_family_around_one_text(spark):
    """Copies with edits of their own, so that most don't link and many share a signature."""
    rng = random.Random(7)
    base = [str(rng.randrange(10_000)) for _ in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6, 9])):
            words[rng.randrange(len(words))] = rng.choice(["x", "y", f"n{rng.randrange(900)}"])
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rows_of(jaccard.join_documents(docs)) == Counter(plain_groups(rows))


def test_linked_sets_share_a_signature():
    rng = random.Random(9)
    for _ in range(400):
        n = rng.choice([1, 2, 5, 9, 10, 11, 19, 20, 21, 40, 100, 400])
        s = {rng.getrandbits(64) for _ in range(n)}
        t = set(s)
        for _ in range(rng.randint(0, max(1, n // 10))):
            if rng.random() < 0.5 and len(t) > 1:
                t.remove(next(iter(t)))
            else:
                t.add(rng.getrandbits(64))
        if 100 * len(s & t) >= 90 * len(s | t):
            a, b = (jaccard.signatures(np.array(sorted(x), np.uint64)) for x in (s, t))
            assert set(a.tolist()) & set(b.tolist())


def test_one_of_each_group_stays(odd_docs, odd_rows):
    kept = jaccard.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    seen, expected = set(), Counter()
    order = sorted(range(len(odd_rows)), key=lambda i: (odd_rows[i][0] is None, odd_rows[i][0] or 0))
    groups = plain_groups(odd_rows)
    sets = [frozenset(plain_set(r[1])) for r in odd_rows]
    for i in order:
        mark = groups[i][2] if groups[i][2] is not None else sets[i]
        mark = (mark, sets[i]) if odd_rows[i][0] == 4 else mark  # two texts of one id in different groups
        if not sets[i] or mark not in seen:
            expected[odd_rows[i][:2]] += 1
            seen.add(mark)
    assert got == expected


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101 + i) for i in range(30)] + [(200, 200), (301, 300)]
    out = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(51)} | {100 + i: 100 for i in range(31)} | {300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- decontamination


def plain_words(text):
    folded = (text or "").encode().lower().decode()
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def plain_report(text, items):
    words, hit, found = plain_words(text), set(), set()
    for item, item_text in items:
        w = plain_words(item_text)
        m = min(13, len(w))
        windows = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if w else set()
        for i in range(len(words) - m + 1):
            if m and tuple(words[i : i + m]) in windows:
                hit.update(range(i, i + m))
                found.add(item)
    named = sorted(str(i) for i in found if i is not None)
    return (
        len(words),
        len(hit),
        len(named),
        hashlib.sha256(",".join(named).encode()).hexdigest(),
        bool(hit) and 20 * len(hit) >= len(words),
    )


@pytest.fixture(scope="module")
def bench_rows(odd_rows):
    words = {r[0]: (r[1] or "").split() for r in odd_rows}
    return [
        (1, " ".join(words[1][5:40])),
        (2, " ".join(words[1][5:18])),
        (10, " ".join(words[11][100:160]).upper()),
        (10, " ".join(words[11][3000:3030])),
        (3, "nothing of this is in any of the texts so it has no hits at all"),
        (4, "éa SS straße"),
        (5, "ÉCOLE"),
        (5, "éa ß straße école"),
        (None, "one... TWO"),
        (6, None),
        (7, "?!"),
        (8, "3"),
        (9, " ".join(words[11][-12:]) + " tail"),
        (3, "nothing of this is in any of the texts so it has no hits at all"),
    ]


def test_decontamination_of_odd_rows(spark, odd_docs, odd_rows, no_docs, bench_rows):
    bench = spark.createDataFrame([(*r, 0, "k") for r in bench_rows], "item_id long, text string, start int, key string")
    expected = Counter((r[0], *plain_report(r[1], bench_rows)) for r in odd_rows)
    assert rows_of(decontamination.report(odd_docs, bench)) == expected
    assert decontamination.report(no_docs, bench).count() == 0
    clean = rows_of(decontamination.report(odd_docs, bench.where("false")))
    assert clean == Counter((r[0], *plain_report(r[1], [])) for r in odd_rows)
    kept = decontamination.drop_contaminated(odd_docs, bench)
    assert kept.columns == odd_docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter(
        r[:2] for r in odd_rows if not plain_report(r[1], bench_rows)[-1]
    )


def test_windows_in_repetitive_texts(spark):
    """Few different words, so that hashes repeat and windows overlap."""
    rng = random.Random(4)
    items = [(i, " ".join(rng.choices("ab", k=rng.choice([13, 14, 20, 3, 7])))) for i in range(8)]
    rows = [(i, " ".join(rng.choices("ab", k=rng.choice([0, 5, 13, 40, 90])))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(decontamination.report(docs, spark.createDataFrame(items, "item_id long, text string")))
    assert got == Counter((i, *plain_report(t, items)) for i, t in rows)


def test_decontamination_without_broadcasts_and_with_a_full_bit_array(spark, monkeypatch, odd_docs, odd_rows, bench_rows):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(decontamination, "BIT_WORDS", 64)
    monkeypatch.setattr(decontamination._Windows, "maybe", lambda self, mark: F.lit(True))
    bench = spark.createDataFrame(bench_rows, "item_id long, text string")
    expected = Counter((r[0], *plain_report(r[1], bench_rows)) for r in odd_rows)
    assert rows_of(decontamination.report(odd_docs, bench)) == expected


# --- top-k search


def plain_top(rows, every, k=5):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            q = [int(np.floor(256 * float(x))) for x in v]
            good[i] = min(good.get(i, q), q)
    out = Counter()
    for i, q in good.items():
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good.items() if j != i)
            for rank, (s, j) in enumerate(scores[:k], 1):
                out[i, rank, j, -s] += 1
    return out


@pytest.mark.parametrize("kind", ["spread", "ties", "few"])
def test_top_k(spark, monkeypatch, kind):
    monkeypatch.setattr(topk, "ANNULUS", 20)
    monkeypatch.setattr(topk, "CELL", 30)
    monkeypatch.setattr(topk, "FIRST_LOOK", 10)
    rng = np.random.default_rng(3)
    n = 4 if kind == "few" else 600
    values = rng.normal(0, 1, (n, 6)).astype(np.float32)
    if kind == "ties":
        values = np.round(values[rng.integers(0, 12, n)])
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(values)]
    rows += [(900, None), (901, [1.0, None]), (902, [float("nan"), 1.0]), (903, [float("inf")] * 6), (None, [1.0] * 6)]
    rows += [(904, [0.5, 0.5]), (905, []), rows[0], (1, [9.0] * 6)]
    table = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    got = topk.top_k(table, F.col("vec_id") % 20 == 0, pivots=8)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert rows_of(got) == plain_top(rows, 20)


def test_top_k_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(empty, F.lit(True)).count() == 0
    alone = spark.createDataFrame([(0, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(alone, F.lit(True)).count() == 0


def test_top_k_of_large_integers(spark):
    rows = [(i, [1e6 * (i - 3), 2e6 + i]) for i in range(10)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert rows_of(topk.top_k(table, F.col("vec_id") % 2 == 0)) == plain_top(rows, 2)


def test_search_visits_fewer_cells_where_vectors_form_clusters(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 5, (8, 4))
    rows = [(i, [float(x) for x in centres[i % 8] + rng.normal(0, 0.01, 4)]) for i in range(800)]
    vectors = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    index, placed = topk._build(vectors, 16)
    queries = vectors.where("vec_id < 8").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    kth = queries.withColumn("kth", F.aggregate("q", F.lit(0.0), lambda a, x: a + x * x) * 0.99)
    visited = topk._visits(index, kth, True).count()
    assert visited < 0.5 * 8 * index.cells[index.rows > 0].sum() and placed.count() == 800


# --- LM scoring


@pytest.fixture(scope="module")
def letters(spark):
    """Texts of two classes; words come from few syllables, as in prose."""
    rng = random.Random(12)
    syllables = {"x": ["ka", "to", "mi", "ru"], "y": ["sch", "ung", "ei", "pf"]}
    common = {k: ["".join(rng.choices(v, k=rng.randint(1, 3))) for _ in range(12)] for k, v in syllables.items()}
    rows = []
    for i in range(260):
        lang = rng.choice("xy")
        words = [rng.choice(common[lang]) if rng.random() < 0.7 else "".join(rng.choices(syllables[lang], k=4)) for _ in range(60)]
        rows.append((i, " ".join(words), lang))
    return rows


def test_scores_beat_the_base_on_unseen_texts(spark, letters):
    docs = spark.createDataFrame(letters, "doc_id long, text string, lang string")
    out = contextmixing.score_documents(docs).collect()
    assert len(out) == len(letters)
    held = [r for r in out if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i, *_ in letters if zlib.crc32(str(i).encode()) % 7 == 2} and len(held) > 20
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_scores_follow_the_order_of_words(spark):
    """The same words in the order of the training texts and turned round; letters alone can't tell them apart."""
    rng = random.Random(3)
    steps = {"ab": "cd", "cd": "ef", "ef": "gh", "gh": "ij", "ij": "ab"}
    rows = []
    for i in range(80):
        word, text = rng.choice(list(steps)), []
        for _ in range(40):
            text.append(word)
            word = steps[word]
        rows.append((i, " ".join(text), "x"))
    held = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    rows += [(held[0], " ".join(text), "x"), (held[1], " ".join(reversed(text)), "x")]
    got = {r["doc_id"]: r for r in contextmixing.score_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    forth, back = (got[i] for i in held)
    assert forth["held_out"] and back["held_out"] and forth["base_score"] == pytest.approx(back["base_score"])
    assert forth["score"] > back["score"] + 5


def test_scores_do_not_depend_on_the_cores(spark, monkeypatch):
    """The same table as one partition and as seven, the context saying it has as many cores."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 5))) for _ in range(500)]
    rows = [(i, " ".join(rng.choices(words, k=90)), "x") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = []
    for parts in (1, 7):
        monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", property(lambda self, n=parts: n))
        out = contextmixing.score_documents(docs.repartition(parts)).collect()
        got.append(sorted((r["doc_id"], round(r["score"], 6)) for r in out))
    assert got[0] == got[1]


def test_every_counted_row_is_learned_from():
    """A row that stands for n occurrences moves weights and map as n rows do."""
    words = [b"ab", b"ba ab", b"ab ba"]
    tables = contextmixing.Tables.filled(words, np.zeros(3, int), np.array([2.0, 3, 40]))
    one, many = contextmixing.Mixer(), contextmixing.Mixer()
    one.learn(tables, words, np.zeros(3, int), np.array([2.0, 3, 40]))
    all_ = [w for w, n in zip(words, (2, 3, 40), strict=True) for _ in range(n)]
    many.learn(tables, all_, np.zeros(45, int))
    assert one.used.sum() == many.used.sum() == 45 * 24
    assert np.allclose(one.weights, many.weights) and np.allclose(one.refined, many.refined)


def test_bytes_before_cross_the_space():
    places = {}
    for word in (b"ab cd", b"xy cd", b"cd"):
        places[word] = [[int(x[0]) for x in p] for _, _, _, p, _ in contextmixing.spelled([word], np.zeros(1, int))]
    orders = [k for k, _, _ in contextmixing.CONTEXTS]
    for k, first, other in zip(orders, places[b"ab cd"][0], places[b"xy cd"][0], strict=True):
        assert (first == other) == (k < 2)
    assert len({len(x) for x in places.values()}) == 1


def test_pairs_make_a_probability():
    """Over all texts of two words from a closed list, with what followed what, the scores add up to 1."""
    p = np.log10(np.array([[0.5, 0.2], [0.3, 0.1], [0.2, 0.7]]))
    follows = np.array([[4, 0, 2], [1, 1, 1], [0, 0, 9]])
    total = 0.0
    for a in range(3):
        for b in range(3):
            n = np.array([follows[0, a], follows[a, b]])
            of = np.array([follows[0].sum(), follows[a].sum()])
            total += 10 ** contextmixing.adaptive_score(np.array([a, b]), p[[a, b]], np.array([0.6, 0.4]), n, of)
    assert total == pytest.approx(1)


def plain_base(rows):
    def tokens(text):
        return [*(text or "").encode().lower().split(), b""]

    counts = Counter()
    for r in rows:
        if r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2:
            counts.update(tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    out = Counter()
    for r in rows:
        own = tokens(r[1])
        base = sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        held = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2
        out[r[0], held, len(own), sum(counts[w] > 0 for w in own), n, round(float(base), 6)] += 1
    return out


def test_scores_of_odd_rows(odd_docs, odd_rows, no_docs):
    out = contextmixing.score_documents(odd_docs)
    got = out.collect()
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens"]
    assert Counter((*(r[c] for c in columns), round(r["base_score"], 6)) for r in got) == plain_base(odd_rows)
    assert all(r["score"] < 0 and np.isfinite(r["score"]) for r in got)
    assert contextmixing.score_documents(no_docs).count() == 0


def test_blocks_and_tasks_do_not_change_base_scores(spark, monkeypatch, letters):
    monkeypatch.setattr(contextmixing, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(contextmixing, "TASK_WORDS", 40)
    monkeypatch.setattr(contextmixing, "FAN_IN", 2)
    rows = letters[:60]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = contextmixing.score_documents(docs, class_column="none").collect()
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens"]
    assert Counter((*(r[c] for c in columns), round(r["base_score"], 6)) for r in got) == plain_base(rows)


def test_bits_are_a_probability():
    """The words of up to two letters, each with its end, have at most all the probability."""
    words = [b"ab", b"ba", b"a", b""]
    tables = contextmixing.Tables.filled(words, np.zeros(4, int), np.array([5.0, 2, 3, 1]))
    tables.prepare()
    mixer = contextmixing.Mixer()
    mixer.learn(tables, words * 20, np.zeros(80, int))
    every = [bytes(w) for w in ([], *([x] for x in range(256) if x != 32))]
    p = 10 ** mixer.scores(tables, every, 0)
    assert 0.05 < p.sum() < 1.0001
    assert 10 ** mixer.scores(tables, [b"ab"], 0)[0] > 100 * 10 ** mixer.scores(tables, [b"zq"], 0)[0]


def test_words_of_any_length_are_spelled_whole():
    words = [b"x" * n for n in (0, 1, 62, 63, 64, 65, 127, 128, 129, 1000)] + [b"ab", b"y" * 500_000]
    bits = Counter()
    for lanes, _, bit, _, _ in contextmixing.spelled(words[:-1], np.zeros(len(words), int)):
        for i in lanes:
            bits[int(i)] += 1
    assert all(bits[i] == 8 * (len(w) + 1) for i, w in enumerate(words[:-1]))
    tables = contextmixing.Tables.filled(words, np.zeros(len(words), int), np.ones(len(words)))
    tables.prepare()
    p = contextmixing.Mixer().scores(tables, words, 0)
    assert np.isfinite(p).all() and (p < 0).all() and p[-1] < p[0]


def test_experts_make_a_probability():
    """Over all texts of three words from a closed list the scores add up to 1."""
    p = np.log10(np.array([[0.5, 0.2], [0.3, 0.1], [0.2, 0.7]]))
    prior = np.array([0.6, 0.4])
    total = 0.0
    for a in range(3):
        for b in range(3):
            for c in range(3):
                words = np.array([a, b, c])
                total += 10 ** contextmixing.adaptive_score(words, p[words], prior)
    assert total == pytest.approx(1)


def test_counts_in_a_byte():
    n = np.arange(0, 12, dtype=np.float32)
    packed = contextmixing.Tables([n]).packed()
    assert np.array_equal(contextmixing.Tables.unpacked(packed).counts[0][:9], n[:9])


def test_scoring_writes_less_than_the_texts(spark):
    """What scoring leaves in the shared folder, on texts of which hardly a pair of words comes twice."""
    rng = random.Random(4)
    rows = [(i, " ".join("".join(rng.choices("etaoinsr", k=rng.randint(2, 9))) for _ in range(400)), "x") for i in range(150)]
    folder = Path(urlparse(shared_folder(spark)).path)

    def used():
        return sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())

    before = used()
    out = contextmixing.score_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert out.agg(F.sum("n_tokens")).first()[0] == 150 * 401
    assert used() - before < sum(len(t) for _, t, _ in rows)


def test_words_are_mixed_by_their_hash(spark):
    words = [b"", b"a", b"ab cd", b" abc", "Straße \u00e9".encode(), b"x" * 64, b"y" * 131, *(b"w%d" % i for i in range(50))]
    frame = spark.createDataFrame([(bytearray(w),) for w in words], "w binary")
    assert [r[0] for r in frame.select(F.hash("w")).collect()] == contextmixing._places(words).tolist()


def test_words_in_the_same_contexts_are_spelled_once_with_the_same_result():
    """Counts and scores of pairs against their bits one by one."""
    rng = random.Random(6)
    words = ["".join(rng.choices("abc", k=rng.randint(1, 8))).encode() for _ in range(40)]
    pairs = sorted({rng.choice([*words, b""]) + b" " + rng.choice([*words, b"", b"z" * 150]) for _ in range(300)})
    classes = np.array([rng.randrange(3) for _ in pairs])
    weight = np.array([rng.randrange(1, 9) for _ in pairs], float)
    tables = contextmixing.Tables.filled(pairs, classes, weight)
    plain = [np.zeros(2 << bits, np.float32) for bits in contextmixing.TABLE_BITS]
    for lanes, _, bit, places, _ in contextmixing.spelled(pairs, classes):
        for table, place in zip(plain, places, strict=True):
            np.add.at(table, 2 * place + bit, weight[lanes])
    assert all(np.array_equal(x, y) for x, y in zip(tables.counts, plain, strict=True))
    tables.prepare()
    mixer = contextmixing.Mixer()
    mixer.learn(tables, pairs, classes, weight)
    found = mixer.class_scores(tables, pairs, [0, 2])
    for column, kind in zip(found.T, (0, 2), strict=True):
        expected = np.zeros(len(pairs))
        for lanes, _, bit, places, before in contextmixing.spelled(pairs, np.full(len(pairs), kind)):
            p, _, _ = mixer.predict(*tables.inputs(places), before)
            np.add.at(expected, lanes, np.log10(np.where(bit == 1, p, 1 - p)))
        assert np.allclose(column, expected)


def test_blocks_are_answered_with_the_counts_of_all(odd_rows):
    """Two blocks ask; the answers, taken in the order of each block's names, are the counts of both."""
    texts = [(t, i % 3 == 0, i % 2) for i, (_, t, *_) in enumerate(odd_rows)]
    blocks = [pd.DataFrame(texts[k::2], columns=["text", "held_out", "class"]).assign(block=k) for k in (0, 1)]
    asked = pd.concat([contextmixing._asked(b, 5) for b in blocks])
    totals = pd.concat([contextmixing._totals(own) for _, own in asked.groupby("bucket")])
    expected, by_class = Counter(), Counter()
    for text, held, kind in texts:
        words = contextmixing.folded_words(text)
        for w in () if held else [*words, contextmixing.END, *contextmixing._paired(words)]:
            expected[w] += 1
            by_class[w, kind] += 1
    for k, b in enumerate(blocks):
        own = contextmixing.Numbered(b["text"], 5)
        got = {}
        for r in totals[totals["answer"] & (totals["block"] == k)].itertuples():
            names = [own.names[i] for i in own.buckets[r.bucket]]
            got |= dict(zip(names, contextmixing._counts(r.counts, r.counts_size).tolist(), strict=True))
        assert got == {w: expected[w] for w in own.names}
    trained = Counter()
    for _, row in totals[~totals["answer"]].iterrows():
        names, counts = contextmixing._trained(row)
        trained.update({(w, k): int(counts[k, i]) for i, w in enumerate(names) for k in range(2) if counts[k, i]})
    assert trained == {x: n for x, n in by_class.items() if b" " in x[0]}
    assert totals["n"].sum() == sum(n for w, n in expected.items() if b" " not in w)
    assert totals["v"].sum() == sum(b" " not in w for w in expected)


def test_only_texts_that_may_be_wanted_are_shuffled(spark):
    keys = spark.range(2000).select((F.xxhash64("id")).alias("text_key"))
    others = spark.range(2000, 22000).select(F.xxhash64("id").alias("k"))
    maybe = jaccard._may_be_among(keys)
    assert keys.where(~maybe(F.col("text_key"))).isEmpty()
    assert others.where(maybe(F.col("k"))).count() < 1000
    assert others.where(jaccard._may_be_among(keys.limit(0))(F.col("k"))).isEmpty()
    # only the copies' texts meet the wanted ones
    docs = spark.createDataFrame([(i, f"one two three four five number {i}") for i in range(300)] + [(300, "a b c d"), (301, "a b c d")], "doc_id long, text string")
    wanted = docs.where("doc_id = 300").select(F.lit(jaccard._node(jaccard.shingle_set("a b c d"))).alias("node"), F.xxhash64("text").alias("text_key"))
    assert [r["node"] for r in jaccard._sets(docs, wanted).collect()] == [r["node"] for r in wanted.collect()]
