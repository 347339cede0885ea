import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from noisemix.functions import edits, ngrams, text
from noisemix.operators import metrics

WORDS = "a b c d e f".split()


def random_pairs(n=120, seed=3, longest=14):
    rng = random.Random(seed)
    pairs = []
    for _ in range(n):
        ref = [rng.choice(WORDS) for _ in range(rng.randint(1, longest))]
        hyp = [w if rng.random() < 0.7 else rng.choice(WORDS) for w in ref]
        rng.random() < 0.3 and hyp.reverse()
        del hyp[rng.randint(0, len(hyp)) :]
        pairs.append((" ".join(hyp), " ".join(ref)))
    return pairs


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "hyp string, ref string")


def units(name):
    return text.tokens(F.col(name))


def plain_bleu(pairs, smooth):
    match, total, hyp_len, ref_len = [0] * 4, [0] * 4, 0, 0
    for hyp, ref in pairs:
        h, r = hyp.split(), ref.split()
        hyp_len, ref_len = hyp_len + len(h), ref_len + len(r)
        for n in range(1, 5):
            hg = Counter(tuple(h[i : i + n]) for i in range(len(h) - n + 1))
            rg = Counter(tuple(r[i : i + n]) for i in range(len(r) - n + 1))
            match[n - 1] += sum((hg & rg).values())
            total[n - 1] += sum(hg.values())
    factor, logs = 1.0, []
    for m, t in zip(match, total, strict=True):
        if t == 0 or (m == 0 and not smooth):
            return 0.0
        if m == 0:
            factor *= 2
        logs.append(math.log((m or 1 / factor) / t))
    brevity = 0.0 if not hyp_len else min(1.0, math.exp(1 - ref_len / hyp_len))
    return 100 * brevity * math.exp(sum(logs) / 4)


@pytest.mark.parametrize("smooth", [True, False])
def test_bleu_against_counters(spark, smooth):
    pairs = random_pairs()
    row = metrics.corpus_bleu(frame(spark, pairs), [], units("hyp"), units("ref"), smooth).first()
    assert row.bleu == pytest.approx(plain_bleu(pairs, smooth), abs=1e-5)


@pytest.mark.parametrize("smooth", [True, False])
def test_bleu_without_long_matches(spark, smooth):
    pairs = [("a b c d", "d c b a"), ("a x c y e", "a b c d e")]
    row = metrics.corpus_bleu(frame(spark, pairs), [], units("hyp"), units("ref"), smooth).first()
    assert row.bleu == pytest.approx(plain_bleu(pairs, smooth), abs=1e-5)


def test_bleu_of_identical_and_of_nothing(spark):
    same = frame(spark, [("a b c d e", "a b c d e"), ("f a b c", "f a b c")])
    assert metrics.corpus_bleu(same, [], units("hyp"), units("ref")).first().bleu == 100.0
    short = frame(spark, [("a b", "a b")])
    assert metrics.corpus_bleu(short, [], units("hyp"), units("ref"), smooth=True).first().bleu == 0.0
    empty = frame(spark, [("", "a b")])
    assert metrics.corpus_bleu(empty, [], units("hyp"), units("ref")).first().bleu == 0.0


def plain_distance(h, r):
    row = list(range(len(r) + 1))
    for i, x in enumerate(h, 1):
        row, above = [i], row
        for j, y in enumerate(r, 1):
            row.append(min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def test_word_errors_against_table(spark):
    pairs = random_pairs(longest=30)
    out = frame(spark, pairs).select("hyp", "ref", metrics.word_errors(units("hyp"), units("ref")).alias("e"))
    for row in out.collect():
        assert row.e == plain_distance(row.hyp.split(), row.ref.split())


def test_word_errors_with_many_words(spark):
    words = [f"w{i}" for i in range(40_000)]
    hyp = words[:100] + words[200:39_000] + ["x"] + words[39_001:]
    df = spark.createDataFrame([(hyp[-1500:], words[-1500:]), (words[:30], words[-30:])], "h array<string>, r array<string>")
    assert [r[0] for r in df.select(metrics.word_errors(F.col("h"), F.col("r"))).collect()] == [1, 30]


def as_ids(words):
    return np.array([ord(w[0]) for w in words], dtype=np.int64)


def test_banded_distance_is_exact():
    for hyp, ref in random_pairs(300, seed=8, longest=40):
        h, r = as_ids(hyp.split()), as_ids(ref.split())
        found, hyp_wrong, ref_wrong, place = edits._alignment(h, r)
        assert edits.distance(h, r) == found == plain_distance(hyp.split(), ref.split())
        # every right reference word stands where the alignment says
        for j in np.flatnonzero(~ref_wrong):
            assert h[place[j]] == r[j] and not hyp_wrong[place[j]]


def fewest_edits(h, r, moves=2):
    """Brute force: every sequence of up to ``moves`` phrase moves."""
    best, frontier = plain_distance(h, r), {tuple(h)}
    for made in range(1, moves + 1):
        step = set()
        for words in frontier:
            for start in range(len(words)):
                for end in range(start + 1, len(words) + 1):
                    rest = words[:start] + words[end:]
                    for to in range(len(rest) + 1):
                        step.add(rest[:to] + words[start:end] + rest[to:])
        best = min([best, *(made + plain_distance(w, r) for w in step)])
        frontier = step
    return best


def test_shift_edits_bounds():
    for hyp, ref in random_pairs(60, seed=5, longest=6):
        h, r = hyp.split(), ref.split()
        found = edits.shift_edits(h, r)
        assert fewest_edits(h, r) <= found <= plain_distance(h, r)


@pytest.mark.parametrize(
    "hyp, ref, expected",
    [
        ("a b c d", "a b c d", 0),
        ("c d a b", "a b c d", 1),
        ("a b x d", "a b c d", 1),
        ("", "a b", 2),
        ("a b", "", 2),
        ("b c d e a", "a b c d e", 1),
        ("d e f a b c x", "a b c d e f", 2),
    ],
)
def test_shift_edits(hyp, ref, expected):
    assert edits.shift_edits(hyp.split(), ref.split()) == expected


def test_long_sentence_with_few_edits_is_fast():
    words = [f"w{i % 3000}" for i in range(20_000)]
    hyp = list(words)
    hyp[5000:5002] = ["x"]
    assert edits.shift_edits(hyp, words) == 2


def test_ter_is_at_most_wer(spark):
    df = frame(spark, [p for p in random_pairs() if p[1]])
    ter = metrics.corpus_ter(df, [], units("hyp"), units("ref")).first()
    wer = metrics.corpus_wer(df, [], units("hyp"), units("ref")).first()
    assert ter.ref_words == wer.ref_words and 0 < ter.edits <= wer.edits
    same = frame(spark, [("a b", "a b")])
    assert metrics.corpus_ter(same, [], units("hyp"), units("ref")).first().ter == 0.0


def test_meteor(spark):
    one = metrics.corpus_meteor(frame(spark, [("the cat sat", "The cat sat")]), [], units("hyp"), units("ref")).first()
    assert one.meteor == pytest.approx(100 * (1 - 0.5 / 27), abs=1e-4)
    assert metrics.corpus_meteor(frame(spark, [("x", "y")]), [], units("hyp"), units("ref")).first().meteor == 0.0
    # matched from the right: c-c, second a - second a, b-b, first a - first a
    assert edits.exact_alignment("a b a c".split(), "a c a b".split()) == (4, 4)
    assert edits.exact_alignment("x a b y c".split(), "a b c".split()) == (3, 2)


def test_embedding_blocks_do_not_change_the_score(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [
        (s, side, p, [float(x) for x in rng.normal(size=8)])
        for s, (n, m) in enumerate([(3, 5), (70, 20), (150, 90)])
        for side, k in (("hyp", n), ("ref", m))
        for p in range(k)
    ]
    df = spark.createDataFrame(rows, "sent_id long, side string, pos int, vec array<double>")
    found = {r.sent_id: r for r in metrics.embedding_score(df, ["sent_id"]).collect()}
    for s in range(3):
        h = np.array([v for i, side, _, v in rows if i == s and side == "hyp"])
        r = np.array([v for i, side, _, v in rows if i == s and side == "ref"])
        c = (h / np.linalg.norm(h, axis=1)[:, None]) @ (r / np.linalg.norm(r, axis=1)[:, None]).T
        p, q = c.max(axis=1).mean(), c.max(axis=0).mean()
        assert found[s].precision == pytest.approx(p, abs=1e-5)
        assert found[s].recall == pytest.approx(q, abs=1e-5)
        assert found[s].f1 == pytest.approx(2 * p * q / (p + q), abs=1e-5)


def test_score_matrix(spark):
    df = spark.createDataFrame([("s", "ref", 40.0), ("s", "l2", 35.5)], "system string, eval_set string, bleu double")
    row = metrics.score_matrix(df, ["bleu"]).first()
    assert (row.ref_bleu, row.l2_bleu, row.gap_bleu) == (40.0, 35.5, 4.5)


def test_metrics_of_one_pass_equal_those_of_their_own(spark):
    rows = [("a", "the cat sat on the mat", "the cat sat on a mat"), ("a", None, "one two"), ("b", "", ""), ("b", "x y z w", "x y z w")]
    pairs = spark.createDataFrame(rows, "system string, hyp string, ref string")
    hyp, ref = text.tokens(F.col("hyp")), text.tokens(F.col("ref"))
    fused = metrics.corpus_scores(pairs, ["system"], hyp, ref, [metrics.bleu(True), metrics.METEOR, metrics.WER, metrics.TER])
    assert fused.columns == ["system", "brevity", "bleu", "meteor", "wer", "ter"]
    plan = fused._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and plan.count("Exchange") == 1
    alone = [
        metrics.corpus_bleu(pairs, ["system"], hyp, ref, True),
        metrics.corpus_meteor(pairs, ["system"], hyp, ref),
        metrics.corpus_wer(pairs, ["system"], hyp, ref),
        metrics.corpus_ter(pairs, ["system"], hyp, ref),
    ]
    for df, name in zip(alone, ["bleu", "meteor", "wer", "ter"], strict=True):
        assert sorted(map(tuple, df.select("system", name).collect())) == sorted(map(tuple, fused.select("system", name).collect()))


@pytest.mark.parametrize("chunk", [1, 100, 1 << 20])
def test_matches_of_a_batch_equal_counting(monkeypatch, chunk):
    """Pairs of a batch are counted together, in chunks of any size, and none sees another's grams."""
    monkeypatch.setattr(ngrams, "CHUNK", chunk)
    rnd = random.Random(chunk)
    pairs = []
    for n in range(200):
        ref = [rnd.choice(["a", "b", "é", "", str(rnd.random())]) for _ in range(rnd.randrange(25))]
        pairs.append(([w for w in ref[n % 3 :] if rnd.random() < 0.8] + ["b"] * (n % 4), ref))
    hyp, ref = [pa.array([p[side] for p in pairs], pa.list_(pa.string())) for side in (0, 1)]

    def counted(h, r, n):
        grams = [Counter(tuple(s[i : i + n]) for i in range(len(s) - n + 1)) for s in (h, r)]
        return sum((grams[0] & grams[1]).values())

    expected = [[counted(h, r, n) for n in (1, 2, 3, 4)] for h, r in pairs]
    assert ngrams.clipped_matches(hyp, ref, 4).tolist() == expected
    assert ngrams.clipped_matches(hyp.slice(7, 50), ref.slice(7, 50), 4).tolist() == expected[7:57]


def test_distances_of_a_batch_equal_those_of_single_pairs():
    draw = random.Random(3)
    pairs = []
    for _ in range(300):
        ref = [str(draw.randrange(draw.choice([3, 8, 60]))) for _ in range(draw.choice([0, 1, 4, 15, 40]))]
        hyp = [w if draw.random() < 0.8 else str(draw.randrange(8)) for w in ref if draw.random() < 0.9]
        cut_ = draw.randrange(len(hyp) + 1)
        pairs.append((hyp[cut_:] + hyp[:cut_] if draw.random() < 0.3 else hyp, ref))
    sides = [pa.array(list(x), pa.list_(pa.string())) for x in zip(*pairs, strict=True)]
    assert edits.batch_distances(*sides).to_pylist() == [plain_distance(h, r) for h, r in pairs]
    assert edits.batch_shift_edits(*sides).to_pylist() == [edits.shift_edits(h, r) for h, r in pairs]
    # as slices of a longer batch, with a null side
    assert edits.batch_distances(*[s.slice(7, 20) for s in sides]).to_pylist() == [plain_distance(h, r) for h, r in pairs[7:27]]
    none = pa.array([None, ["a"]], pa.list_(pa.string()))
    assert edits.batch_distances(none, pa.array([["b"], ["a"]], pa.list_(pa.string()))).to_pylist() == [1, 0]
