import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from noisemix.functions import text
from noisemix.operators import dictionary as D
from noisemix.operators import subword as W


def words_frame(spark, seed=1, n=400):
    rng = random.Random(seed)
    syllables = ["an", "ba", "ca", "nana", "to", "ti", "aaa", "é"]
    words = Counter("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))
    return words, spark.createDataFrame(list(words.items()), "word string, cnt long")


def train_one_by_one(words, covered, merges, max_piece=4):
    split = []
    for word, cnt in words.items():
        run = []
        for c in W.MARK + word:
            if c in covered or c == W.MARK:
                run.append(c)
            else:
                run and split.append((run, cnt))
                run = []
        run and split.append((run, cnt))
    learned = []
    for _ in range(merges):
        pairs = Counter()
        for s, cnt in split:
            for a, b in zip(s, s[1:], strict=False):
                if len(a) + len(b) <= max_piece:
                    pairs[a, b] += cnt
        if not pairs:
            break
        (a, b), cnt = min(pairs.items(), key=lambda x: (-x[1], x[0]))
        learned.append((a, b, cnt))
        for s, _ in split:
            i = 0
            while i < len(s) - 1:
                if s[i] == a and s[i + 1] == b:
                    s[i : i + 2] = [a + b]
                i += 1
    return learned


@pytest.mark.parametrize(
    "seed, look, held, merges",
    [(1, 20_000, 200_000, 10_000), (3, 40, 30, 30), (6, 2, 1, 8)],
)
def test_training_equals_merging_one_by_one(spark, seed, look, held, merges):
    """All pairs at once, lists and runs that are cut short, ties beyond the list."""
    words, df = words_frame(spark, seed)
    covered = set("".join(words)) - {"é"}
    expected = train_one_by_one(words, covered, merges)
    most = len(covered | {W.MARK, W.UNKNOWN_PIECE} | {a + b for a, b, _ in expected[:merges]})
    trained = W.train_merges(df, sorted(covered), most, look=look, held=held)
    got = [(r.l, r.r, r.cnt) for r in trained.orderBy("rank").collect()]
    assert got == expected[: len(got)] and len(got) >= min(len(expected), merges)


def test_training_ends_with_the_vocabulary_or_the_pairs(spark):
    words, df = words_frame(spark, 4)
    covered = sorted(set("".join(words)))
    rows = W.train_merges(df, covered, len(covered) + 2 + 20).collect()
    assert len({r.l + r.r for r in rows}) == 20
    everything = W.train_merges(df, covered).orderBy("rank").collect()
    assert rows == everything[: len(rows)]
    assert all(len(r.l + r.r) <= W.MAX_PIECE for r in everything)
    assert W.train_merges(df.where("false"), covered).collect() == []


def test_merges_in_turn():
    turns = {("a", "b"): [0, 3], ("ab", "c"): [1], ("b", "c"): [2]}
    assert W.merge_in_turn(list("abcbc"), turns) == ["abc", "bc"]
    assert W.merge_in_turn(list("a"), turns) == ["a"]
    assert W.merge_pair(list("aaaa"), ("a", "a")) == ["aa", "aa"]
    assert W.merge_pair(list("aaa"), ("a", "a")) == ["aa", "a"]


def test_encoding_ends_like_training(spark):
    """The pieces of a trained word are the symbols that training left it with."""
    words, df = words_frame(spark, 7)
    covered = sorted(set("".join(words)))
    merges = W.train_merges(df, covered)
    turns = {}
    for r in merges.orderBy("rank").collect():
        turns.setdefault((r.l, r.r), []).append(r["rank"])
    for row in W.encode(df, merges, "word").collect():
        assert row.pieces == W.merge_in_turn(list(W.MARK + row.word), turns)


def test_round_trip_and_piece_length(spark):
    words, df = words_frame(spark, 5)
    merges = W.train_merges(df, sorted(set("".join(words))), 50)
    lines = spark.createDataFrame([("banana  toti caxé",), ("",), ("  an 😀 q",)], "line string")
    out = W.encode(lines, merges, "line").select(
        "pieces", W.pieces_to_text(F.col("pieces")).alias("back"), text.normalise_space(F.col("line")).alias("norm")
    )
    for row in out.collect():
        assert row.back == row.norm
        assert all(len(p) <= W.MAX_PIECE for p in row.pieces)


def test_coverage_keeps_the_frequent_characters(spark):
    df = spark.createDataFrame([("a" * 10, 900), ("b", 900), ("z", 1)], "word string, cnt long")
    rows = {r.char: r.covered for r in W.character_coverage(df, 0.9995).collect()}
    assert rows == {"a": True, "b": True, "z": False}


def test_dictionary_order(spark):
    df = spark.createDataFrame([(t,) for t in "b a a c b d".split()], "token string")
    rows = D.joint_dictionary(df).orderBy("id").collect()
    assert [(r.token, r.cnt, r.id) for r in rows] == [("a", 2, 0), ("b", 2, 1), ("c", 1, 2), ("d", 1, 3)]


def test_lookup_and_join_agree_with_a_hot_token(spark):
    rows = [(i, ["the"] * (i % 7) + [f"w{i % 50}", "unseen"][: 1 + i % 2]) for i in range(600)] + [(600, [])]
    df = spark.createDataFrame(rows, "k long, tokens array<string>")
    known = D.joint_dictionary(df.select(F.explode("tokens").alias("token")).filter("token <> 'unseen'"))
    looked_up = {r.k: r.ids for r in D.to_ids(df, known, ["k"]).collect()}
    joined = {r.k: r.ids for r in D.to_ids(df, known, ["k"], broadcast_entries=0).collect()}
    assert looked_up == joined and len(joined) == 601
    assert looked_up[600] == [] and D.UNKNOWN in looked_up[1]


def test_batches_stay_within_budget(spark):
    df = spark.range(1000).select("id", F.lit("train").alias("split"), (F.col("id") % 37 + 1).alias("n"))
    out = D.token_batches(df, F.col("n"), ["id"], budget=100)
    sizes = out.groupBy("split", "padded", "batch_no").agg(F.count(F.lit(1)).alias("rows"))
    assert sizes.filter("rows * padded > 100").count() == 0
    assert out.count() == 1000 and out.filter("n > padded").count() == 0


def test_a_line_longer_than_the_budget_is_kept(spark):
    df = spark.createDataFrame([(1, "train", 500), (2, "train", 500)], "id long, split string, n int")
    out = D.token_batches(df, F.col("n"), ["id"], budget=100)
    assert sorted(r.batch_no for r in out.collect()) == [0, 1]


def test_length_limits(spark):
    df = spark.createDataFrame([(["a"] * 512, ["a"]), (["a"] * 513, ["a"]), (["a"], ["a"] * 513)], "s array<string>, t array<string>")
    assert [r[0] for r in df.select(W.within_limits(F.col("s"), F.col("t"))).collect()] == [True, False, False]


def test_lines_are_encoded_in_order_whatever_is_made_at_once(spark):
    """More rows than a worker makes at once, NULL and empty lines among them."""
    merges = spark.createDataFrame([(0, "a", "b", 2)], "rank int, l string, r string, cnt long")
    n = 2 * W.ROWS_AT_ONCE + 7
    line = F.when(F.col("id") % 5 == 0, F.lit(None)).when(F.col("id") % 5 == 1, "").otherwise(F.concat(F.lit("ab c"), "id"))
    df = spark.range(0, n, 1, 1).select("id", line.alias("line"))
    got = {r.id: r.pieces for r in W.encode(df, merges, "line").collect()}
    mark = W.MARK
    for i in range(n):
        expected = None if i % 5 == 0 else [] if i % 5 == 1 else [mark, "ab", mark, "c", *str(i)]
        assert got[i] == expected


def test_large_dictionary_completes_only_lines_with_rare_tokens(spark):
    """Keys that repeat or are null don't mix lines up, as they did when every token was joined."""
    rows = [(i // 2 if i % 9 else None, ["the"] * (i % 7) + [f"w{i % 50}", "unseen"][: 1 + i % 2]) for i in range(600)] + [(600, [])]
    df = spark.createDataFrame(rows, "k long, tokens array<string>")
    known = D.joint_dictionary(df.select(F.explode("tokens").alias("token")).filter("token <> 'unseen'"))
    ids = {r.token: r.id for r in known.collect()}
    expected = Counter((k, tuple(ids.get(t, D.UNKNOWN) for t in toks)) for k, toks in rows)
    for entries in (D.BROADCAST_ENTRIES, 3):
        made = D.to_ids(df, known, ["k"], broadcast_entries=entries).collect()
        assert Counter((r.k, tuple(r.ids)) for r in made) == expected


def test_unknown_rate_without_ids(spark):
    df = spark.createDataFrame(
        [("a", ["x", "y", "x", "z"]), ("a", ["z"]), ("b", []), (None, ["y", "y"])], "g string, tokens array<string>"
    )
    known = spark.createDataFrame([("x",), ("x",), ("y",)], "token string")
    rows = D.unknown_token_rate(df, known, ["g"]).collect()
    assert {r.g: (r.n_tokens, r.n_unknown, r.pct_unknown) for r in rows} == {"a": (5, 2, 40.0), "b": (0, 0, None), None: (2, 0, 0.0)}
