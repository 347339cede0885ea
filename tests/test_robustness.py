"""Inputs with nothing in them, inputs that change between passes, writers that stopped halfway."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from noisemix.functions import typos
from noisemix.functions.draws import block_weights, lane, draw_hash, running_weights, weighted_index, weighted_index_in_blocks
from noisemix.functions.draws import index_by_weight, let
from noisemix.operators import dictionary, metrics, mixing, noise, reports
from noisemix.plans.recipes import RECIPES
from noisemix.sources import bitext, sinks


def test_lines_survive_other_splits_between_call_and_action(spark, tmp_path):
    lines = [f"line {i}" for i in range(20_000)]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        read = bitext.read_lines(spark, str(tmp_path))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
        got = {r.sent_id: r.line for r in read.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == dict(enumerate(lines))


def test_half_a_table_is_not_reused(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    assert sinks.reuse(spark, path, lambda: spark.range(9)).count() == 3
    (tmp_path / "t" / "_SUCCESS").unlink()
    assert sinks.reuse(spark, path, lambda: spark.range(9)).count() == 9
    (tmp_path / "t" / "_SUCCESS").unlink()
    assert sinks.write_once(spark.range(5), path).count() == 5
    assert sinks.write_once(spark.range(7), path).count() == 5


def test_aligned_files_need_a_key(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "b"), (1, "c", "d")], "k int, x string, y string")
    with pytest.raises(ValueError, match="not a key"):
        sinks.write_aligned_text(rows, ["k"], {"x": str(tmp_path / "x"), "y": str(tmp_path / "y")})


def test_metrics_keep_pairs_with_a_null_side(spark):
    pairs = spark.createDataFrame(
        [("a b c", "a b c"), (None, "x y"), ("p q", None), ("a", "b")], "hyp string, ref string"
    )
    hyp, ref = F.split("hyp", " "), F.split("ref", " ")
    ter = metrics.corpus_ter(pairs, [], hyp, ref).first()
    wer = metrics.corpus_wer(pairs, [], hyp, ref).first()
    assert (ter.edits, ter.ref_words) == (5, 6) and (wer.edits, wer.ref_words) == (5, 6)
    assert metrics.corpus_meteor(pairs, [], hyp, ref).first().matches == 3
    bleu = metrics.corpus_bleu(pairs, [], hyp, ref).first()
    assert (bleu.hyp_len, bleu.ref_len, bleu.match_1) == (6, 6, 3)


def test_vector_of_length_zero(spark):
    rows = [(1, "hyp", 0, [0.0, 0.0]), (1, "hyp", 1, [1.0, 0.0]), (1, "ref", 0, [2.0, 0.0])]
    vectors = spark.createDataFrame(rows, "k int, side string, pos int, vec array<double>")
    row = metrics.embedding_score(vectors, ["k"]).first()
    assert (row.precision, row.recall) == (0.5, 1.0)


def test_batches_of_empty_and_long_lines(spark):
    rows = [(i, "train", n) for i, n in enumerate([0, 0, None, 3, 50, 50])]
    lines = spark.createDataFrame(rows, "k int, split string, n int")
    out = {r.k: r for r in dictionary.token_batches(lines, F.col("n"), ["k"], 16).collect()}
    assert [out[i].padded for i in range(6)] == [8, 8, 8, 8, 56, 56]
    assert out[4].batch_no != out[5].batch_no
    small = [out[i].batch_no for i in range(4)]
    assert all(small.count(b) <= 2 for b in small)


def test_duplicate_variants_give_the_largest(spark):
    clean = spark.createDataFrame([(1, "c")], "k int, src string")
    variants = spark.createDataFrame([(1, "typo", "x"), (1, "typo", "z"), (1, "typo", None)], "k int, kind string, src string")
    assert mixing.align_kinds(clean, variants, ["k"], ["typo", "sva"]).first().asDict() == {"k": 1, "src": "c", "typo": "z", "sva": None}


def test_unknown_token_that_is_frequent(spark):
    tokens = spark.createDataFrame([(i, ["the", "??", f"w{i % 7}", None]) for i in range(300)], "k int, tokens array<string>")
    known = dictionary.joint_dictionary(tokens.select(F.explode("tokens").alias("token")).where("token != '??'"))
    by_join = dictionary.to_ids(tokens, known, ["k"], broadcast_entries=0)
    in_place = dictionary.to_ids(tokens, known, ["k"])
    assert sorted((r.k, r.ids) for r in by_join.collect()) == sorted((r.k, r.ids) for r in in_place.collect())


def test_batch_larger_than_its_size_stops(spark):
    rows = [(0, i, f"Some words make line {i}.") for i in range(9)]
    lines = spark.createDataFrame(rows, "batch long, pos long, src string").withColumn("tgt", F.col("src"))
    lines = lines.transform(noise.prepare(["pos"])).withColumn("proper_at", F.array().cast("array<int>"))
    ok = lines.transform(noise.apply_recipe(RECIPES["both"], ["batch"], ["pos"], 9, 1))
    assert ok.count() == 9
    with pytest.raises(PySparkException, match="more than 8 lines"):
        lines.transform(noise.apply_recipe(RECIPES["both"], ["batch"], ["pos"], 8, 1)).collect()


def test_report_counts_lines_read_and_kept(spark):
    rows = [(i, "s", f"Some words make line {i}." if i % 8 else " ") for i in range(16)]
    raw = spark.createDataFrame(rows, "pos long, split string, src string").withColumn("tgt", F.col("src"))
    lines = raw.transform(noise.prepare(["pos"])).withColumn("proper_at", F.array().cast("array<int>"))
    out = lines.transform(noise.apply_recipe(RECIPES["typo"], ["split"], ["pos"]))
    row = reports.noise_report(out, ["split"], read=raw).first()
    assert (row.lines_before, row.lines_after) == (16, 14)
    steps = reports.progress_snapshots(out, "pos", 4, read=raw).orderBy("snapshot").collect()
    assert [(r.lines_before, r.lines_after) for r in steps] == [(4, 3), (8, 7), (12, 10), (16, 14)]


def test_weighted_index_in_blocks(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([0, 0, 3, 7, 9]) for _ in range(rng.choice([1, 5, 64, 65, 200]))] + [1]) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, w array<int>").withColumn("u", lane(draw_hash(1, "x", F.col("k").cast("string"))))
    both = df.select(
        weighted_index(running_weights(F.col("w")), F.col("u")).alias("plain"),
        weighted_index_in_blocks(F.col("w"), block_weights(F.col("w"), 64), 64, F.col("u")).alias("blocks"),
    )
    assert both.where("plain != blocks").count() == 0


def test_long_lines_cost_what_their_words_cost(spark):
    """Twenty thousand words: the number of typos is exact and the line comes back whole."""
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(20_000)]
    df = spark.createDataFrame([(words, "k")], "t array<string>, k string")
    row = df.select(typos.typo_sentence(F.col("t"), F.col("k"), 0.15, 1).alias("e")).first().e
    assert row.sub + row.swap == 3000 and len(row.tokens) == 20_000
    assert 2000 < sum(a != b for a, b in zip(words, row.tokens, strict=True)) <= 3000


def test_index_by_weight(spark):
    """A lookup instead of a search finds the same index."""
    weights = [(n, [(7 * i + n) % 5 for i in range(n)], u) for n in (2, 64, 1000) for u in (0.0, 0.25, 0.731, 1 - 2**-32)]
    row = spark.createDataFrame(weights, "n int, w array<int>, u double").select(
        weighted_index(running_weights(F.col("w")), F.col("u")).alias("searched"),
        let(index_by_weight(F.col("w")), lambda x: F.get(x, F.floor(F.col("u") * F.size(x)).cast("int"))).alias("looked_up"),
    )
    assert all(r.searched == r.looked_up for r in row.collect())
