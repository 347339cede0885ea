from collections import Counter

import pytest
from pyspark.sql import functions as F

from noisemix.operators import mixing
from noisemix.operators.ordering import dense_row_number, group_row_number, running_totals

KEYS = ["sent_id"]


def clean(spark, n=2000):
    return spark.range(n).select(
        F.col("id").alias("sent_id"),
        F.lit("train").alias("split"),
        F.concat(F.lit("line "), F.col("id").cast("string"), F.lit(" .")).alias("src"),
        F.concat(F.lit("t"), F.col("id").cast("string")).alias("tgt"),
    )


def variants(spark, n=2000, kinds=("typo", "runon", "para", "prep")):
    rows = F.explode(F.array(*[F.lit(k) for k in kinds])).alias("kind")
    return spark.range(n).select(F.col("id").alias("sent_id"), F.lit("train").alias("split"), rows).select(
        "*",
        F.concat(F.lit("line "), F.col("sent_id").cast("string"), F.lit(" "), "kind").alias("src"),
        F.lit(None).cast("string").alias("tgt"),
    )


@pytest.mark.parametrize("ratio, u_low, u_high", [(2, 1, 2), (1, 0, 1), (4, 3, 4)])
def test_jittered_count(spark, ratio, u_low, u_high):
    df = spark.range(6000).select(
        mixing.jittered_count(ratio, F.lit(9), F.col("id"), 1).alias("k"),
        mixing.jittered_count(ratio, F.lit(1), F.col("id"), 1).alias("capped"),
    )
    counts = Counter(r.k for r in df.collect())
    assert set(counts) == {u_low, u_high}
    assert abs(counts[u_high] / 6000 - 0.5) < 0.03
    assert df.filter("capped > 1").count() == 0


def test_every_clean_row_once_and_last(spark):
    out = mixing.mix(clean(spark), variants(spark), KEYS, ratio=3, seed=1)
    rows = out.groupBy(*KEYS).agg(
        F.count_if(F.col("kind") == "clean").alias("n_clean"),
        F.max("out_rank").alias("last"),
        F.max_by("kind", "out_rank").alias("last_kind"),
        F.count(F.lit(1)).alias("n"),
    )
    assert rows.count() == 2000
    assert rows.filter("n_clean <> 1 OR last_kind <> 'clean' OR n > 4").count() == 0


def test_mix_does_not_depend_on_partitions(spark):
    got = []
    for n in (1, 4, 32):
        out = mixing.mix(clean(spark, 200).repartition(n), variants(spark, 200).repartition(n), KEYS, 3, 5)
        got.append(sorted(map(str, out.collect())))
    assert got[0] == got[1] == got[2]


def test_first_pick_follows_the_weights(spark):
    weights = {"typo": 1, "runon": 2, "para": 3, "prep": 4}
    ready = variants(spark, 8000).withColumn("clean_src", F.lit(""))
    first = mixing.sample_variants(ready, KEYS, 4, 3, weights).filter("sample_rank = 1")
    counts = Counter(r.kind for r in first.collect())
    total = sum(counts.values())
    for kind, w in weights.items():
        assert abs(counts[kind] / total - w / 10) < 0.02


def test_unchanged_variant_once(spark):
    rows = [(1, "a b", 1), (1, "a c", 2), (1, "a b", 3), (1, "a c", 4)]
    df = spark.createDataFrame(rows, "sent_id long, src string, sample_rank int").withColumn("clean_src", F.lit("a b"))
    out = mixing.drop_repeated_unchanged(df, KEYS).orderBy("sample_rank").collect()
    assert [r.src for r in out] == ["a b", "a c", "a c"]


def test_target_fallback(spark):
    v = spark.createDataFrame(
        [(1, "train", "typo", "x", "own"), (2, "train", "typo", "y", None), (3, "train", "typo", "z", " ")],
        "sent_id long, split string, kind string, src string, tgt string",
    )
    out = {r.sent_id: r.tgt for r in mixing.with_target(v, clean(spark, 5), KEYS).collect()}
    assert out == {1: "own", 2: "t2", 3: "t3"}


def test_blank_variants_are_skipped(spark):
    v = spark.createDataFrame([(1, " "), (2, " ."), (3, "a , b !")], "sent_id long, src string")
    assert {r.sent_id: r.src for r in mixing.skip_blank(v).collect()} == {2: ".", 3: "a, b!"}


def test_sample_distinct_takes_all_where_fewer(spark):
    v = spark.createDataFrame(
        [(1, "a", "x"), (1, "b", "x"), (1, "c", "y"), (2, "a", "p"), (2, "b", "q"), (2, "c", "r")],
        "sent_id long, kind string, src string",
    )
    out = mixing.sample_distinct(v, KEYS, 2, 1).collect()
    assert Counter(r.sent_id for r in out) == {1: 2, 2: 2}
    assert {(r.kind, r.src) for r in out if r.sent_id == 1} == {("a", "x"), ("c", "y")}


def test_reference_choice_is_uniform(spark):
    refs = spark.range(4000).select(F.col("id").alias("sent_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("ref_no"))
    out = mixing.pick_reference(refs, KEYS, 4, 1)
    assert out.count() == 4000
    assert all(abs(r["count"] / 4000 - 0.25) < 0.03 for r in out.groupBy("ref_no").count().collect())


def test_concat_repeats(spark):
    out = mixing.concat_corpora(spark.range(3), spark.range(10, 12), repeat=2)
    assert sorted(r.id for r in out.collect()) == [0, 1, 2, 10, 10, 11, 11]


def test_dense_row_number_on_a_hot_key(spark):
    # a third of the rows share one key, and ties are broken by the second column
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id")
    out = dense_row_number(df.repartition(7), ["k", "id"], "n").orderBy("n").collect()
    assert [r.n for r in out] == list(range(3000))
    assert [(r.k, r.id) for r in out] == sorted((r.k, r.id) for r in out)


def test_group_row_number_with_a_hot_group(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("g"), "id")
    out = group_row_number(df, ["g"], ["id"], "n").collect()
    for group in ("hot", "cold"):
        rows = sorted((r.n, r.id) for r in out if r.g == group)
        assert [n for n, _ in rows] == list(range(len(rows)))
        assert [i for _, i in rows] == sorted(i for _, i in rows)


def test_running_totals_across_blocks(spark):
    df = spark.range(500).select(F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("g"), "id", (F.col("id") * 2).alias("v"))
    out = running_totals(df, ["g"], "id", ["v"], block=32)
    sums = {"hot": 0, "cold": 0}
    for row in out.orderBy("id").collect():
        sums[row.g] += row.id * 2
        assert row.v == sums[row.g]


def test_variants_that_cannot_be_drawn_stay_out_of_the_shuffle(spark, capsys):
    rows = [(i, "train", k, f"line {i} {k}", None) for i in range(50) for k in mixing.KIND_WEIGHTS]
    variants = spark.createDataFrame(rows, "k long, split string, kind string, src string, tgt string")
    clean = spark.createDataFrame([(i, "train", f"line {i}", f"line {i}") for i in range(50)], "k long, split string, src string, tgt string")
    made = mixing.mix(clean, variants, ["k"], 3, 42)
    made.explain()
    assert "WindowGroupLimit" in capsys.readouterr().out
    counts = Counter(r.k for r in made.filter("kind <> 'clean'").collect())
    assert len(counts) == 50 and set(counts.values()) == {2, 3}
