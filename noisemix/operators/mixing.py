"""Aligning, sampling and mixing corrupted variants with clean pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noisemix.functions import text
from noisemix.functions.draws import RESOLUTION, uniform

# Every kind is equally likely unless told otherwise.
KIND_WEIGHTS = {
    "typo": 1, "both": 1, "runon": 1, "para": 1, "article": 1, "dropone": 1, "nounnum": 1,
    "prep": 1, "sva": 1,
}


def row_key(keys: list[str]) -> Column:
    return F.concat_ws(":", *[F.col(k).cast("string") for k in keys])


def align(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Positional pairing of two corpora; what only one side has is dropped."""
    return a.join(b, keys, "inner")


def align_kinds(
    clean: DataFrame, variants: DataFrame, keys: list[str], kinds: list[str]
) -> DataFrame:
    """One row per clean line with one column per kind; NULL where a kind is missing.

    Of several rows of one key and kind the largest counts.
    """
    wide = variants.groupBy(*keys).pivot("kind", kinds).agg(F.max("src"))
    return clean.join(wide, keys, "left")


def skip_blank(variants: DataFrame) -> DataFrame:
    """Detokenised variants without the blank ones."""
    return variants.withColumn("src", text.detokenise(F.col("src"))).filter(F.col("src") != "")


def with_target(variants: DataFrame, clean: DataFrame, keys: list[str]) -> DataFrame:
    """The variant's own target, or the clean one where it has none (blank counts as none)."""
    own = F.when(F.length(text.normalise_space(F.col("tgt"))) > 0, F.col("tgt"))
    return (
        variants.withColumn("_own", own)
        .drop("tgt")
        .join(
            clean.select(
                *keys,
                F.col("tgt").alias("_clean_tgt"),
                text.detokenise(F.col("src")).alias("clean_src"),
            ),
            keys,
        )
        .withColumn("tgt", text.normalise_space(F.coalesce("_own", "_clean_tgt")))
        .drop("_own", "_clean_tgt")
    )


def jittered_count(ratio: float, available: Column, key: Column, seed: int) -> Column:
    """Ratio plus a uniform jitter in (-1, 1), cut to an integer, at most what is there."""
    return F.least(
        (F.lit(float(ratio)) + F.lit(2.0) * uniform(seed, "count", key) - F.lit(1.0)).cast("int"),
        available.cast("int"),
    )


def sample_variants(
    variants: DataFrame,
    keys: list[str],
    ratio: float,
    seed: int,
    weights: dict[str, int] | None = None,
) -> DataFrame:
    """Weighted sampling without replacement among the kinds of each sentence.

    Ordering by ``-ln(u) / weight`` and keeping the first k has the law of drawing one
    kind after another.  Windows run over one sentence, so over at most one row per kind.
    Adds ``sample_rank``.
    """
    weights = weights or KIND_WEIGHTS
    # a rank is at most the number of variants, so the number drawn needn't be cut to it
    drawn = jittered_count(ratio, F.lit(2**31 - 1), row_key(keys), seed)
    return (
        _drawn_first(variants, keys, ratio, seed, weights, "sample_rank")
        .filter(F.col("sample_rank") <= drawn)
        .drop("_order")
    )


def _drawn_first(
    variants: DataFrame, keys: list[str], ratio: float, seed: int, weights: dict[str, int], rank: str
) -> DataFrame:
    """As many variants of each sentence as may be drawn at most, with ``_order`` and their ``rank``.

    The limit is a constant, so Spark leaves out later ones before the shuffle too.
    """
    weight = F.coalesce(
        *[F.when(F.col("kind") == k, F.lit(float(w))) for k, w in weights.items()]
    )
    u = uniform(seed, "variant", row_key(keys), F.col("kind")) + F.lit(0.5 / RESOLUTION)
    order = Window.partitionBy(*keys).orderBy("_order", "kind")
    return (
        variants.filter(F.col("kind").isin(*[k for k, w in weights.items() if w > 0]))
        .withColumn("_order", -F.log(u) / weight)
        .withColumn(rank, F.row_number().over(order))
        .filter(F.col(rank) <= max(math.ceil(ratio), 0))
    )


def drop_repeated_unchanged(sampled: DataFrame, keys: list[str]) -> DataFrame:
    """Of the sampled variants equal to the clean line only the first stays."""
    same = F.col("src") == F.col("clean_src")
    first = F.min(F.when(same, F.col("sample_rank"))).over(Window.partitionBy(*keys))
    return (
        sampled.withColumn("_first_same", first)
        .filter(~same | (F.col("sample_rank") == F.col("_first_same")))
        .drop("_first_same")
    )


def mix(
    clean: DataFrame,
    variants: DataFrame,
    keys: list[str],
    ratio: float = 3,
    seed: int = 0,
    weights: dict[str, int] | None = None,
) -> DataFrame:
    """Sampled variants of every sentence in sample order, its clean pair last.

    ``keys, split, kind, src, tgt, out_rank``; one shuffle, on the sentence, of the variants that
    may be drawn and of the clean pairs.
    """
    weights = weights or KIND_WEIGHTS
    few = _drawn_first(skip_blank(variants), keys, ratio, seed, weights, "_first").drop("_order", "_first")
    noisy = (
        with_target(few, clean, keys)
        .transform(lambda df: sample_variants(df, keys, ratio, seed, weights))
        .transform(lambda df: drop_repeated_unchanged(df, keys))
        .select(*keys, "split", "kind", "src", "tgt", F.col("sample_rank").alias("out_rank"))
    )
    last = clean.select(
        *keys,
        "split",
        F.lit("clean").alias("kind"),
        text.normalise_space(F.col("src")).alias("src"),
        text.normalise_space(F.col("tgt")).alias("tgt"),
        F.lit(len(weights) + 1).alias("out_rank"),
    )
    return noisy.unionByName(last)


def distinct_variants(variants: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct texts per sentence, named after the first kind that gives them."""
    return variants.groupBy(*keys, "src").agg(F.min("kind").alias("kind"))


def sample_distinct(variants: DataFrame, keys: list[str], n: int, seed: int) -> DataFrame:
    """``n`` distinct variants per sentence, all of them where there are fewer."""
    order = uniform(seed, "distinct", row_key(keys), F.col("src"))
    here = Window.partitionBy(*keys).orderBy("_u", "src")
    return (
        distinct_variants(variants, keys)
        .withColumn("_u", order)
        .withColumn("sample_rank", F.row_number().over(here))
        .filter(F.col("sample_rank") <= n)
        .drop("_u")
    )


def pick_reference(refs: DataFrame, keys: list[str], n_refs: int, seed: int) -> DataFrame:
    """One of ``n_refs`` references per sentence; no shuffle, the draw is in the row."""
    drawn = F.floor(uniform(seed, "reference", row_key(keys)) * n_refs)
    return refs.filter(F.col("ref_no") == drawn)


def concat_corpora(base: DataFrame, extra: DataFrame, repeat: int = 1) -> DataFrame:
    """Rows of ``base`` and ``repeat`` copies of ``extra``."""
    if repeat != 1:
        extra = extra.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(repeat)))).drop(
            "_copy"
        )
    return base.unionByName(extra)
