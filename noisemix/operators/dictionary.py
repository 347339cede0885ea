"""Token dictionaries, id encoding and token-budget batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noisemix.sources.checkpoints import cut

from .ordering import dense_row_number, group_row_number

UNKNOWN = -1
# A dictionary up to this many entries goes to every task; a larger one is joined.
BROADCAST_ENTRIES = 2_000_000
# Of a larger one as many go to every task, those with the smallest ids.
FREQUENT_ENTRIES = 500_000
# Tokens with at least this share of all occurrences are looked up by broadcast in the join;
# there can be at most 1 / share of them.
HOT_SHARE = 0.001


def joint_dictionary(tokens: DataFrame) -> DataFrame:
    """``token, cnt, id`` from a ``token`` column; ids by falling count, then by token."""
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("cnt"))
    return dense_row_number(counts, [F.desc("cnt"), "token"], "id")


def to_ids(
    df: DataFrame,
    dictionary: DataFrame,
    keys: list[str],
    tokens: str = "tokens",
    broadcast_entries: int = BROADCAST_ENTRIES,
) -> DataFrame:
    """Add ``ids ARRAY<BIGINT>``; a token missing from the dictionary becomes -1.

    A dictionary of checked size is looked up in place without a shuffle.  Of a larger one, what
    has the smallest ids is, and only tokens not found there are joined: the few very frequent
    ones by broadcast, the rest by shuffle, so no hot token lands in one task.  With no entry to be
    broadcast all tokens are joined.  All ways give the same ids.
    """
    if dictionary.limit(broadcast_entries + 1).count() <= broadcast_entries:
        return df.withColumn("ids", _lookup(dictionary, UNKNOWN)(F.col(tokens)))
    if broadcast_entries == 0:
        return _joined_ids(df, dictionary, keys, tokens)
    return _completed_ids(df, dictionary, tokens, min(broadcast_entries, FREQUENT_ENTRIES))


def _lookup(dictionary: DataFrame, missing: int | None):
    rows = dictionary.select("token", "id").toPandas()
    table = dict(zip(rows["token"], rows["id"].astype(int).tolist(), strict=True))
    shared = dictionary.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("array<bigint>")
    def ids(toks: pa.Array) -> pa.Array:
        coded = toks.flatten().dictionary_encode()
        # the last one stands for null
        found = pa.array([shared.value.get(t, missing) for t in [*coded.dictionary.to_pylist(), None]], pa.int64())
        sizes = toks.value_lengths().fill_null(0).to_numpy()
        values = found.take(coded.indices.fill_null(len(coded.dictionary)))
        return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), values)

    return ids


def _resolved(each: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``each`` with ``_id`` for its ``token``."""
    # what is frequent in the data counts, whether the dictionary has it or not
    counts = each.groupBy("token").agg(F.count(F.lit(1)).alias("_n"))
    looked_up = cut(
        counts.join(dictionary.select("token", "id"), "token", "left").select(
            "token", "_n", F.coalesce("id", F.lit(UNKNOWN)).alias("_id")
        )
    )
    total = looked_up.agg(F.sum("_n")).first()[0] or 0
    is_hot = F.col("_n") >= F.lit(total * HOT_SHARE)
    hot = looked_up.filter(is_hot).select("token", F.col("_id").alias("_hot_id"))
    rare = looked_up.filter(~is_hot).select("token", F.col("_id").alias("_rare_id"))
    kept = [c for c in each.columns if c != "token"]
    each = each.join(F.broadcast(hot), "token", "left")
    return (
        each.filter("_hot_id IS NOT NULL")
        .select(*kept, F.col("_hot_id").alias("_id"))
        .unionByName(
            each.filter("_hot_id IS NULL")
            .join(rare, "token", "left")
            .select(*kept, F.coalesce("_rare_id", F.lit(UNKNOWN)).alias("_id"))
        )
    )


def _joined_ids(df: DataFrame, dictionary: DataFrame, keys: list[str], tokens: str) -> DataFrame:
    found = _resolved(df.select(*keys, F.posexplode(tokens).alias("_at", "token")), dictionary)
    ids = found.groupBy(*keys).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("_at", F.col("_id").cast("long").alias("_id")))),
            lambda x: x["_id"],
        ).alias("ids")
    )
    return df.join(ids, keys, "left").withColumn(
        "ids", F.coalesce("ids", F.array().cast("array<bigint>"))
    )


def _completed_ids(df: DataFrame, dictionary: DataFrame, tokens: str, entries: int) -> DataFrame:
    """In place as far as ``entries`` of the dictionary go; only lines with other tokens are shuffled.

    What is missing in a line depends on its tokens alone, so 128 bits of these are the key.
    """
    first = dictionary.filter(F.col("id") < entries).limit(entries)
    coded = df.withColumn("ids", _lookup(first, None)(F.col(tokens)))
    line = {"_x": F.xxhash64(tokens), "_y": F.xxhash64(F.lit("ids"), tokens)}
    is_open = F.exists("ids", lambda i: i.isNull())
    other = coded.filter(is_open).withColumns(line)
    at = F.transform(tokens, lambda t, i: F.struct(i.alias("_at"), t.alias("token"), F.get("ids", i).alias("_id")))
    each = other.select("_x", "_y", F.inline(F.filter(at, lambda a: a["_id"].isNull()))).drop("_id")
    place = F.struct("_at", F.col("_id").cast("long").alias("_id"))
    found = _resolved(cut(each), dictionary).groupBy("_x", "_y").agg(F.collect_set(place).alias("_found"))
    here = F.filter(F.transform("ids", lambda x, i: F.struct(i.alias("_at"), x.alias("_id"))), lambda a: a["_id"].isNotNull())
    every = F.transform(F.sort_array(F.concat(here, "_found")), lambda a: a["_id"])
    completed = other.join(found, ["_x", "_y"]).withColumn("ids", every).select(*coded.columns)
    return coded.filter(~is_open).unionByName(completed)


def unknown_rate(df: DataFrame, by: list[str]) -> DataFrame:
    """Tokens without an id, per group."""
    unknown = F.size(F.filter("ids", lambda i: i == UNKNOWN))
    return (
        df.groupBy(*by)
        .agg(F.sum(F.size("ids")).alias("n_tokens"), F.sum(unknown).alias("n_unknown"))
        .withColumn(
            "pct_unknown", F.round(F.try_divide(F.col("n_unknown") * 100.0, F.col("n_tokens")), 6)
        )
    )


def unknown_token_rate(df: DataFrame, known: DataFrame, by: list[str], tokens: str = "tokens") -> DataFrame:
    """:func:`unknown_rate` without ids: what isn't among ``known.token`` is unknown.

    Only the distinct tokens of a group travel, with their number.
    """
    each = df.select(*by, F.explode_outer(tokens).alias("token"))
    counts = each.groupBy(*by, "token").agg(F.count("token").alias("_n"))
    marked = counts.join(known.select("token").distinct().withColumn("_known", F.lit(True)), "token", "left")
    return (
        marked.groupBy(*by)
        .agg(
            F.sum("_n").alias("n_tokens"),
            F.sum(F.when(F.col("_known").isNull(), F.col("_n")).otherwise(0)).alias("n_unknown"),
        )
        .withColumn(
            "pct_unknown", F.round(F.try_divide(F.col("n_unknown") * 100.0, F.col("n_tokens")), 6)
        )
    )


def token_batches(
    df: DataFrame, length: Column, keys: list[str], budget: int, width: int = 8
) -> DataFrame:
    """Batches of at most ``budget`` tokens after padding.

    Lines are bucketed by length in steps of ``width`` and padded to the top of their bucket,
    so a batch takes ``budget / padded length`` of them.  A line longer than the budget is a
    batch of its own; a line without tokens (or NULL) counts as one token.  Needs ``split``.
    """
    sized = df.withColumn("n_tokens", F.coalesce(length, F.lit(0))).withColumn(
        "padded", (F.ceil(F.greatest("n_tokens", F.lit(1)) / width) * width).cast("long")
    )
    numbered = group_row_number(sized, ["split", "padded"], ["n_tokens", *keys], "_at")
    capacity = F.greatest(F.floor(F.lit(budget) / F.col("padded")), F.lit(1))
    return numbered.withColumn("batch_no", F.floor(F.col("_at") / capacity).cast("long")).drop("_at")
