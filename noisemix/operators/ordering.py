"""Global positions and running sums without a single-task window.

``row_number()`` over one big group, and over no group at all, runs in one task.
Here a range sort spreads the rows, every partition numbers its own, and only the
per-partition counts (as many rows as there are shuffle partitions) are summed up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noisemix.sources.checkpoints import cut

BROADCAST_GROUPS = 100_000
_PARTITION_BITS = 33  # layout of monotonically_increasing_id


def dense_row_number(df: DataFrame, order: list, name: str = "row_no") -> DataFrame:
    """0-based position of every row in the global order ``order``.

    End the order with a key: rows that tie on all of it cannot be spread.
    """
    spread = cut(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright("_mid", _PARTITION_BITS)
    local = F.col("_mid").bitwiseAND((1 << _PARTITION_BITS) - 1)
    counts = spread.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")
    )
    # one row per partition of the sort: bounded by the shuffle width
    return (
        spread.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + local)
        .drop("_part", "_start", "_mid")
    )


def group_row_number(
    df: DataFrame, group: list[str], order: list, name: str = "row_no"
) -> DataFrame:
    """0-based position inside each group, where one group may hold most of the rows.

    Meant for groups like splits and length buckets: the start positions of up to
    ``BROADCAST_GROUPS`` groups are broadcast, more are joined.
    """
    numbered = dense_row_number(df, [*group, *order], "_pos")
    starts = cut(numbered.groupBy(*group).agg(F.min("_pos").alias("_first")))
    if starts.count() <= BROADCAST_GROUPS:
        starts = F.broadcast(starts)
    return (
        numbered.join(starts, group)
        .withColumn(name, F.col("_pos") - F.col("_first"))
        .drop("_pos", "_first")
    )


def running_totals(
    df: DataFrame, group: list[str], position: str, values: list[str], block: int = 65536
) -> DataFrame:
    """Running sums along an integer ``position`` inside each group.

    Two levels: inside blocks of ``block`` positions, then over the block totals, so a
    group holding a third of all rows is summed by many tasks.
    """
    keys = [*group, "_block"]
    blocked = df.withColumn("_block", F.floor(F.col(position) / block).cast("long"))
    inside = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    # one row per block: with no group this is positions / block rows in one task
    earlier = (
        Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = (
        blocked.groupBy(*keys)
        .agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
        .select(
            *keys,
            *[
                F.coalesce(F.sum(f"_sum_{v}").over(earlier), F.lit(0)).alias(f"_carry_{v}")
                for v in values
            ],
        )
    )
    local = blocked.select("*", *[F.sum(v).over(inside).alias(f"_in_{v}") for v in values])
    return local.join(carry, keys).select(
        *[c for c in df.columns if c not in values],
        *[(F.col(f"_in_{v}") + F.col(f"_carry_{v}")).alias(v) for v in values],
    )
