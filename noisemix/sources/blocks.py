"""Work that resumes by offset: a table kept in blocks of lines, and which of them are done.

A table is written once in blocks of ``size`` consecutive lines of each split, a partition folder each.
A run takes the next blocks of every split, notes which ones (its claim), and publishes what it made of
them as a version.  A claim counts once its version is finished, so what is left is an offset for each
split, known without reading a row that is done; a run that was killed is repeated under its own claim.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import versions

_CLAIM = "split string, first_block long, end_block long"


def write_blocks(lines: DataFrame, root: str, size: int, position: str = "split_line") -> None:
    """Lines with a ``split`` and a ``position`` in it, in blocks of ``size`` positions.

    A block is bounded, so one shuffle deals blocks to tasks whatever the sizes of the splits.
    """
    dealt = lines.withColumn("block", F.floor(F.col(position) / size).cast("long"))
    dealt.repartition("split", "block").write.mode("overwrite").partitionBy("split", "block").parquet(f"{root}/lines")
    # written last, one row for each split
    sizes = lines.groupBy("split").agg((F.floor(F.max(position) / size) + 1).cast("long").alias("n_blocks"))
    sizes.write.mode("overwrite").parquet(f"{root}/sizes")


def _claims(spark: SparkSession, out: str, numbers: list[int]) -> list:
    """Rows of claims: as many as splits in each run."""
    return [r for n in numbers for r in versions.read_version(spark, f"{out}/claims", n).collect()]


def offsets(spark: SparkSession, out: str) -> dict[str, int]:
    """The first block of each split that isn't done; splits without one are at 0."""
    ends: dict[str, int] = {}
    for r in _claims(spark, out, versions.versions(spark, f"{out}/made")):
        ends[r.split] = max(ends.get(r.split, 0), r.end_block)
    return ends


def _claim(spark: SparkSession, root: str, out: str, number: int, most: int | None) -> list[tuple[str, int, int]]:
    if number in versions.versions(spark, f"{out}/claims"):
        return [tuple(r) for r in _claims(spark, out, [number])]
    done = offsets(spark, out)
    left = []
    for r in spark.read.parquet(f"{root}/sizes").collect():
        first = done.get(r.split, 0)
        end = r.n_blocks if most is None else min(r.n_blocks, first + most)
        if first < end:
            left.append((r.split, first, end))
    if left:
        versions.publish(spark.createDataFrame(left, _CLAIM), f"{out}/claims", number)
    return left


def claimed_lines(spark: SparkSession, root: str, claim: list[tuple[str, int, int]]) -> DataFrame:
    """The lines of some blocks; other folders aren't read."""
    wanted = [(F.col("split") == s) & F.col("block").between(first, end - 1) for s, first, end in claim]
    return spark.read.parquet(f"{root}/lines").filter(reduce(lambda a, b: a | b, wanted))


def advance(
    spark: SparkSession, root: str, out: str, work: Callable[[DataFrame], DataFrame], most: int | None = None
) -> bool:
    """Works on the next blocks of every split, ``most`` of each, or all; ``False`` if none is left.

    Read what all runs have made with ``made``.
    """
    known = versions.versions(spark, f"{out}/made")
    number = known[-1] + 1 if known else 0
    claim = _claim(spark, root, out, number, most)
    if not claim:
        return False
    versions.publish(work(claimed_lines(spark, root, claim)), f"{out}/made", number)
    return True


def made(spark: SparkSession, out: str) -> DataFrame:
    return versions.read_all(spark, f"{out}/made")
