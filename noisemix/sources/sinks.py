"""Writing: partitioned tables, aligned text files, dry runs, resuming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .checkpoints import cut


def write_pairs(df: DataFrame, path: str, by: tuple[str, ...] = ("split",)) -> None:
    """Write a table of pairs; only the partitions present in ``df`` are replaced.

    Variants of a sentence lie side by side and are much alike, which zstd makes more of than the default.
    """
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy(*by)
        .parquet(path)
    )


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a writer has ended there: it leaves ``_SUCCESS`` as its last act."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def write_once(df: DataFrame, path: str) -> DataFrame:
    """Materialise a frame unless it is already there in full, and read it back."""
    if not finished(df.sparkSession, path):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reuse(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; made and written first where there is none, or half of one."""
    if not finished(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_aligned_text(df: DataFrame, order: list[str], columns: dict[str, str]) -> None:
    """One text file set per column, all in the same line order: ``{column: path}``.

    The rows are sorted once and kept; every column is written from those.  ``order`` must be a
    key: rows that tie on it stop the writer.
    """
    ordered = cut(df.select(*order, *[c for c in columns if c not in order]).orderBy(*order))
    if not ordered.groupBy(*order).count().where("count > 1").isEmpty():
        raise ValueError(f"{order} is not a key")
    for column, path in columns.items():
        ordered.select(column).write.mode("overwrite").text(path)


def write_shards(df: DataFrame, path: str, shard: str, order: list[str], column: str) -> None:
    """Text in a folder for each shard, ``shard=n``, whose lines keep their order.

    A range sort on shard and ``order`` spreads a large shard over many tasks; their files, in the order of
    their names, hold its lines.  Shards written from the same rows line up, line by line.
    """
    ordered = df.select(F.col(shard).alias("shard"), *order, F.col(column).alias("line")).orderBy("shard", *order)
    ordered.select("shard", "line").write.mode("overwrite").option("lineSep", "\n").partitionBy("shard").text(path)


def dry_run(df: DataFrame, name: str, *metrics: F.Column) -> dict:
    """Compute everything, write nothing, return the observed metrics."""
    seen = Observation(name)
    df.observe(seen, *metrics).write.format("noop").mode("overwrite").save()
    return seen.get


def remaining(df: DataFrame, written: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key has not been written yet."""
    return df.join(written.select(*keys), keys, "left_anti")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
