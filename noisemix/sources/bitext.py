"""Line-aligned text files, generation logs, and tables of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noisemix.functions import text

from .checkpoints import cut

# Start positions of this many file splits are broadcast, more are joined.
BROADCAST_SPLITS = 100_000
# The number that ends the name of a file, or of the folder it is in.
SHARD = r"[.=](\d+)(?:/[^/]*)?$"


def read_lines(spark: SparkSession, path: str, column: str = "line") -> DataFrame:
    """``sent_id, column``: the lines of one or many text files, numbered from 0.

    Files count in path order.  The lines are read once and kept with their split and their
    place in it: how a file is split depends on the session at the time, so two reads need
    not agree.  A line's number is the start of its split plus its place; the text is not
    shuffled.
    """
    numbered = _numbered(spark.read.text(path), column, F.lit(0))
    return numbered.select(F.col("line_no").alias("sent_id"), column)


def read_shard_lines(spark: SparkSession, path: str) -> DataFrame:
    """``shard, line_no, line``: the shards under a folder, the lines of each numbered from 0.

    The files of a shard count in path order, as :func:`noisemix.sources.sinks.write_shards` leaves them.
    """
    shard = F.regexp_extract("_file", SHARD, 1).cast("int")
    lines = _numbered(spark.read.option("lineSep", "\n").text(f"{path}/shard=*"), "line", shard)
    return lines.select(F.col("_group").alias("shard"), "line_no", "line")


def _numbered(lines: DataFrame, column: str, group: Column) -> DataFrame:
    """``_group, line_no, column``: lines of text files numbered inside each group of files."""
    raw = cut(
        lines.select(
            F.col("value").alias(column),
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_mid"),
        )
    )
    counts = cut(
        raw.groupBy("_file", "_block").agg(
            F.count(F.lit(1)).alias("_rows"), F.min("_mid").alias("_first")
        )
    )
    before = Window.partitionBy("_group").orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_group", group).select(
        "_group", "_file", "_block", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")
    )
    if counts.count() <= BROADCAST_SPLITS:
        starts = F.broadcast(starts)
    return raw.join(starts, ["_file", "_block"]).select(
        "_group", (F.col("_start") + F.col("_mid") - F.col("_first")).alias("line_no"), column
    )


def read_bitext(spark: SparkSession, src_path: str, tgt_path: str) -> DataFrame:
    """Two aligned text files as ``sent_id, src, tgt``; the shorter one decides the length."""
    return read_lines(spark, src_path, "src").join(read_lines(spark, tgt_path, "tgt"), "sent_id")


def read_shards(spark: SparkSession, pattern: str) -> DataFrame:
    """All shards of a corpus in one read: ``shard, line``.

    The shard number ends the file or directory name: ``train.clean.7`` or ``shard=7``.
    """
    number = F.regexp_extract(F.col("_metadata.file_path"), SHARD, 1)
    return spark.read.text(pattern).select(
        number.cast("int").alias("shard"), F.col("value").alias("line")
    )


def parse_generation_log(log: DataFrame) -> DataFrame:
    """``sent_id, hyp, ref`` from decoder output lines.

    ``T-<id><TAB>text`` holds the reference and ``D-<id><TAB>score<TAB>text`` the hypothesis.
    The tag must start the line, so text that merely contains ``T-`` is left alone.
    """
    tag = F.regexp_extract("value", r"^([TD])-(\d+)\t", 1)
    lines = log.filter(F.col("value").rlike(r"^[TD]-\d+\t")).select(
        tag.alias("tag"),
        F.regexp_extract("value", r"^[TD]-(\d+)\t", 1).cast("long").alias("sent_id"),
        F.split("value", "\t").alias("f"),
    )
    refs = lines.filter("tag = 'T'").select("sent_id", text.normalise_space(F.get("f", F.lit(1))).alias("ref"))
    hyps = lines.filter("tag = 'D'").select("sent_id", text.normalise_space(F.get("f", F.lit(2))).alias("hyp"))
    return hyps.join(refs, "sent_id")
