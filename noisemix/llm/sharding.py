"""Sharding by fixed virtual slots.

A record is hashed into one of a few thousand virtual slots; the slot never changes.  Bytes
are summed per slot, and a small versioned table maps slots to shards.  Rebalancing edits that
table: version 0 deals the slots out evenly by number, version 1 moves as few slots as level
the bytes.  Rows are never moved between slots, so a later edit only touches the map.

Whatever passes the driver has one row per virtual slot, whatever the size of the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noisemix.sources.checkpoints import scratch

VIRTUAL_SLOTS = 4096
MAP_SCHEMA = "version int, virtual_slot int, shard int, bytes long, n_rows long"


def records(docs: DataFrame, virtual_slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """``doc_id, size, text_crc32, virtual_slot`` of every row.

    Size is the UTF-8 bytes of the text plus 1.  A null text counts as empty; a null id is
    hashed like any value.  The id and the text's checksum decide the slot, so rows that repeat
    an id spread unless they are the same row.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = docs.select(
        F.col("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    slot = F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(virtual_slots)).cast("int")
    return slim.withColumn("virtual_slot", slot)


def even_map(virtual_slots: int, shards: int) -> list[int]:
    """Version 0: consecutive runs of slots, as many for each shard as for any other."""
    return [slot * shards // virtual_slots for slot in range(virtual_slots)]


def edited_map(shard_of: list[int], weight: list[int], shards: int, taker: int | None = None) -> list[int]:
    """Moves slots from the heaviest shard to the lightest until no move narrows the gap.

    The slot that comes closest to half the gap moves; ties go to the smaller slot.  With a
    ``taker`` (a shard that is added, say) slots only move to that one.
    """
    out = list(shard_of)
    load = [0] * shards
    held: list[set[int]] = [set() for _ in range(shards)]
    for slot, shard in enumerate(out):
        load[shard] += weight[slot]
        if weight[slot]:
            held[shard].add(slot)
    while True:
        high = max(range(shards), key=lambda s: (load[s], -s))
        low = min(range(shards), key=lambda s: (load[s], s)) if taker is None else taker
        gap = load[high] - load[low]
        fits = [s for s in held[high] if weight[s] < gap]
        if not fits:
            return out
        slot = min(fits, key=lambda s: (abs(2 * weight[s] - gap), s))
        held[high].remove(slot)
        held[low].add(slot)
        load[high] -= weight[slot]
        load[low] += weight[slot]
        out[slot] = low


def slot_map(recs: DataFrame, shards: int, virtual_slots: int, path: str) -> DataFrame:
    """Writes both versions of the map to ``path`` and returns the stored table."""
    spark: SparkSession = recs.sparkSession
    sums = recs.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    found = {r["virtual_slot"]: (r["b"], r["n"]) for r in sums.collect()}  # a row per slot at most
    weight = [found.get(s, (0, 0))[0] for s in range(virtual_slots)]
    count = [found.get(s, (0, 0))[1] for s in range(virtual_slots)]
    first = even_map(virtual_slots, shards)
    versions = [first, edited_map(first, weight, shards)]
    rows = [
        (version, slot, shard, weight[slot], count[slot])
        for version, shard_of in enumerate(versions)
        for slot, shard in enumerate(shard_of)
    ]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.parquet(path)
    return spark.read.schema(MAP_SCHEMA).parquet(path)


def shard_documents(
    docs: DataFrame, shards: int = 8, virtual_slots: int = VIRTUAL_SLOTS, map_path: str | None = None
) -> DataFrame:
    """One row per row of ``docs``: its shard and its gapless place in that shard.

    Law ``bytes``: the sums of ``size`` differ between shards by little more than one virtual
    slot holds.  An empty table gives no rows.  Repeated rows each get a place of their own.
    ``slot`` numbers the rows of a shard from 0: by virtual slot, then id, checksum and size.  The
    window sorts one virtual slot at a time, a 4096th of the rows.
    """
    recs = records(docs, virtual_slots)
    path = map_path or scratch(docs.sparkSession, "slot-map")
    mapped = slot_map(recs, shards, virtual_slots, path)
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    current = mapped.where(F.col("version") == 1).select(
        "virtual_slot",
        "shard",
        F.col("version").alias("map_version"),
        F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("start"),
    )
    place = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        recs.withColumn("place", F.row_number().over(place) - 1)
        .join(F.broadcast(current), "virtual_slot")  # virtual_slots rows
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("start") + F.col("place")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "virtual_slot",
            "map_version",
        )
    )
