"""Token counts from flat token files.

A token file is nothing but token ids, as little-endian unsigned 32-bit integers, with an
end-of-document id behind every document; there is no index.  A file is read in blocks.  In each
block one vectorised search finds the separators; documents inside a block are counted there, and
a block passes on what stands before its first and behind its last separator.  A prefix sum over
the blocks of a file (how many blocks before hold a separator) tells which of these pieces belong
together, and their lengths are added up.

``binaryFile`` is Spark's only reader of raw bytes in any store; it reads files of up to 2 GB.  The
writer closes a file by its bytes, so only a single document of half a billion tokens would pass that.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noisemix.llm.common import folded_words
from noisemix.sources.checkpoints import scratch

#: Ids below it are words (a 24-bit checksum of the word); its last byte ends a line of Spark's text writer.
END = 1 << 24
#: Tokens in front of a document that carry its id: 22 bits each; bit 23 of the first marks a null id.
HEADER = 3
_PART = (1 << 22) - 1
_NULL = 1 << 23
BLOCK_BYTES = 4 << 20
#: A file ends before the document that would make it larger; one longer than that has a file of its own.
FILE_BYTES = 32 << 20


def token_ids(text: str | None) -> np.ndarray:
    """A word's id depends on the word alone; null has no words."""
    words = folded_words(text)
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) & np.uint32(END - 1)


def header(doc_id: int | None) -> list[int]:
    if doc_id is None:
        return [_NULL, 0, 0]
    bits = int(doc_id) & (1 << 64) - 1
    return [bits & _PART, bits >> 22 & _PART, bits >> 44]


def header_id(tokens: list[int]) -> int | None:
    low, middle, high = map(int, tokens)
    if low & _NULL:
        return None
    bits = low | middle << 22 | high << 44
    return bits - (1 << 64) if bits >> 63 else bits


def write_token_files(docs: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Writes each document as header, token ids and ``END``, in files of ``file_bytes`` or one document.

    Null and empty texts are documents without tokens, repeated rows repeat, and an empty table gives
    files without documents.  Spark's text writer puts one row into a file, a run of documents, and
    the line separator, the last byte of ``END``, behind it.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, size = [], 0
        for batch in batches:
            ids = batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None)
            for i, text in zip(ids, batch["text"], strict=True):
                parts = (np.array(header(i), "<u4"), token_ids(text).astype("<u4"), np.array([END], "<u4"))
                document = np.concatenate(parts).tobytes()
                if run and size + len(document) > file_bytes:
                    yield pd.DataFrame({"raw": [b"".join(run)[:-1]]})
                    run, size = [], 0
                run.append(document)
                size += len(document)
        if run:
            yield pd.DataFrame({"raw": [b"".join(run)[:-1]]})

    raw = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(rows, "raw binary")
    raw.select(F.col("raw").cast("string").alias("value")).write.option("lineSep", "\x01").option("maxRecordsPerFile", 1).text(path)


def _scan(block: np.ndarray, end: int, lead: int) -> tuple[list[tuple], np.ndarray]:
    """Pieces ``(kind, start, length, leading tokens)`` of a block; kind 1 is a whole document.

    Kind 0 stands before the first separator, kind 2 behind the last one.
    """
    cuts = np.nonzero(block == end)[0]
    first = cuts[0] if len(cuts) else len(block)
    out = [(0, 0, int(first), block[: min(lead, first)].tolist())]
    starts, lengths = cuts[:-1] + 1, np.diff(cuts) - 1
    out += [(1, int(s), int(n), block[s : s + min(lead, n)].tolist()) for s, n in zip(starts, lengths, strict=True)]
    if len(cuts):
        tail = cuts[-1] + 1
        out.append((2, int(tail), int(len(block) - tail), block[tail : tail + lead].tolist()))
    return out, cuts


def count_tokens(spark: SparkSession, path: str, end: int = END, lead: int = 0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``file, start, n_tokens, lead, closed`` of every document in the files under ``path``.

    ``start`` is the place of its first token; ``lead`` holds the document's first tokens, ``lead`` at
    most.  Separators in a row stand around empty documents.  Tokens behind a file's last
    separator are a document that isn't closed; none there, no document.  Bytes that don't fill
    a token at a file's end are ignored.  Empty files have no documents.
    """
    if block_bytes % 4:
        raise ValueError("a block must hold whole tokens")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where("length >= 4")
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.col("length") - 1) / block_bytes).cast("int")),
        lambda i: F.struct(
            i.alias("block"),
            F.substring(F.col("content"), i * F.lit(block_bytes) + 1, F.lit(block_bytes)).alias("raw"),
        ),
    )

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, block, raw in zip(batch["file"], batch["block"], batch["raw"], strict=True):
                pieces, cuts = _scan(np.frombuffer(raw, "<u4", len(raw) // 4), end, lead)
                made = pd.DataFrame(pieces, columns=["kind", "start", "n_tokens", "lead"])
                made["start"] += block * (block_bytes // 4)
                yield made.assign(file=file, block=block, cut=int(len(cuts) > 0))

    schema = "file string, block int, kind int, start long, n_tokens long, lead array<long>, cut int"
    read = files.select(F.col("path").alias("file"), F.explode(blocks).alias("b")).select("file", "b.*")
    found = scratch(spark, "token-counts")
    read.mapInPandas(rows, schema).write.parquet(found)
    pieces = spark.read.parquet(found)

    inside = pieces.where("kind = 1").select("file", "start", "n_tokens", "lead", F.lit(True).alias("closed"))
    order = Window.partitionBy("file").orderBy("block")
    heads = pieces.where("kind = 0").select("file", "block", "cut")  # one row for each block
    scanned = heads.select(
        "file",
        "block",
        F.coalesce(F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("cut").over(Window.partitionBy("file")).alias("all"),
    )
    edges = pieces.where("kind != 1").join(scanned, ["file", "block"])
    edges = edges.withColumn("document", F.col("before") + F.when(F.col("kind") == 2, 1).otherwise(0))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("block", "kind", "lead"))), lambda p: p["lead"])
    stitched = edges.groupBy("file", "document").agg(
        F.min("start").alias("start"),
        F.sum("n_tokens").alias("n_tokens"),
        F.slice(F.flatten(parts), 1, lead).alias("lead") if lead else F.array().cast("array<bigint>").alias("lead"),
        (F.first("all") > F.col("document")).alias("closed"),
    )
    return inside.union(stitched.where("closed or n_tokens > 0").drop("document"))


def count_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens``: tokens of every row of ``docs``, through token files written to ``path``.

    Null and empty texts have no tokens; repeated rows repeat; texts of any length are counted whole,
    across blocks; an empty table gives no rows.  Other columns, whatever their names, aren't read.
    """
    spark = docs.sparkSession
    path = path or scratch(spark, "token-files")
    write_token_files(docs, path)

    @F.pandas_udf("long")
    def owner(leads: pd.Series) -> pd.Series:
        return pd.Series([header_id(x) for x in leads], dtype="Int64")

    counted = count_tokens(spark, f"{path}/part-*", lead=HEADER)
    return counted.select(owner("lead").alias("doc_id"), (F.col("n_tokens") - HEADER).alias("n_tokens"))
