"""Reading tables and the small text rules that several operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noisemix.sources.checkpoints import scratch

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: lineage ends there, and the tasks that read it follow its bytes."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def drop_written(df: DataFrame) -> None:
    """Deletes the files behind a frame of ``written`` that nothing reads any more."""
    jvm = df.sparkSession._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


_LIBC = ctypes.CDLL(None)
#: How to free what a module keeps in a Python worker beyond a task.
_KEPT: dict[str, Callable[[], object]] = {}
#: Who used this worker last.
_owner = ""


def keeps(owner: str, free: Callable[[], object]) -> None:
    _KEPT[owner] = free


def claim(owner: str) -> None:
    """Frees what other modules have kept in this worker: Spark reuses workers from stage to stage.

    A worker that changes hands gives what it no longer uses back to the system.
    """
    global _owner
    for name, free in _KEPT.items():
        if name != owner:
            free()
    if _owner != owner:
        _owner = owner
        give_back()


def give_back() -> None:
    """Returns freed memory to the system; allocators would keep it for the worker's next task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim()


def trim() -> None:
    """The cheap part of ``give_back``: what the C library has free; it would let large arrays pile up there."""
    own = getattr(_LIBC, "malloc_trim", None)  # of the GNU C library
    if own:
        own(0)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if the frame has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def folded_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, as UTF-8; none for null.

    ``bytes.lower`` and ``bytes.split`` know ASCII letters and ASCII white space only.
    """
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def remainder(doc_id: str, modulus: int) -> Column:
    """``crc32(doc_id as text) mod modulus``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus
