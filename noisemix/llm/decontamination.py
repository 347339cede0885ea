"""Benchmark decontamination by winnowing, with DataFrame functions only.

Words of a text are hashed in k-grams, and of each run of ``w`` neighbouring k-grams the smallest
hash is kept as a fingerprint.  Any shared span of ``k + w - 1`` words shares a fingerprint, so with
``k + w - 1 = 13`` no occurrence of a 13-word window is missed.  Fingerprints of documents are
joined with those of the benchmark; the hits in a document are then extended to every window of
13 words around them, and the windows that the benchmark holds decide which words are hit.

Items with fewer than 13 words are one window of their own length; each such length is searched
with k-grams of that length.

One pass reads all texts.  It keeps those fingerprints that pass a bit array of the benchmark's
(of bounded size; a full one passes everything, and the join after it is exact).  Only texts with
a joined fingerprint are read again, once for all their copies.  Fingerprints compare words
lower-cased in full, which finds a little more; windows compare them with A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noisemix.llm.common import free_name
from noisemix.sources.checkpoints import cut, scratch

WINDOW = 13
GRAM = 9
#: Fixed value: what parts words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most rows (a key or a hash each) that are broadcast; beyond, Spark joins by shuffling.
BROADCAST_ROWS = 200_000
#: Most 64-bit words of the bit array.
BIT_WORDS = 1 << 15


def _split(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP), "")


def words(text: Column) -> Column:
    """Words with A-Z lower-cased; none for null."""
    return _split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER))


def _loose(text: Column) -> Column:
    """As many words, lower-cased in full and without regard to their neighbours."""
    return _split(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u03a3"), F.lit("\u03c3"))))


def _hashed(found: Column) -> Column:
    return F.transform(found, lambda w: F.xxhash64(w))


def _runs(array: Column, size: int, use: Callable[[Column], Column]) -> Column:
    """``use(i)`` for the place ``i``, from 1, of every run of ``size`` elements."""
    places = F.sequence(F.lit(1), F.size(array) - (size - 1))
    return F.when(F.size(array) >= size, F.transform(places, use)).otherwise(F.array().cast("array<bigint>"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _grams(h: Column, size: int) -> Column:
    return _runs(h, size, lambda i: F.xxhash64(F.slice(h, i, size)))


def fingerprints(h: Column, window: int, gram: int) -> Column:
    """Distinct fingerprints of an array of word hashes."""
    several = window - gram + 1
    return _let(
        _grams(h, gram),
        lambda g: F.array_distinct(g if several == 1 else _runs(g, several, lambda i: F.array_min(F.slice(g, i, several)))),
    )


def _span(h: Column, i: Column, window: int) -> Column:
    """128 bits that stand for the window at place ``i``."""
    part = F.slice(h, i, window)
    return F.struct(F.xxhash64(part).alias("x"), F.xxhash64(F.lit(1), part).alias("y"))


def _bounded(df: DataFrame) -> DataFrame:
    """A broadcast hint for a table that was counted and is small; else the table as it is."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


class _Windows:
    """The benchmark's fingerprints and windows of one length."""

    def __init__(self, items: DataFrame, window: int, gram: int):
        self.window, self.gram = window, gram
        own = items.where(F.size("h") == window) if window < WINDOW else items.where(F.size("h") >= window)
        self.marks = cut(own.select(F.explode(fingerprints(F.col("loose"), window, gram)).alias("mark")).distinct())
        spans = F.transform(F.sequence(F.lit(1), F.size("h") - (window - 1)), lambda i: _span(F.col("h"), i, window))
        self.spans = cut(own.select("item_id", F.explode(spans).alias("span")).distinct())
        self.n_words = 64
        while self.n_words < min(BIT_WORDS, self.marks.count()):
            self.n_words *= 2
        place = F.shiftrightunsigned("mark", 6).bitwiseAND(self.n_words - 1)
        bit = F.expr("shiftleft(1L, cast(mark & 63 as int))")
        rows = self.marks.groupBy(place.alias("place")).agg(F.bit_or(bit).alias("bits")).collect()  # n_words at most
        bits = {r["place"]: r["bits"] for r in rows}
        self.bits = F.split(F.lit(",".join(str(bits.get(i, 0)) for i in range(self.n_words))), ",").cast("array<bigint>")

    def maybe(self, mark: Column) -> Column:
        """Whether the benchmark may hold the fingerprint."""
        word = F.get(self.bits, F.shiftrightunsigned(mark, 6).bitwiseAND(self.n_words - 1).cast("int"))
        return F.call_function("shiftrightunsigned", word, mark.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1

    def candidates(self) -> Column:
        return F.filter(fingerprints(F.col("loose"), self.window, self.gram), self.maybe)

    def extended(self, texts: DataFrame, marks: DataFrame) -> DataFrame:
        """``key, item_id, start, size`` of the windows around the joined fingerprints.

        ``texts``: ``key, h, loose``; ``marks``: ``key, mark``.
        """
        joined = marks.join(_bounded(self.marks), "mark")
        joined = joined.groupBy("key").agg(F.collect_set("mark").alias("marks"))  # no more than a text has words
        spread = self.window - self.gram
        last = F.size("h") - (self.window - 1)
        starts = _let(
            _grams(F.col("loose"), self.gram),
            lambda g: F.array_distinct(
                F.flatten(
                    F.transform(
                        F.filter(F.sequence(F.lit(1), F.size(g)), lambda i: F.array_contains("marks", F.get(g, i - 1))),
                        lambda i: F.sequence(F.greatest(i - spread, F.lit(1)), F.least(i, last), F.lit(1)),
                    )
                )
            ),
        )
        at = F.transform(starts, lambda i: F.struct(i.alias("start"), _span(F.col("h"), i, self.window).alias("span")))
        around = texts.where(last >= 1).join(joined, "key").select("key", F.explode(at).alias("at"))
        return (
            around.select("key", "at.*")
            .join(_bounded(self.spans), "span")
            .select("key", "item_id", "start", F.lit(self.window).alias("size"))
        )


def _keyed(docs: DataFrame) -> DataFrame:
    """Equal texts have one key; a null text has none."""
    return docs.withColumn("_key", F.md5(F.col("text").cast("binary")))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, _key`` and the columns of the contract.

    Null texts and texts without words have no hits, null or wordless items no windows.  Items
    count by distinct id; a null id counts for the words it hits, not as an item.
    """
    spark = docs.sparkSession
    path = scratch(spark, "decontamination")
    items = cut(
        benchmark.select("item_id", _hashed(words(F.col("text"))).alias("h"), _hashed(_loose(F.col("text"))).alias("loose"))
        .where(F.size("h") > 0)
    )
    short = items.where(F.size("h") < WINDOW).select(F.size("h")).distinct().collect()  # 12 lengths at most
    searches = [_Windows(items, WINDOW, GRAM), *(_Windows(items, n, n) for n in sorted(r[0] for r in short))]

    numbered = _keyed(docs.select("doc_id", "text")).select("doc_id", "_key", _hashed(_loose(F.col("text"))).alias("loose"))
    numbered.select(
        "doc_id", "_key", F.size("loose").cast("long").alias("n_words"), *(s.candidates().alias(f"_{s.window}") for s in searches)
    ).write.parquet(f"{path}/slim")
    slim = spark.read.parquet(f"{path}/slim")
    marks = {
        s.window: cut(
            slim.where(F.size(f"_{s.window}") > 0)
            .select(F.col("_key").alias("key"), F.explode(f"_{s.window}").alias("mark"))
            .distinct()
            .join(_bounded(s.marks), "mark", "left_semi")
        )
        for s in searches
    }
    keys = reduce(DataFrame.union, [m.select("key") for m in marks.values()]).distinct()
    texts = (
        _keyed(docs.select("text"))
        .withColumnRenamed("_key", "key")
        .join(_bounded(cut(keys)), "key", "left_semi")
        .dropDuplicates(["key"])
        .select("key", _hashed(words(F.col("text"))).alias("h"), _hashed(_loose(F.col("text"))).alias("loose"))
    )
    texts = cut(texts)
    hits = cut(reduce(DataFrame.union, [s.extended(texts, marks[s.window]) for s in searches]))
    spans = hits.groupBy("key").agg(F.collect_set(F.struct("start", "size")).alias("spans"))
    within = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1)))
    covered = spans.select("key", F.size(F.array_distinct(within)).cast("long").alias("n_hit"))
    ids = hits.groupBy("key").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    listed = ids.select(
        "key",
        F.size("ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("ids")).cast("binary"), 256).alias("items_sha256"),
    )
    per_text = cut(covered.join(listed, "key").withColumnRenamed("key", "_key"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return slim.join(_bounded(per_text), "_key", "left").select(
        "doc_id",
        "_key",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return decontaminate(docs, benchmark).drop("_key")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text isn't contaminated, as they are."""
    key = free_name(docs, "_text_key")
    bad = cut(decontaminate(docs, benchmark).where("contaminated").select(F.col("_key").alias(key)).distinct())
    keyed = docs.withColumn(key, F.md5(F.col("text").cast("binary")))
    return keyed.join(_bounded(bad), key, "left_anti").select(docs.columns)
