"""N-gram Jaccard self-join by PartEnum signatures.

A document's set holds the 64-bit hashes of its distinct 3-word shingles.  Sets that reach the
threshold have similar sizes and a small symmetric difference, so the sizes are cut into bands
and each band has a bound ``k`` on that difference.  The hash domain is cut into ``k + 1`` ranges;
two sets that differ in at most ``k`` elements agree on one range at least, and the contents of
each range (the subsets of size 1 of the ranges) are a signature.  A set signs for its own band
and the next larger one, which covers every pair.  Unrelated sets would meet in an empty range, so
that one isn't signed; a set that has one signs all ranges of another cut of the domain as well.
Two sets that agree on an empty range both do so, and no link is lost.

Equal sets are one class and sign once for each task.  The classes that share a signature aren't
expanded into pairs: in the order of the classes, each meets the one before and the first.  The
classes that signatures connect are a family.  Each set is compared with the family's centre once,
and from there on only the elements in which it differs from the centre travel: two sets differ in
just those in which these differences differ.  Classes that neither the centre nor the pairs above
bring into one component can need more.  An element in which a set differs from the centre, and no
other set of the family does, is a difference to every other set as well.  A set with many of them
links with nothing; for two others, such counts bound their differences from below, and only the
pairs that the bound leaves open are checked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noisemix.llm.common import claim, drop_written, folded_words, free_name, give_back, written
from noisemix.llm.components import components
from noisemix.sources.checkpoints import cut, scratch

SHINGLE = 3
#: Two sets link at ``100 * |intersection| >= PERCENT * |union|``.
PERCENT = 90
#: Cuts of the domain at most; the last one signs its empty ranges too.
CUTS = 4
_SEEN = 500_000
#: Signed rows that leave a task together.
ROWS_OUT = 1000
#: 64-bit words of the bit array that tells which texts are looked for, at most.
BIT_WORDS = 1 << 18
_U = np.uint64
_M1, _M2, _M3 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)
SLIM = "doc_id string, text_key long, n_shingles long, node long, signatures array<long>"


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit mix of each value; the sums below wrap around."""
    x = x + _U((salt * int(_M1)) & (1 << 64) - 1)
    x = (x ^ (x >> _U(31))) * _M2
    x = (x ^ (x >> _U(29))) * _M3
    return x ^ (x >> _U(32))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles.

    Fewer than three words are one shingle; null and texts without words have none.
    """
    words = folded_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out = h[: len(h) - SHINGLE + 1]
    for i in range(1, SHINGLE):
        out = _mixed(out, i) + h[i : len(h) - SHINGLE + 1 + i]
    out = np.sort(_mixed(out, SHINGLE))
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


class Bands:
    """Size bands: a set of the band's smallest size can link with its largest, not beyond."""

    def __init__(self, percent: int = PERCENT):
        self.percent = percent
        self.first, self.last = [1], [100 // percent]

    def of(self, size: int) -> int:
        while self.last[-1] < size:
            self.first.append(self.last[-1] + 1)
            self.last.append(self.first[-1] * 100 // self.percent)
        return int(np.searchsorted(self.last, size))

    def bound(self, band: int) -> int:
        """Largest symmetric difference of a linked pair whose larger set is in the band."""
        while len(self.last) <= band:
            self.of(self.last[-1] + 1)
        return 2 * self.last[band] * (100 - self.percent) // (100 + self.percent)


_BANDS = Bands()


@cache
def _borders(ranges: int) -> np.ndarray:
    return np.array([i * (1 << 64) // ranges for i in range(1, ranges)], np.uint64)


class _Cuts:
    """The contents of a set's ranges, under one cut of the domain after another."""

    def __init__(self, s: np.ndarray, ranges: int):
        self.s, self.ranges, self.made = s, ranges, []

    def at(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums that stand for the contents, and which ranges are empty."""
        while len(self.made) <= depth:
            domain = self.s if not self.made else np.sort(_mixed(self.s, 100 + len(self.made)))
            cuts = np.concatenate(([0], np.searchsorted(domain, _borders(self.ranges)), [len(domain)]))
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mixed(domain, 7))))
            place = np.arange(self.ranges, dtype=np.uint64) * _M2
            self.made.append((total[cuts[1:]] - total[cuts[:-1]] + place, np.diff(cuts) == 0))
        return self.made[depth]

    def sign(self, prefix: np.ndarray) -> Iterator[np.ndarray]:
        """Signatures of one cut, and of the next one as long as a cut leaves a range empty."""
        for depth in range(CUTS):
            content, empty = self.at(depth)
            found = _mixed(content + prefix, 11 + depth)
            if depth + 1 == CUTS or self.ranges == 1 or not empty.any():
                yield found
                return
            yield found[~empty]


def signatures(s: np.ndarray, bands: Bands = _BANDS) -> np.ndarray:
    """The signatures of a sorted set, as signed 64-bit integers."""
    out: list[np.ndarray] = []
    if len(s):
        own = bands.of(len(s))
        for band in (own, own + 1):
            prefix = _mixed(np.array([band], np.uint64), 3)
            out += _Cuts(s, bands.bound(band) + 1).sign(prefix)
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def _signed_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, n_shingles, node, signatures``; a class's signatures once for each task or more."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("jaccard")
        seen: set[int] = set()
        for batch in (x.iloc[at : at + ROWS_OUT] for x in batches for at in range(0, len(x), ROWS_OUT)):
            sizes, nodes, signed = [], [], []
            for text in batch["text"]:
                s = shingle_set(text)
                node = _node(s)
                sizes.append(len(s))
                nodes.append(node)
                signed.append(np.zeros(0, np.int64) if node in seen else signatures(s))
                if len(seen) > _SEEN:
                    seen.clear()
                seen.add(node)
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "text_key": batch["text_key"], "n_shingles": sizes, "node": nodes, "signatures": signed}
            )
        give_back()

    # pandas has no exact integers beside nulls
    slim = docs.select(F.col("doc_id").cast("string"), F.xxhash64("text").alias("text_key"), "text")
    return slim.mapInPandas(rows, SLIM).withColumn("doc_id", F.col("doc_id").cast(kind))


def _node(s: np.ndarray) -> int:
    """The class of a set: a 64-bit hash of its elements and their number."""
    total = np.array([int(_mixed(s, 23).sum(dtype=np.uint64)) + len(s) & (1 << 64) - 1], np.uint64)
    return int(_mixed(total, 29).view(np.int64)[0])


def _may_be_among(keys: DataFrame) -> Callable[[Column], Column]:
    """Whether a 64-bit key may be one of ``keys.text_key``: a bit array, of bounded size, without misses.

    Texts that can't be wanted stay out of a shuffle; the join after it is exact.
    """
    count, n_words = keys.count(), 64
    while n_words < min(BIT_WORDS, count):
        n_words *= 2
    place = F.shiftrightunsigned("text_key", 6).bitwiseAND(n_words - 1)
    bit = F.expr("shiftleft(1L, cast(text_key & 63 as int))")
    found = keys.groupBy(place.cast("int").alias("place")).agg(F.bit_or(bit).alias("bits")).toPandas()  # n_words at most
    bits = np.zeros(n_words, np.int64)
    bits[found["place"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    shared = keys.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def maybe(key: pa.Array) -> pa.Array:
        k = key.to_numpy(zero_copy_only=False)
        return pa.array((shared.value[(k >> 6) & (n_words - 1)] >> (k & 63)) & 1 == 1)

    return maybe


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, elements`` of the given classes (``node, text_key``), made again from one text of each."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            nodes, found = [], []
            for node, texts in zip(batch["node"], batch["texts"], strict=True):
                own = next((s for s in map(shingle_set, texts) if _node(s) == node), None)
                if own is not None:
                    nodes.append(node)
                    found.append(own.tobytes())
            yield pd.DataFrame({"node": nodes, "elements": found})
        give_back()

    # one copy of each text, and each text of one key; a class is wanted by one key
    own = docs.select(F.xxhash64("text").alias("text_key"), "text").where(_may_be_among(wanted)("text_key"))
    texts = own.groupBy("text_key").agg(F.collect_set("text").alias("texts")).join(wanted, "text_key")
    return texts.select("node", "texts").mapInPandas(rows, "node long, elements binary")


def _differences(classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``family, node, n, centre, near, differ``: in what a class's set differs from its family's centre.

    The centre is the class that most signatures of the family name; ``near`` ones link with it.
    """
    centre = classes.groupBy("family").agg(F.max_by("node", F.struct("degree", "node")).alias("centre"))
    middle = sets.select(F.col("node").alias("centre"), F.col("elements").alias("middle"))
    both = classes.select("family", "node", "n").join(centre, "family").join(sets, "node").join(middle, "centre")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [
                np.setxor1d(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), assume_unique=True)
                for x, y in zip(batch["elements"], batch["middle"], strict=True)
            ]
            yield batch[["family", "node", "n", "centre"]].assign(n_centre=[len(y) // 8 for y in batch["middle"]], differ=found)
        give_back()

    made = both.mapInPandas(rows, "family long, node long, n long, centre long, n_centre long, differ array<long>")
    near = F.size("differ") * (100 + percent) <= (F.col("n") + F.col("n_centre")) * (100 - percent)
    return made.select("family", "node", "n", "centre", near.alias("near"), "differ")


def _linked(pairs: DataFrame, differ: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs ``a, b``, each of one family, whose sets reach the threshold.

    Two sets differ in just the elements in which their differences from the centre differ.
    """
    a = differ.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("differ").alias("left"))
    b = differ.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("differ").alias("right"))
    apart = F.size("left") + F.size("right") - 2 * F.size(F.array_intersect("left", "right"))
    links = apart * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)
    return pairs.join(b, "b").join(a, "a").where(links).select("a", "b")


def _apart(pairs: DataFrame, roots: DataFrame, differ: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs in different components whose sizes allow a link."""
    ends = differ.select("node", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    a, b = (ends.select(*(F.col(x).alias(y) for x, y in zip(("node", "n", "root"), (c, f"n_{c}", f"root_{c}"), strict=True))) for c in "ab")
    close = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    return pairs.distinct().join(a, "a").join(b, "b").where(close & (F.col("root_a") != F.col("root_b"))).select("a", "b")


def _open_pairs(roots: DataFrame, differ: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of one family in different components that may yet link.

    With ``c`` the number of elements in which a set differs from its family's centre, and ``r`` those
    of them in which some other set of the family does too, two sets differ in at least
    ``c + c' - 2 min(r, r')`` elements, and one differs from any in ``c - r`` at least.  What may link
    with a set in the centre's component is looked for from outside that component.
    """
    rooted = differ.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    middle = F.max(F.when(F.col("node") == F.col("centre"), F.col("root")))
    split = rooted.groupBy("family").agg(F.min("root").alias("least"), F.max("root").alias("most"), middle.alias("middle"))
    placed = written(rooted.join(split.where("least != most").select("family", "middle"), "family"), "placed")
    each = placed.select("family", "node", F.explode("differ").alias("element"))
    own = each.groupBy("family", "element").agg(F.count("*").alias("k"), F.min("node").alias("node")).where("k = 1")
    own = own.groupBy("node").agg(F.count("*").alias("own"))
    facts = placed.select("family", "node", "n", "root", (F.col("root") == F.col("middle")).alias("inner"), F.size("differ").alias("c"))
    facts = facts.join(own, "node", "left").withColumn("r", F.col("c") - F.coalesce("own", F.lit(0)))
    kept = written(facts.where((F.col("c") - F.col("r")) * percent <= F.col("n") * (100 - percent)), "kept")
    names = ("node", "root", "n", "c", "r")
    left = kept.where("not inner").select("family", *(F.col(c).alias(f"{c}_a") for c in names))
    right = kept.select(F.col("family").alias("family_b"), "inner", *(F.col(c).alias(f"{c}_b") for c in names))
    least = F.col("c_a") + F.col("c_b") - 2 * F.least("r_a", "r_b")
    may = (
        (F.col("inner") | (F.col("node_a") < F.col("node_b")))
        & (F.col("root_a") != F.col("root_b"))
        & (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
        & (least * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent))
    )
    found = left.join(right, (F.col("family") == F.col("family_b")) & may)
    return found.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))


def _edges(roots: DataFrame) -> DataFrame:
    return roots.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))


def grouped(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, text_key, n_shingles, node, root`` of every row; rows with one root are linked.

    Elements are compared as 64-bit hashes, which stand for the shingles.
    """
    spark = docs.sparkSession
    path = scratch(spark, "jaccard")
    _signed_rows(docs).write.parquet(f"{path}/slim")
    slim = spark.read.parquet(f"{path}/slim")
    by = Window.partitionBy("signature").orderBy("node")  # its rows stream by; nothing of a group is held
    signed = slim.select("node", F.explode("signatures").alias("signature"))
    chained = signed.select(
        "signature", "node", F.lag("node").over(by).alias("before"), F.first("node").over(by).alias("first")
    ).where("before != node")
    chained.write.parquet(f"{path}/chained")
    chained = spark.read.parquet(f"{path}/chained")

    partner = F.explode(F.array_distinct(F.array("first", "before"))).alias("a")
    pairs = chained.select(partner, F.col("node").alias("b"))
    ends = chained.select(F.explode(F.array("first", "node")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    classes = slim.groupBy("node").agg(F.min("text_key").alias("text_key"), F.first("n_shingles").alias("n"))
    families = components(pairs).withColumnRenamed("root", "family")
    classes = written(classes.join(ends, "node").join(families, "node"), "classes")
    sets = written(_sets(docs, classes.select("node", "text_key")), "sets")
    differ = written(_differences(classes, sets, percent), "differ")
    drop_written(sets)
    roots = differ.where("near").select("node", F.col("centre").alias("root"))
    # what is in one component already needs no further test
    checked = written(_apart(pairs, roots, differ, percent), "checked")
    more = written(_linked(checked, differ, percent), "links")
    if not more.isEmpty():
        roots = components(_edges(roots).union(more))
    rest = written(_open_pairs(roots, differ, percent).join(checked, ["a", "b"], "left_anti"), "open")
    more = written(_linked(rest, differ, percent), "links")
    if not more.isEmpty():
        roots = components(_edges(roots).union(more))
    return slim.drop("signatures").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def join_documents(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: size of its set and the smallest id it is linked with.

    A null or wordless text has an empty set and is its own component.  Equal sets link.  Null
    ids take part but are never the smallest.
    """
    rows = grouped(docs, percent)
    least = rows.where("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "root", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` with one of each component: the smallest id, then the smallest text key.

    Rows without words all stay.  Of repeated rows one stays.
    """
    rows = grouped(docs, percent).where("n_shingles > 0")
    order = F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    best = rows.groupBy("root").agg(F.min(order).alias("best"))
    per = rows.groupBy("doc_id", "text_key", "root").agg(F.count("*").alias("n")).join(best, "root")
    stays = F.col("doc_id").eqNullSafe(F.col("best.id")) & (F.col("text_key") == F.col("best.key"))
    fate = F.when(~stays, "goes").when(F.col("n") > 1, "once")
    key, id_, its_key, marked = (free_name(docs, c) for c in ("_text_key", "_id", "_its_key", "_fate"))
    marks = per.select(F.col("doc_id").alias(id_), F.col("text_key").alias(its_key), fate.alias(marked))
    marks = cut(marks.where(F.col(marked).isNotNull()))
    keyed = docs.withColumn(key, F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(key) == F.col(its_key))
    may_be_marked = _may_be_among(marks.select(F.col(its_key).alias("text_key")))(key)
    marked_ones = keyed.where(may_be_marked)
    clear = keyed.where(~may_be_marked).unionByName(marked_ones.join(marks, same, "left_anti")).drop(key)
    once = marked_ones.join(marks.where(F.col(marked) == "once"), same, "left_semi").dropDuplicates(["doc_id", key])
    return clear.unionByName(once.drop(key))
