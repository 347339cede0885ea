"""Merkle manifest of a table: a postorder append log by aligned builders.

A row is a leaf; the leaves of a source, in the order of ``doc_id``, stand under a tree of arity
3, and the roots of the sources stand under one more.  A builder takes an aligned block of
``3 ** LEVELS`` consecutive leaves and appends every node to the block's log once the last of its
children is there.  The subtree below a node has a known size, so a node's place in the log
follows from its level and number alone (``position``), and siblings are read from the log by
their places; no level of a tree is stored as such.  The roots of a tree's blocks are the leaves
of its next tier, until a tier has one block; a block holds a complete subtree or, if it is the
tree's only one, the tree, so that a builder needs to know nothing about other blocks.

A path names the way from a leaf to the root: one step ``place:siblings`` for each level, where
``place`` is how many of the siblings stand to the left.  Paths of blocks come down tier by tier and
are joined to the blocks below them; leaves are only dealt out once.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noisemix.operators.ordering import dense_row_number, group_row_number
from noisemix.sources.checkpoints import scratch

ARITY = 3
#: Levels of a block: 729 leaves.
LEVELS = 6
#: Bytes of a digest in a log.
DIGEST = 32
#: What a path holds besides siblings.
_PLACES = re.compile("[0-9]:|,")


def field(value: Column) -> Column:
    """``-`` for null, else byte count, colon and value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _tree(source: str) -> Column:
    """A name in the order of the sources that isn't null; the null source comes first."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def leaf_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def heights(n: int, only: bool, levels: int) -> list[int]:
    """Nodes on each level of a block.

    The only block of a tree ends at the tree's root; others end at level ``levels``, where the
    last block of a tier may be a chain of single nodes.
    """
    counts = [n]
    while counts[-1] > 1 if only else len(counts) <= levels:
        counts.append(-(-counts[-1] // ARITY))
    return counts


def position(level: int, number: int, counts: list[int]) -> int:
    """Place of a node in its block's log, in closed form.

    Before the node's first leaf stand all nodes that end there; its own subtree follows and it
    is the last of that.
    """
    width = ARITY**level
    start = number * width
    end = min(start + width, counts[0])
    before = sum(start // ARITY**k for k in range(len(counts)))
    own = sum(-(-(end - start) // ARITY**k) for k in range(level + 1))
    return before + own - 1


def append_log(leaves: list[str], only: bool, levels: int = LEVELS) -> bytes:
    """All nodes of a block in the order in which they are completed."""
    counts = heights(len(leaves), only, levels)
    log: list[str] = []
    open_: list[list[str]] = [[] for _ in counts]  # digests of each level that wait for a parent
    done = [0] * len(counts)
    for number, digest in enumerate(leaves):
        level, node = 0, digest
        while True:
            log.append(node)
            done[level] += 1
            if level + 1 == len(counts):
                break
            open_[level].append(node)
            if len(open_[level]) < ARITY and not (number + 1 == len(leaves) and done[level] == counts[level]):
                break
            node = hashlib.sha256("".join(open_[level]).encode()).hexdigest()
            open_[level].clear()
            level += 1
    return bytes.fromhex("".join(log))


def steps(log: bytes, number: int, counts: list[int]) -> list[str]:
    """The way from a block's leaf to the block's root."""
    out = []
    for level in range(len(counts) - 1):
        first = number - number % ARITY
        run = range(first, min(first + ARITY, counts[level]))
        at = [DIGEST * position(level, k, counts) for k in run if k != number]
        out.append(f"{number - first}:" + "".join(log[a : a + DIGEST].hex() for a in at))
        number //= ARITY
    return out


def folded(digest: str, path: str) -> str:
    """The root that a digest and a path lead to."""
    for step in path.split(",") if path else ():
        place, siblings = step.split(":")
        at = 2 * DIGEST * int(place)
        digest = hashlib.sha256((siblings[:at] + digest + siblings[at:]).encode()).hexdigest()
    return digest


def _log(leaves: str, levels: int) -> Column:
    @F.pandas_udf("binary")
    def log(leaves: pd.Series, only: pd.Series) -> pd.Series:
        return pd.Series([append_log(list(x), bool(o), levels) for x, o in zip(leaves, only, strict=True)], dtype=object)

    return log(leaves, "only")


def _last() -> Column:
    """The root of a block: the last node of its log."""
    return F.lower(F.hex(F.substring("log", -DIGEST, DIGEST)))


def _ways(log: bytes, n: int, only: bool, upper: str, levels: int) -> list[str]:
    """Paths of all leaves of a block."""
    counts = heights(n, only, levels)
    return [",".join([*steps(log, k, counts), *([upper] if upper else [])]) for k in range(n)]


def _all_paths(upper: Column, levels: int) -> Column:
    @F.pandas_udf("array<string>")
    def paths(log: pd.Series, n: pd.Series, only: pd.Series, upper: pd.Series) -> pd.Series:
        return pd.Series([_ways(*x, levels) for x in zip(log, n.tolist(), only.tolist(), upper, strict=True)], dtype=object)

    return paths("log", "n", "only", upper)


def _folds(claimed: str, levels: int, keep_paths: bool) -> Column:
    """Proof and root for all leaves of a block."""

    @F.pandas_udf("array<struct<proof:string,folded:string>>")
    def folds(log: pd.Series, n: pd.Series, only: pd.Series, upper: pd.Series, claims: pd.Series) -> pd.Series:
        out = []
        for *block, claim in zip(log, n.tolist(), only.tolist(), upper, claims, strict=True):
            ways = _ways(*block, levels)
            proofs = ways if keep_paths else [hashlib.sha256(_PLACES.sub("", w).encode()).hexdigest() for w in ways]
            out.append([{"proof": p, "folded": folded(c, w)} for p, c, w in zip(proofs, claim, ways, strict=True)])
        return pd.Series(out, dtype=object)

    return folds("log", "n", "only", "upper", claimed)


class Manifest:
    """Logs of all tiers under one folder, written by ``build``."""

    def __init__(self, spark: SparkSession, path: str, low: int, high: int, levels: int):
        self.spark, self.path, self.low, self.high, self.levels = spark, path, low, high, levels

    def tier(self, tree: str, number: int) -> DataFrame:
        """``tree, block, n, only, log`` of a tier, and the rows of its leaves in the lowest one.

        The argument is ``sources`` for the trees of the sources and ``top`` for the one above them.
        """
        return self.spark.read.parquet(f"{self.path}/{tree}-{number}")

    @property
    def root(self) -> str | None:
        """The root; None for an empty table."""
        last = self.tier("top", self.high).select(_last()).first()
        return last[0] if last else None

    def subroots(self) -> DataFrame:
        """``tree, number, digest`` of every source; trees are numbered in the order of sources."""
        return self.spark.read.parquet(f"{self.path}/subroots")

    def paths(self) -> DataFrame:
        """``tree, block, upper, subroot`` for every block of leaves: the way from its root to the root."""
        tops = _lit_paths(self.tier("top", self.high), F.lit(""), self.levels)
        for number in range(self.high - 1, -1, -1):
            below = self.tier("top", number).join(_named(tops, "block", "upper"), "block")
            tops = _lit_paths(below, F.col("upper"), self.levels)
        named = self.subroots().join(_named(tops, "number", "upper"), "number")
        found = named.select("tree", F.lit(0).cast("long").alias("block"), "upper", F.col("digest").alias("subroot"))
        for number in range(self.low, 0, -1):
            one = self.tier("sources", number).join(found, ["tree", "block"])
            spread = one.select("tree", "block", "subroot", F.posexplode(_all_paths(F.col("upper"), self.levels)))
            place = F.col("block") * ARITY**self.levels + F.col("pos")
            found = spread.select("tree", place.alias("block"), F.col("col").alias("upper"), "subroot")
        return found


def _named(paths: DataFrame, number: str, path: str) -> DataFrame:
    return paths.select(F.col("number").alias(number), F.col("path").alias(path))


def _lit_paths(blocks: DataFrame, upper: Column, levels: int) -> DataFrame:
    """``number, path`` of every leaf of the blocks of the top tree."""
    spread = blocks.select("block", F.posexplode(_all_paths(upper, levels)))
    return spread.select((F.col("block") * ARITY**levels + F.col("pos")).alias("number"), F.col("col").alias("path"))


def _blocks(leaves: DataFrame, levels: int) -> DataFrame:
    """``tree, number, digest, ...`` in blocks; ``only`` tells that a tree has one block."""
    size = ARITY**levels
    others = [c for c in leaves.columns if c not in ("tree", "number")]
    dealt = leaves.withColumn("block", F.floor(F.col("number") / size).cast("long"))
    whole = dealt.groupBy("tree", "block").agg(F.sort_array(F.collect_list(F.struct("number", *others))).alias("rows"))
    # Block 0 is the only one if it isn't full; if it is, its root is on level `levels` in either case.
    sized = whole.withColumns({"n": F.size("rows"), "only": F.col("block") == 0})
    return sized.withColumn("log", _log("rows.digest", levels))


def _tiers(leaves: DataFrame, tree: str, path: str, levels: int) -> tuple[int, DataFrame]:
    """Writes the logs of all tiers; the number of the last one and ``tree, digest`` of the roots."""
    spark = leaves.sparkSession
    tier = 0
    while True:
        made = _blocks(leaves, levels)
        if tier or tree == "top":
            made = made.drop("rows")
        made.write.parquet(f"{path}/{tree}-{tier}")
        stored = spark.read.parquet(f"{path}/{tree}-{tier}")
        roots = stored.select("tree", F.col("block").alias("number"), _last().alias("digest"))
        last = stored.agg(F.max("block")).first()[0]
        if not last:
            return tier, roots
        leaves, tier = roots, tier + 1


def build(leaves: DataFrame, path: str, levels: int = LEVELS) -> Manifest:
    """Writes the manifest of ``source, doc_id, digest`` and further columns, which are kept beside the leaves.

    Rows with the same source and id stand in the order of their digests; a null id comes first
    and null is a source of its own, the first.  An empty table gives an empty manifest.
    """
    spark = leaves.sparkSession
    # equal rows can be told apart by where they were read, so that a sort can spread them
    spread = leaves.withColumns({"tree": _tree("source"), "_read": F.monotonically_increasing_id()})
    numbered = group_row_number(spread, ["tree"], ["doc_id", "digest", "_read"], "number").drop("_read")
    low, roots = _tiers(numbered, "sources", path, levels)
    dense_row_number(roots.drop("number"), ["tree"], "number").write.parquet(f"{path}/subroots")
    subroots = spark.read.parquet(f"{path}/subroots").select(F.lit("top").alias("tree"), "number", "digest")
    high, _ = _tiers(subroots, "top", path, levels)
    return Manifest(spark, path, low, high, levels)


def verify(manifest: Manifest, claimed: str = "digest", keep_paths: bool = False) -> DataFrame:
    """Every leaf with its subroot, the root, its proof and the root that ``claimed`` leads to.

    ``claimed`` is the column with the digest to fold, which the table was built with.  The proof
    is the digest of all siblings or, with ``keep_paths``, the path itself.
    """
    both = manifest.tier("sources", 0).join(manifest.paths(), ["tree", "block"])
    found = _folds(f"rows.{claimed}", manifest.levels, keep_paths)
    zipped = both.select("subroot", F.arrays_zip("rows", found.alias("found")).alias("both"))
    each = zipped.select("subroot", F.explode("both").alias("one"))
    return each.select(
        "one.rows.*",
        "subroot",
        F.lit(manifest.root).cast("string").alias("root"),
        F.col("one.found.proof").alias("proof"),
        F.col("one.found.folded").alias("folded_root"),
    )


def document_leaves(docs: DataFrame) -> DataFrame:
    """``source, doc_id, digest, claimed``: the leaf of a row and that of the row after tampering.

    Where 2 divides the checksum of a row's id, tampering deletes the text's line feeds.  A null
    id has no checksum and isn't tampered with.
    """
    text = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(
        F.col("text")
    )
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    return docs.select(
        "source", "doc_id", leaf_digest([*columns, F.col("text")]).alias("digest"), leaf_digest([*columns, text]).alias("claimed")
    )


def manifest_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of ``docs``: leaf, subroot, root, digest of the proof, and what tampering leads to.

    Null columns count as ``-``, a null text isn't the same as an empty one.  Rows with one source
    and id stand in the order of their leaves, repeated rows each have a place of their own.  Texts
    of any length are hashed whole.  An empty table gives no rows; other columns play no part.
    """
    manifest = build(document_leaves(docs), path or scratch(docs.sparkSession, "manifest"))
    return verify(manifest, "claimed").select(
        "doc_id",
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        F.col("proof").alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
