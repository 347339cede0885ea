"""Prefix trie of conversations by a splitter skeleton.

A conversation is the path of its turns' digests.  A range sort deals the paths, and the ids behind
equal paths, out to sorted shards.  A node of the trie lies in more than one shard only if it is on
the common path of two paths that meet at a splitter; the trie of these common paths is the
skeleton, and it is broadcast.  A shard walks along its sorted paths with a stack, finishes every
other node by itself, and gives partial sums for the nodes of the skeleton, which are reduced to
one row each and added up from the bottom.

The texts stay where they are: a turn is its digest (128 bits of SHA-256) and its size.  A
conversation's path is one row of some 40 bytes a turn; members of a node stream by and are held
nowhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noisemix.sources.checkpoints import cut, scratch

#: Letters of a turn's digest in a path.
STEP = 32
#: A conversation shares turns with the last one before it that this divides, and at most MOST - 1.
STRIDE, MOST = 5, 9
#: Members of a skeleton node that leave a task together.
ENDS_OUT = 50_000
NODE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
)
#: What a shard gives: nodes that are done, some of them below the skeleton, partial sums, and members.
DONE, BELOW, PARTIAL, ENDS = range(4)
SHARD = f"kind int, skeleton long, last_bytes long, {NODE}"
_COLUMNS = [c.split()[0] for c in SHARD.split(", ")]


def digested_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, turns`` of every conversation: turns are structs of ``turn, digest, size``.

    Turns come in the order of ``turn``, null first; rows of one turn in the order of their digests.
    Null roles and texts are empty.  Rows without ``conv_id`` belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    spelled = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    slim = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct("turn", F.left(F.sha2(spelled, 256), F.lit(STEP)).alias("digest"), F.octet_length(text).alias("size")).alias("one"),
    )
    return slim.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))


def share_openings(convs: DataFrame) -> DataFrame:
    """Rebuilds every conversation: a number of turns of the one it shares with, then the rest of its own.

    The number is the checksum of the id modulo ``MOST``; of a conversation that is absent, or has
    fewer, as many turns as there are.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST).cast("int")
    base = convs.where(F.col("conv_id") % STRIDE == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, MOST - 1).alias("opening")
    )
    both = convs.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % STRIDE}).join(base, "base", "left")
    # a conversation that isn't there has no turns
    opening = F.coalesce(F.slice("opening", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return both.select("conv_id", F.concat(opening, rest).alias("turns"))


class Skeleton:
    """The trie of the paths that cross a splitter; node 0 is the root."""

    def __init__(self, paths: list[str]):
        self.below: dict[tuple[int, str], int] = {}
        self.parent, self.depth, self.children = [-1], [0], [0]
        for path in paths:
            node = 0
            for at in range(0, len(path), STEP):
                key = node, path[at : at + STEP]
                if key not in self.below:
                    self.below[key] = len(self.parent)
                    self.parent.append(node)
                    self.depth.append(self.depth[node] + 1)
                    self.children.append(0)
                    self.children[node] += 1
                node = self.below[key]

    def reduced(self, partial: dict[int, tuple[int, int, int, int, int, int]]) -> list[tuple]:
        """Rows of the nodes from the sums over all shards.

        ``partial``: smallest member, members, and children, leaves, saved bytes of the parts outside the
        skeleton, bytes of the last text.
        """
        children, leaves, saved = [0] * len(self.parent), [0] * len(self.parent), [0] * len(self.parent)
        for node in range(len(self.parent) - 1, -1, -1):  # children stand behind their parents
            _, members, others, more_leaves, more_saved, last = partial[node]
            children[node] = self.children[node] + others
            leaves[node] += more_leaves if children[node] else 1
            saved[node] += more_saved + (members - 1) * last
            if node:
                leaves[self.parent[node]] += leaves[node]
                saved[self.parent[node]] += saved[node]
        return [
            (i, p[0], self.depth[i], partial[self.parent[i]][0] if i else None, p[1], children[i], leaves[i], saved[i])
            for i, p in sorted(partial.items())
        ]


class _Node:
    """A node on the stack."""

    __slots__ = ("children", "ends", "first", "hash", "last", "leaves", "members", "saved", "skeleton", "waiting")

    def __init__(self, skeleton: int, last: int):
        self.skeleton, self.last = skeleton, last
        self.first: int | None = None
        self.members = self.children = self.leaves = self.saved = 0
        self.ends: list[int] = []
        self.hash = None if skeleton >= 0 else hashlib.sha256()
        self.waiting: list[list] = []  # finished children, which need the smallest member

    def met(self, member: int) -> None:
        self.first = member if self.first is None else min(self.first, member)


class Shard:
    """Walks along sorted paths; ``rows`` gathers what is finished."""

    def __init__(self, skeleton: Skeleton):
        self.skeleton = skeleton
        self.rows: list[list] = []
        self.stack: list[_Node] = []
        self.path = ""

    def add(self, conv_id: int, path: str, sizes: list[int]) -> None:
        if not self.stack:
            self.stack.append(_Node(0, 0))
        depth = _common(self.path, path)
        while len(self.stack) > depth + 1:
            self.close()
        for at in range(depth, len(path) // STEP):
            above = self.stack[-1].skeleton
            own = self.skeleton.below.get((above, path[at * STEP : (at + 1) * STEP]), -1) if above >= 0 else -1
            self.stack.append(_Node(own, int(sizes[at])))
        self.path = path
        node = self.stack[-1]
        node.met(conv_id)
        node.members += 1
        if node.hash is None:
            node.ends.append(conv_id)
            if len(node.ends) >= ENDS_OUT:
                self.give_ends(node)
        else:
            node.hash.update(f",{conv_id}".encode() if node.ends else str(conv_id).encode())
            node.ends = node.ends or [conv_id]

    def give_ends(self, node: _Node) -> None:
        if node.ends:
            self.rows.append([ENDS, node.skeleton, 0, node.ends[0], *[None] * 6, ",".join(map(str, node.ends))])
            node.ends = []

    def close(self) -> None:
        """Finishes the deepest open node and adds it to the one above."""
        node = self.stack.pop()
        depth = len(self.stack)
        for row in node.waiting:
            row[5] = node.first
        self.rows += node.waiting
        if node.skeleton >= 0:
            self.give_ends(node)
            sums = [node.members, node.children, node.leaves, node.saved]
            self.rows.append([PARTIAL, node.skeleton, node.last, node.first, depth, None, *sums, None])
            if not depth:
                return
        else:
            leaves, saved = node.leaves or 1, node.saved + (node.members - 1) * node.last
            sums = [node.members, node.children, leaves, saved]
            row = [DONE, None, None, node.first, depth, None, *sums, node.hash.hexdigest()]
        above = self.stack[-1]
        above.met(node.first)
        above.members += node.members
        if node.skeleton < 0:
            above.children += 1
            above.leaves += leaves
            above.saved += saved
            if above.skeleton >= 0:
                self.rows.append([BELOW, above.skeleton, *row[2:]])
            else:
                above.waiting.append(row)

    def taken(self) -> pd.DataFrame:
        made, self.rows = pd.DataFrame(self.rows, columns=_COLUMNS, dtype=object), []
        return made


def _common(a: str, b: str) -> int:
    """Turns that two paths share at their start."""
    n, most = 0, min(len(a), len(b)) // STEP
    while n < most and a[n * STEP : (n + 1) * STEP] == b[n * STEP : (n + 1) * STEP]:
        n += 1
    return n


def _crossing(shards: DataFrame) -> list[str]:
    """Common paths at the splitters: one row for each shard passes the driver."""

    @F.pandas_udf("string")
    def common(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([y[: STEP * _common(x, y)] for x, y in zip(a, b, strict=True)], dtype=object)

    edges = shards.groupBy(F.spark_partition_id().alias("shard")).agg(F.min("path").alias("first"), F.max("path").alias("last"))
    met = edges.select("first", F.lag("last").over(Window.orderBy("shard")).alias("before")).where("before IS NOT NULL")
    return [r[0] for r in met.select(common("before", "first")).distinct().collect()]


def _ends_digests(ends: DataFrame) -> DataFrame:
    """``skeleton, ends_sha256``: members in runs, smallest first, stream through one digest for each node."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, state = None, None
        for batch in batches:
            for own, run in zip(batch["skeleton"].tolist(), batch["ends_sha256"], strict=True):
                if own != node:
                    if node is not None:
                        yield pd.DataFrame({"skeleton": [node], "ends": [state.hexdigest()]})
                    node, state = own, hashlib.sha256()
                    state.update(run.encode())
                else:
                    state.update(f",{run}".encode())
        if node is not None:
            yield pd.DataFrame({"skeleton": [node], "ends": [state.hexdigest()]})

    dealt = ends.repartition("skeleton").sortWithinPartitions("skeleton", "conv_id")
    return dealt.select("skeleton", "ends_sha256").mapInPandas(rows, "skeleton long, ends string")


def trie(paths: DataFrame) -> DataFrame:
    """One row for each node of the trie of ``conv_id, path, sizes``; ids are distinct."""
    spark = paths.sparkSession
    shards = cut(paths.orderBy("path", "conv_id"))
    skeleton = Skeleton(sorted(_crossing(shards)))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = Shard(skeleton)
        for batch in batches:
            for conv_id, path, sizes in zip(batch["conv_id"].tolist(), batch["path"], batch["sizes"], strict=True):
                shard.add(conv_id, path, sizes)
            yield shard.taken()
        while shard.stack:
            shard.close()
        yield shard.taken()

    path = scratch(spark, "prefix-trie")
    shards.mapInPandas(walk, SHARD).write.parquet(path)
    found = spark.read.parquet(path)
    sums = found.where(F.col("kind") == PARTIAL).groupBy("skeleton").agg(
        F.min("conv_id"), F.sum("n_convs"), F.sum("n_children"), F.sum("n_leaves"), F.sum("saved_tokens"), F.max("last_bytes")
    )
    partial = {r[0]: tuple(r)[1:] for r in sums.collect()}  # as many rows as the skeleton has nodes
    rows = skeleton.reduced(partial) if partial else []
    schema = "skeleton long, " + NODE.rpartition(", ")[0]
    above = spark.createDataFrame(rows, schema)
    digests = _ends_digests(found.where(F.col("kind") == ENDS))
    nodes = [c.split()[0] for c in NODE.split(", ")]
    ends = F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256))
    whole = above.join(digests, "skeleton", "left").withColumn("ends_sha256", ends).select(*nodes)
    parents = above.select("skeleton", F.col("conv_id").alias("_parent"))
    below = found.where(F.col("kind") == BELOW).join(F.broadcast(parents), "skeleton")
    return (
        found.where(F.col("kind") == DONE)
        .select(*nodes)
        .union(below.withColumn("parent_conv_id", F.col("_parent")).select(*nodes))
        .union(whole)
    )


def conversation_trie(turns: DataFrame) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations.

    The root stands for every conversation, turnless ones too, and has no parent.  Copies of a
    conversation are members of the same nodes.  An empty table has no conversations and no nodes; other
    columns play no part.  Rules for nulls, ties and repeated rows stand with ``digested_turns``.
    """
    rebuilt = share_openings(digested_turns(turns))
    return trie(rebuilt.select("conv_id", F.array_join("turns.digest", "").alias("path"), F.col("turns.size").alias("sizes")))
