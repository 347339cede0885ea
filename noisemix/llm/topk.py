"""Exact top-k search by inner product over a pivot-distance index.

Vectors are made integer and get one more component that brings all of them to the length of the
longest, ``M``; then ``|q - x|^2 = |q|^2 + M^2 - 2 q.x``, so the nearest vectors are those of the largest
inner product.  Every vector is keyed by its nearest pivot and its distance to it.  The distances
of a pivot are cut into annuli of about ``ANNULUS`` rows by a histogram of bounded size; a hot annulus
(many equal vectors) is dealt out to several cells.

A query visits the annuli that may lie nearest until they hold enough rows, which gives its k-th
score so far.  By the triangle inequality an annulus ``[lo, hi]`` of a pivot at distance ``d`` holds
nothing nearer than ``max(0, d - hi, lo - d)``; only annuli that could still reach the k-th score are
visited in the second round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noisemix.sources.checkpoints import cut, scratch

#: Pivots: the vectors with the smallest hashes of their ids.
PIVOTS = 32
#: Steps of the histogram of distances to a pivot.
STEPS = 256
#: Rows of an annulus, about; and of a cell, which is a part of an annulus.
ANNULUS = 512
CELL = 4096
#: Rows that the first round looks at, for each query, at least.
FIRST_LOOK = 512
RESULT = "query_id long, vec_id long, score long"


def integer_vectors(table: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, v``: components as ``floor(scale * x)``, with x as double.

    Rows with a null id, and null vectors or those with null or non-finite components, take no
    part.  Of several vectors with one id the smallest counts.
    """
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda e: F.coalesce(F.abs(e) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(e))
    rows = table.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    v = F.transform(x, lambda e: F.floor(e * scale).cast("long"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


class Index:
    """The bounded part of the index: pivots and the borders and counts of their annuli."""

    def __init__(self, pivots: np.ndarray, width: int, longest2: float, exact: bool):
        self.pivots, self.width, self.longest2, self.exact = pivots, width, longest2, exact
        self.step = 2 * longest2**0.5 / STEPS or 1.0
        self.slack = 1e-6 * (longest2**0.5 + 1)

    def lifted(self, vectors: pd.Series) -> np.ndarray:
        plain = _matrix(vectors, self.width)
        return np.c_[plain, np.sqrt(np.maximum(self.longest2 - (plain**2).sum(1), 0))]

    def distances(self, points: np.ndarray) -> np.ndarray:
        square = (points**2).sum(1)[:, None] + (self.pivots**2).sum(1) - 2 * points @ self.pivots.T
        return np.sqrt(np.maximum(square, 0))

    def close(self, histogram: np.ndarray) -> None:
        """Cuts each pivot's steps into annuli; ``annulus[pivot, step]`` numbers them over all pivots."""
        self.annulus = np.zeros_like(histogram)
        low, high, owner, rows = [], [], [], []
        for p, counts in enumerate(histogram):
            held = ANNULUS
            for s, n in enumerate(counts):
                if held >= ANNULUS:
                    low.append(s * self.step)
                    high.append(0.0)
                    owner.append(p)
                    rows.append(0)
                    held = 0
                self.annulus[p, s] = len(low) - 1
                held += n
                rows[-1] += n
                high[-1] = (s + 1) * self.step
        self.low, self.high = np.array(low) - self.slack, np.array(high) + self.slack
        self.owner, self.rows = np.array(owner), np.array(rows)
        self.cells = np.maximum(1, -(-self.rows // CELL))

    def best_scores(self, queries: pd.Series) -> np.ndarray:
        """Upper bound of the scores in each annulus, for each query."""
        plain = _matrix(queries, self.width)
        d = self.distances(np.c_[plain, np.zeros(len(plain))])[:, self.owner]
        gap = np.maximum(0, np.maximum(d - self.high, self.low - d))
        bound = ((plain**2).sum(1)[:, None] + self.longest2 - gap**2) / 2 + self.slack * (self.longest2**0.5 + 1)
        return np.where(self.rows > 0, bound, -np.inf)

    def scores(self, queries: pd.Series, vectors: pd.Series) -> np.ndarray:
        """Inner products; beyond what a double holds, in Python's integers."""
        if self.exact:
            return (_matrix(queries, self.width) @ _matrix(vectors, self.width).T).astype(np.int64)
        wide = [np.array([[int(x) for x in v] + [0] * (self.width - len(v)) for v in s], object) for s in (queries, vectors)]
        return (wide[0] @ wide[1].T).astype(np.int64)


def _build(vectors: DataFrame, pivots: int) -> tuple[Index, DataFrame] | None:
    """The index and ``vec_id, v, annulus, cell``."""
    square = F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e)
    seen = vectors.agg(F.max(square).alias("m"), F.max(F.size("v")).alias("w")).first()
    if seen["m"] is None:
        return None
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    index = Index(np.zeros((0, 0)), seen["w"], seen["m"], seen["m"] < 2**52)
    index.pivots = index.lifted(pd.Series([r["v"] for r in rows]))

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            d = index.distances(index.lifted(batch["v"]))
            nearest = d.argmin(1)
            step = np.minimum(d[np.arange(len(d)), nearest] / index.step, STEPS - 1).astype(int)
            yield batch.assign(pivot=nearest, step=step)

    path = scratch(vectors.sparkSession, "pivot-index")
    vectors.mapInPandas(keyed, "vec_id long, v array<long>, pivot int, step int").write.parquet(path)
    stored = vectors.sparkSession.read.parquet(path)
    histogram = np.zeros((len(rows), STEPS), np.int64)
    for r in stored.groupBy("pivot", "step").count().collect():  # a row for each step of each pivot at most
        histogram[r["pivot"], r["step"]] = r["count"]
    index.close(histogram)

    @F.pandas_udf("struct<annulus:int, cell:int>")
    def place(vec_id: pd.Series, pivot: pd.Series, step: pd.Series) -> pd.DataFrame:
        annulus = index.annulus[pivot, step]
        return pd.DataFrame({"annulus": annulus, "cell": vec_id.to_numpy() % index.cells[annulus]})

    placed = stored.select("vec_id", "v", place("vec_id", "pivot", "step").alias("at")).select("vec_id", "v", "at.*")
    return index, placed


def _visits(index: Index, queries: DataFrame, second: bool) -> DataFrame:
    """``query_id, q, annulus, cell``: the cells that each query visits in a round."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bound = index.best_scores(batch["q"])
            order = np.argsort(-bound, axis=1, kind="stable")
            held = np.cumsum(index.rows[order], axis=1)
            early = np.zeros_like(bound, bool)
            np.put_along_axis(early, order, held - index.rows[order] < FIRST_LOOK, 1)
            early &= bound > -np.inf
            chosen = ~early & (bound > -np.inf) & (bound >= batch["kth"].to_numpy(float)[:, None]) if second else early
            q, annulus = np.nonzero(chosen)
            cells = index.cells[annulus]
            q, annulus = np.repeat(q, cells), np.repeat(annulus, cells)
            cell = np.arange(len(q)) - np.repeat(np.cumsum(cells) - cells, cells)
            for at in range(0, len(q), 20_000):
                part = slice(at, at + 20_000)
                own = batch.iloc[q[part]]
                yield pd.DataFrame(
                    {"query_id": own["query_id"].to_numpy(), "q": own["q"].to_numpy(), "annulus": annulus[part], "cell": cell[part]}
                )

    return queries.mapInPandas(rows, "query_id long, q array<long>, annulus int, cell int")


def _search(index: Index, visits: DataFrame, placed: DataFrame, k: int) -> DataFrame:
    """The k best of each query and visited cell."""

    def best(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        rows = rows.sort_values("vec_id")
        ids = rows["vec_id"].to_numpy()
        for at in range(0, len(queries) if len(rows) else 0, 256):
            some = queries.iloc[at : at + 256]
            scores = index.scores(some["q"], rows["v"])
            order = np.argsort(-scores, axis=1, kind="stable")[:, : k + 1]
            for i, query in enumerate(some["query_id"]):
                own = order[i][ids[order[i]] != query][:k]
                out.append(pd.DataFrame({"query_id": query, "vec_id": ids[own], "score": scores[i][own]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    keys = ["annulus", "cell"]
    return visits.groupBy(*keys).cogroup(placed.groupBy(*keys)).applyInPandas(best, RESULT)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def top_k(table: DataFrame, is_query: Column, k: int = 5, scale: int = 256, pivots: int = PIVOTS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k largest inner products of each query, ties to smaller ids.

    ``is_query`` picks the queries by ``vec_id``.  A query's own id isn't its candidate.  Shorter
    vectors count as filled with zeros.  No vectors give no rows.
    """
    spark = table.sparkSession
    vectors = cut(integer_vectors(table, scale))
    built = _build(vectors, pivots)
    if built is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    index, placed = built
    queries = vectors.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    first = cut(_ranked(_search(index, _visits(index, queries, False), placed, k), k).drop("rank"))
    kth = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    open_ = queries.join(kth, "query_id", "left").withColumn("kth", F.coalesce(F.col("kth").cast("double"), F.lit(float("-inf"))))
    second = _search(index, _visits(index, open_, True), placed, k)
    return _ranked(first.union(second), k).select("query_id", "rank", "vec_id", "score")
