"""Clipped n-gram matches of sentence pairs, computed inside the row.

Corpus BLEU needs no n-gram shuffle: only the summed counts of each partition travel.  The matches
of an Arrow batch are counted together, by sorting integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units that are worked off at once; a longer pair goes alone.
CHUNK = 1 << 20


def _matched(units: np.ndarray, row: np.ndarray, left: np.ndarray, ref: np.ndarray, rows: int, max_n: int) -> np.ndarray:
    """Matches by row and order.

    Every unit has a number, its row, how many units of its side are left from it on, and its side.
    """
    out = np.zeros((rows, max_n), dtype=np.int64)
    if not len(units):
        return out
    kinds = int(units.max()) + 1
    # the row belongs to the gram: equal grams of different rows don't meet
    gram, grams = row.astype(np.int64), rows
    for n in range(1, max_n + 1):
        if grams * kinds >= 1 << 61:
            gram = np.unique(gram, return_inverse=True)[1].astype(np.int64)
            grams = int(gram.max()) + 1
        gram, grams = gram * kinds + units[n - 1 :][: len(gram)], grams * kinds
        enough = left[: len(gram)] >= n
        if not enough.any():
            break
        # by gram, the copies of the hypothesis first; the row is read off the first copy
        key = np.sort(gram[enough] * 2 + ref[: len(gram)][enough])
        start = np.flatnonzero(np.concatenate([[True], key[1:] >> 1 != key[:-1] >> 1]))
        copies = np.diff(np.append(start, len(key)))
        in_ref = np.add.reduceat(key & 1, start)
        shared = np.minimum(in_ref, copies - in_ref)
        found = np.flatnonzero(shared)
        if not len(found):
            break  # no longer gram matches either
        distinct = key[start[found]] >> 1
        # grams are numbered in the order of their rows: a row's grams follow each other
        firsts = _first_grams(gram, row[: len(gram)], enough)
        out[:, n - 1] += np.bincount(
            firsts[1][np.searchsorted(firsts[0], distinct, side="right") - 1], shared[found], rows
        ).astype(np.int64)
        gram = gram[: len(gram) - 1] if len(gram) > 1 else gram[:0]
        if not len(gram):
            break
    return out


def _first_grams(gram: np.ndarray, row: np.ndarray, enough: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least gram of each row that has one, ascending, and these rows."""
    gram, row = gram[enough], row[enough]
    start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    return np.minimum.reduceat(gram, start), row[start]


def clipped_matches(hyp: pa.ListArray, ref: pa.ListArray, max_n: int) -> np.ndarray:
    """Sizes of the multiset intersections of the n-grams of two arrays: a row for each pair, a column for each n."""
    sides = [hyp, ref]
    sizes = [np.diff(s.offsets.to_numpy()) for s in sides]
    values = [s.flatten() for s in sides]
    both = sizes[0] + sizes[1]
    ends, out, done = np.cumsum(both), np.zeros((len(hyp), max_n), dtype=np.int64), 0
    starts = [np.concatenate([[0], np.cumsum(s)]) for s in sizes]
    while done < len(hyp):
        before = ends[done - 1] if done else 0
        until = max(done + 1, int(np.searchsorted(ends, before + CHUNK, side="right")))
        parts = [v.slice(s[done], s[until] - s[done]) for v, s in zip(values, starts, strict=True)]
        coded = pa.concat_arrays(parts).dictionary_encode()
        units = coded.indices.fill_null(len(coded.dictionary)).to_numpy().astype(np.int64)
        # hypothesis and reference of a pair side by side
        size = np.stack([s[done:until] for s in sizes], axis=1).ravel()
        first = np.stack([starts[0][done:until] - starts[0][done], starts[1][done:until] - starts[1][done] + len(parts[0])], axis=1)
        begin = np.cumsum(size) - size
        within = np.arange(size.sum()) - np.repeat(begin, size)
        units = units[np.repeat(first.ravel(), size) + within]
        rows = until - done
        row = np.repeat(np.repeat(np.arange(rows), 2), size)
        left = np.repeat(size, size) - within
        side = np.repeat(np.tile([0, 1], rows), size)
        out[done:until] = _matched(units, row, left, side, rows, max_n)
        done = until
    return out


def _matches(max_n: int):
    @F.arrow_udf("array<int>")
    def matches(hyp: pa.Array, ref: pa.Array) -> pa.Array:
        found = clipped_matches(hyp, ref, max_n).astype(np.int32)
        return pa.ListArray.from_arrays(np.arange(0, found.size + 1, max_n, dtype=np.int32), found.ravel())

    return matches


def bleu_counts(hyp: Column, ref: Column, max_n: int = 4) -> Column:
    """``struct(match, total, hyp_len, ref_len)``, the first two as arrays over the order."""

    def total(n: int) -> Column:
        return F.greatest(F.size(hyp) - (n - 1), F.lit(0))

    totals = F.array(*[total(n) for n in range(1, max_n + 1)])
    # equal pairs match whole: they cross to Python as empty lists
    crossing = [F.when(hyp != ref, c).otherwise(F.array().cast("array<string>")) for c in (hyp, ref)]
    return F.struct(
        F.when(hyp == ref, totals).otherwise(_matches(max_n)(*crossing)).alias("match"),
        totals.alias("total"),
        F.size(hyp).alias("hyp_len"),
        F.size(ref).alias("ref_len"),
    )
