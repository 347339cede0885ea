"""Corpus metrics.  Each one sums sufficient statistics of single pairs, then finishes."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noisemix.functions import edits, text
from noisemix.functions.draws import let
from noisemix.functions.ngrams import bleu_counts


def _sides(pairs: DataFrame, by: list[str], hyp: Column, ref: Column) -> DataFrame:
    """``_h`` and ``_r`` of every pair; a NULL side has no words, and the pair stays."""
    nothing = F.array().cast("array<string>")
    return pairs.select(*by, F.coalesce(hyp, nothing).alias("_h"), F.coalesce(ref, nothing).alias("_r"))


UNITS = {
    "word": text.tokenise_13a,
    "token": text.tokens,
    "char": text.characters,
}


def _mean_log(precisions: list[Column]) -> Column:
    total = precisions[0]
    for p in precisions[1:]:
        total = total + p
    return total / len(precisions)


class Metric(NamedTuple):
    """A corpus metric as sums over pairs."""

    #: what a pair adds, a struct, from the units of both sides
    pair: Callable[[Column, Column], Column]
    #: how that is added up
    sums: dict[str, Callable[[Column], Column]]
    #: what the sums give
    scores: Callable[[dict[str, Column]], dict[str, Column]]


def corpus_scores(
    pairs: DataFrame, by: list[str], hyp: Column, ref: Column, metrics: list[Metric], keep_sums: bool = False
) -> DataFrame:
    """Several metrics from one scan, one split into units and one aggregate; their sums too if need be.

    A NULL side has no words.  Without any pair there is no row.
    """
    columns = [f"_{i}" for i in range(len(metrics))]
    units = _sides(pairs, by, hyp, ref)
    added = units.select(*by, *[m.pair(F.col("_h"), F.col("_r")).alias(c) for c, m in zip(columns, metrics, strict=True)])
    named = [(m, c, {k: f"{c}_{k}" for k in m.sums}) for c, m in zip(columns, metrics, strict=True)]
    summed = added.groupBy(*by).agg(*[m.sums[k](F.col(c)).alias(n) for m, c, names in named for k, n in names.items()])
    out = []
    for m, _, names in named:
        of = {k: F.col(n) for k, n in names.items()}
        kept = [of[k].alias(k) for k in of if not k.startswith("_")] if keep_sums else []
        out += kept + [v.alias(k) for k, v in m.scores(of).items()]
    return summed.select(*by, *out)


def _rate(name: str, pair: Callable[[Column, Column], Column]) -> Metric:
    """Edits for a hundred reference words."""
    sums = {
        "edits": lambda s: F.sum(s["edits"]).cast("long"),
        "ref_words": lambda s: F.sum(s["words"]).cast("long"),
    }
    return Metric(
        lambda h, r: F.struct(pair(h, r).alias("edits"), F.size(r).alias("words")),
        sums,
        lambda of: {name: F.round(F.try_divide(of["edits"] * 100.0, of["ref_words"]), 6)},
    )


def bleu(smooth: bool = False, max_n: int = 4) -> Metric:
    """BLEU, one reference per sentence.

    With ``smooth``, an order without any match counts as half, a quarter, ... of one match.
    """
    sums = {"hyp_len": lambda s: F.sum(s["hyp_len"]), "ref_len": lambda s: F.sum(s["ref_len"])}
    for n in range(max_n):
        sums[f"match_{n + 1}"] = lambda s, n=n: F.sum(s["match"][n])
    for n in range(max_n):
        sums[f"total_{n + 1}"] = lambda s, n=n: F.sum(s["total"][n])

    def scores(of: dict[str, Column]) -> dict[str, Column]:
        zeros, logs = F.lit(0), []
        for n in range(1, max_n + 1):
            match = of[f"match_{n}"]
            zeros = zeros + F.when(match == 0, 1).otherwise(0)
            share = F.when(match > 0, match.cast("double"))
            if smooth:
                share = F.coalesce(share, F.pow(F.lit(0.5), zeros))
            logs.append(F.log(F.try_divide(share, of[f"total_{n}"])))
        brevity = (
            F.when(of["hyp_len"] == 0, 0.0)
            .when(of["hyp_len"] < of["ref_len"], F.exp(1 - of["ref_len"] / of["hyp_len"]))
            .otherwise(1.0)
        )
        # an order with no match and no smoothing, or with nothing to match, makes the score 0
        score = F.coalesce(100.0 * brevity * F.exp(_mean_log(logs)), F.lit(0.0))
        return {"brevity": F.round(brevity, 6), "bleu": F.round(score, 6)}

    return Metric(lambda h, r: bleu_counts(h, r, max_n), sums, scores)


def corpus_bleu(
    pairs: DataFrame,
    by: list[str],
    hyp: Column,
    ref: Column,
    smooth: bool = False,
    max_n: int = 4,
) -> DataFrame:
    """Corpus BLEU over unit arrays and the counts behind it."""
    return corpus_scores(pairs, by, hyp, ref, [bleu(smooth, max_n)], keep_sums=True)


def _crossing(hyp: Column, ref: Column) -> list[Column]:
    # equal pairs need no edits: they cross to Python as empty lists
    return [F.when(hyp != ref, c).otherwise(F.array().cast("array<string>")) for c in (hyp, ref)]


@F.arrow_udf(T.IntegerType())
def _word_errors(hyp: pa.Array, ref: pa.Array) -> pa.Array:
    return edits.batch_distances(hyp, ref)


def word_errors(hyp: Column, ref: Column) -> Column:
    """Word-level edit distance without moves, of an Arrow batch of pairs side by side."""
    return _word_errors(*_crossing(hyp, ref))


WER = _rate("wer", word_errors)


def corpus_wer(pairs: DataFrame, by: list[str], hyp: Column, ref: Column) -> DataFrame:
    return corpus_scores(pairs, by, hyp, ref, [WER], keep_sums=True)


@F.arrow_udf(T.IntegerType())
def _shift_edits(hyp: pa.Array, ref: pa.Array) -> pa.Array:
    return edits.batch_shift_edits(hyp, ref)


def _moved(hyp: Column, ref: Column) -> Column:
    return _shift_edits(*_crossing(hyp, ref))


TER = _rate("ter", _moved)


def corpus_ter(pairs: DataFrame, by: list[str], hyp: Column, ref: Column) -> DataFrame:
    """Translation edit rate: edits and phrase moves per reference word."""
    return corpus_scores(pairs, by, hyp, ref, [TER], keep_sums=True)


_ALIGNED = T.StructType(
    [T.StructField("matches", T.IntegerType()), T.StructField("chunks", T.IntegerType())]
)


@F.pandas_udf(_ALIGNED)
def _exact_alignment(hyp: pd.Series, ref: pd.Series) -> pd.DataFrame:
    found = [edits.exact_alignment(list(h), list(r)) for h, r in zip(hyp, ref, strict=True)]
    return pd.DataFrame(found, columns=["matches", "chunks"], dtype="int32")


def _meteor_pair(hyp: Column, ref: Column) -> Column:
    lower = [F.transform(units, F.lower) for units in (hyp, ref)]
    return F.struct(_exact_alignment(*lower).alias("a"), F.size(hyp).alias("h"), F.size(ref).alias("r"))


def _meteor_score(s: Column) -> Column:
    m = s["a"]["matches"].cast("double")
    precision, recall = F.try_divide(m, s["h"]), F.try_divide(m, s["r"])
    fmean = F.try_divide(precision * recall, 0.9 * precision + 0.1 * recall)
    penalty = 0.5 * F.pow(F.try_divide(s["a"]["chunks"], m), F.lit(3.0))
    return F.when(m > 0, fmean * (1 - penalty)).otherwise(0.0)


#: Mean of pairs, of the exact-match stage (alpha 0.9, beta 3, gamma 0.5), lower-cased.
METEOR = Metric(
    _meteor_pair,
    {
        "matches": lambda s: F.sum(s["a"]["matches"]),
        "chunks": lambda s: F.sum(s["a"]["chunks"]),
        "_mean": lambda s: F.avg(_meteor_score(s)),
    },
    lambda of: {"meteor": F.round(of["_mean"] * 100.0, 6)},
)


def corpus_meteor(pairs: DataFrame, by: list[str], hyp: Column, ref: Column) -> DataFrame:
    return corpus_scores(pairs, by, hyp, ref, [METEOR], keep_sums=True)


_BLOCK = 64


_BEST = T.StructType(
    [
        T.StructField(f"{side}_{field}", T.ArrayType(kind()))
        for side in ("hyp", "ref")
        for field, kind in (("pos", T.IntegerType), ("best", T.DoubleType))
    ]
)


@F.pandas_udf(_BEST)
def _best_cosines(
    hyp_pos: pd.Series, hyp_vec: pd.Series, ref_pos: pd.Series, ref_vec: pd.Series
) -> pd.DataFrame:
    rows = []
    for hp, hv, rp, rv in zip(hyp_pos, hyp_vec, ref_pos, ref_vec, strict=True):
        cosines = np.stack(hv).astype("float64") @ np.stack(rv).astype("float64").T
        rows.append((hp, cosines.max(axis=1), rp, cosines.max(axis=0)))
    return pd.DataFrame(rows, columns=["hyp_pos", "hyp_best", "ref_pos", "ref_best"])


def embedding_score(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Greedy maximum-cosine precision, recall and F1 per sentence.

    ``vectors(keys, side, pos, vec)`` with side ``hyp`` or ``ref``.  Sentences are cut into
    blocks of 64 tokens, blocks meet block by block and the maxima of all blocks are
    combined, so no task ever holds more than two blocks of one sentence.  A vector of
    length 0 is like no other: its cosines are 0.
    """
    doubles = F.transform("vec", lambda x: x.cast("double"))
    unit = let(
        doubles,
        lambda v: let(
            F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)),
            lambda norm: F.transform(v, lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0))),
        ),
    )

    def blocks(side: str) -> DataFrame:
        token = F.struct(F.col("pos").cast("int").alias("pos"), unit.alias("vec"))
        return (
            vectors.filter(F.col("side") == side)
            .groupBy(*keys, F.floor(F.col("pos") / _BLOCK).alias(f"{side}_block"))
            .agg(F.sort_array(F.collect_list(token)).alias("t"))
            .select(
                *keys,
                f"{side}_block",
                F.col("t.pos").alias(f"{side}_pos"),
                F.col("t.vec").alias(f"{side}_vec"),
            )
        )

    met = (
        blocks("hyp")
        .join(blocks("ref"), keys)
        .select(*keys, _best_cosines("hyp_pos", "hyp_vec", "ref_pos", "ref_vec").alias("b"))
    )

    sides = F.array(
        *[
            F.struct(
                F.lit(s).alias("side"), F.arrays_zip(f"b.{s}_pos", f"b.{s}_best").alias("found")
            ).cast("struct<side:string,found:array<struct<pos:int,best:double>>>")
            for s in ("hyp", "ref")
        ]
    )
    best = (
        met.select(*keys, F.inline(sides))
        .select(*keys, "side", F.inline("found"))
        .groupBy(*keys, "side", "pos")
        .agg(F.max("best").alias("best"))
    )
    scored = best.groupBy(*keys).agg(
        F.avg(F.when(F.col("side") == "hyp", F.col("best"))).alias("p"),
        F.avg(F.when(F.col("side") == "ref", F.col("best"))).alias("r"),
    )
    return scored.select(
        *keys,
        F.round("p", 6).alias("precision"),
        F.round("r", 6).alias("recall"),
        F.round(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), 6).alias("f1"),
    )


def score_matrix(
    scores: DataFrame, metrics: list[str], sets: tuple[str, str] = ("ref", "l2")
) -> DataFrame:
    """Systems by evaluation sets, and how much each metric drops from the first set to the second."""
    wide = scores.groupBy("system").agg(
        *[
            F.max(F.when(F.col("eval_set") == s, F.col(m))).alias(f"{s}_{m}")
            for s in sets
            for m in metrics
        ]
    )
    clean, noisy = sets
    gaps = [
        F.round(F.col(f"{clean}_{m}") - F.col(f"{noisy}_{m}"), 6).alias(f"gap_{m}") for m in metrics
    ]
    return wide.select("*", *gaps)
