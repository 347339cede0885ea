"""Language ID by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a run without white space forwards and backwards and labels every
byte position.  It is trained in numpy by backpropagation through time on a bounded sample of
labelled rows.  A document's probabilities are the mean of the labels' probabilities over all
its bytes, so nothing of a text is left out: runs longer than ``RUN`` bytes are cut into several.
Since the state starts anew in each run, a run that occurs again has the same labels; a worker
keeps them, in a table of bounded size, and evaluates all new runs of a batch side by side.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noisemix.llm.common import claim, free_name, give_back, keeps, remainder, trim

RESULT = "lang_pred string, score double"
UNDETERMINED = "und"
#: Longest run of bytes that the network reads at once.
RUN = 24
#: Most labelled documents of a language, and most runs of each, that the network is fitted on.
SAMPLE_DOCS = 400
SAMPLE_RUNS = 64
#: Most languages that are learned: the most frequent ones.
MOST_LANGS = 64
HIDDEN = 16
STEPS = 300
BATCH = 384
KEPT_RUNS = 200_000
_LETTER = regex.compile(r"\p{L}")


def runs_of(text: str) -> list[bytes]:
    """The text's bytes without ASCII white space, A-Z lower-cased, in runs of ``RUN`` at most."""
    runs = text.encode("utf-8", "surrogatepass").lower().split()
    if len(max(runs, key=len, default=b"")) <= RUN:
        return runs
    return [r[i : i + RUN] for r in runs for i in range(0, len(r), RUN)]


class Model(NamedTuple):
    langs: list[str]
    weights: dict[str, np.ndarray]
    name: str


def _padded(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes by position and run, 0 behind the end, and the lengths."""
    length = np.array([len(r) for r in runs])
    wide = np.zeros((len(runs), int(length.max())), np.uint8)
    wide[np.arange(wide.shape[1]) < length[:, None]] = np.frombuffer(b"".join(runs), np.uint8)
    return wide.T.astype(np.int64), length


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _states(w: dict[str, np.ndarray], side: str, x: np.ndarray, mask: np.ndarray, trace: list | None) -> np.ndarray:
    """Hidden states by position and run; behind a run's end the state stays as it is."""
    embed, u, un = w[side + "e"], w[side + "u"], w[side + "un"]
    h = np.zeros((x.shape[1], HIDDEN), np.float32)
    out = np.empty((*x.shape, HIDDEN), np.float32)
    order = range(len(x)) if side == "f" else range(len(x) - 1, -1, -1)
    for t in order:
        a = embed[x[t]]
        zr = _sigmoid(a[:, : 2 * HIDDEN] + h @ u)
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = h @ un
        n = np.tanh(a[:, 2 * HIDDEN :] + r * c)
        m = mask[t][:, None]
        new = np.where(m, (1 - z) * n + z * h, h)
        if trace is not None:
            trace.append((t, h, z, r, c, n, m))
        h = out[t] = new
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


def label_positions(model: Model, runs: list[bytes]) -> np.ndarray:
    """Sum over its positions of the label probabilities, for each run."""
    out = np.empty((len(runs), len(model.langs)), np.float32)
    by = np.argsort([len(r) for r in runs], kind="stable")
    for at in range(0, len(runs), 4096):  # runs of about the same length together
        part = by[at : at + 4096]
        x, length = _padded([runs[i] for i in part])
        mask = np.arange(len(x))[:, None] < length
        both = np.concatenate([_states(model.weights, s, x, mask, None) for s in "fb"], -1)
        p = _softmax(both @ model.weights["o"] + model.weights["c"]) * mask[..., None]
        out[part] = p.sum(0)
    return out


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, length: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    mask = np.arange(len(x))[:, None] < length
    traces: dict[str, list] = {"f": [], "b": []}
    h = {s: _states(w, s, x, mask, traces[s]) for s in "fb"}
    both = np.concatenate([h["f"], h["b"]], -1)
    d = _softmax(both @ w["o"] + w["c"])
    d[:, np.arange(len(y)), y] -= 1
    d *= mask[..., None] / mask.sum()
    flat = d.reshape(-1, d.shape[-1])
    g = {"o": both.reshape(-1, 2 * HIDDEN).T @ flat, "c": flat.sum(0)}
    dboth = d @ w["o"].T
    for s, place in (("f", 0), ("b", HIDDEN)):
        u, un = w[s + "u"], w[s + "un"]
        ge, gu, gun = np.zeros_like(w[s + "e"]), np.zeros_like(u), np.zeros_like(un)
        carry = np.zeros((x.shape[1], HIDDEN), np.float32)
        for t, before, z, r, c, n, m in reversed(traces[s]):  # back through time
            dh = dboth[t][:, place : place + HIDDEN] + carry
            live = dh * m
            dn = live * (1 - z) * (1 - n * n)
            dz = live * (before - n) * z * (1 - z)
            dr = dn * c * r * (1 - r)
            dzr = np.concatenate([dz, dr], 1)
            dc = dn * r
            carry = np.where(m, live * z + dzr @ u.T + dc @ un.T, dh)
            gu += before.T @ dzr
            gun += before.T @ dc
            np.add.at(ge, x[t], np.concatenate([dzr, dn], 1))
        g |= {s + "e": ge, s + "u": gu, s + "un": gun}
    return g


def fit(runs: list[bytes], labels: np.ndarray, langs: list[str], steps: int = STEPS, seed: int = 7) -> Model:
    """Trains with Adam on batches drawn evenly from the languages."""
    rng = np.random.default_rng(seed)
    w = {}
    for s in "fb":
        w[s + "e"] = rng.normal(0, 0.3, (256, 3 * HIDDEN))
        w[s + "u"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 2 * HIDDEN))
        w[s + "un"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, HIDDEN))
    w["o"], w["c"] = rng.normal(0, 0.2, (2 * HIDDEN, len(langs))), np.zeros(len(langs))
    w = {k: v.astype(np.float32) for k, v in w.items()}
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    groups = [np.nonzero(labels == k)[0] for k in range(len(langs))]
    groups = [g for g in groups if len(g)]
    for step in range(1, steps + 1 if len(langs) > 1 else 1):
        pick = np.concatenate([rng.choice(g, BATCH // len(groups) + 1) for g in groups])
        x, length = _padded([runs[i] for i in pick])
        g = _gradients(w, x, length, labels[pick])
        rate = 0.02 * (1 - step / (steps + 1)) + 0.0005
        for k in w:
            first[k] += 0.1 * (g[k] - first[k])
            second[k] += 0.01 * (g[k] ** 2 - second[k])
            w[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return Model(langs, w, uuid.uuid4().hex)


def train(docs: DataFrame, doc_id: str = "doc_id") -> Model | None:
    """A model from rows whose ``crc32(doc_id) mod 5`` isn't 0; None where none is labelled.

    The sample is ``SAMPLE_DOCS`` documents a language on average, chosen by a hash of id and
    text, and of each ``SAMPLE_RUNS`` runs spread evenly over the whole text.  Counts of the
    languages are taken over all rows.
    """
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).where(
        F.coalesce(remainder(doc_id, 5) != 0, F.lit(True))
    )
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGS).collect()
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], SAMPLE_DOCS / r["count"])])
    draw = F.pmod(F.xxhash64(F.col(doc_id), "text"), F.lit(1 << 40)) / float(1 << 40)

    @F.pandas_udf("array<binary>")
    def some_runs(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            picked = []
            for text in batch:
                runs = runs_of(text)
                take = np.linspace(0, len(runs) - 1, min(SAMPLE_RUNS, len(runs))).astype(int)
                picked.append([runs[i] for i in take])
            yield pd.Series(picked, dtype=object)

    sample = (
        known.where(draw < F.try_element_at(share, F.col("lang")))
        .select("lang", draw.alias("draw"), some_runs("text").alias("runs"))
        .orderBy("draw")
        .limit(2 * SAMPLE_DOCS * len(counts))
        .collect()
    )
    langs = sorted({r["lang"] for r in sample})
    pairs = [(bytes(run), langs.index(r["lang"])) for r in sample for run in r["runs"]]
    if not pairs:
        return None
    return fit([p[0] for p in pairs], np.array([p[1] for p in pairs]), langs)


class Labeller:
    """Labels documents; keeps the labels of runs it has seen."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.sums = np.empty((0, len(self.model.langs)), np.float32)

    def learn(self, runs: Iterable[bytes]) -> None:
        fresh = [r for r in runs if r not in self.place]
        if fresh:
            start = len(self.place)
            self.place.update(zip(fresh, range(start, start + len(fresh)), strict=True))
            self.sums = np.concatenate([self.sums, label_positions(self.model, fresh)])

    def label(self, texts: Iterable[str | None]) -> Iterator[tuple[str, float]]:
        """The language with the highest pooled probability, the first by name in a tie."""
        held: list[list[bytes] | None] = []
        size = 0
        for text in texts:
            held.append(runs_of(text) if text is not None and _LETTER.search(text) else None)
            size += len(held[-1] or ())
            if size > 300_000:
                yield from self._pool(held)
                held, size = [], 0
        yield from self._pool(held)

    def _pool(self, held: list[list[bytes] | None]) -> Iterator[tuple[str, float]]:
        if len(self.place) > KEPT_RUNS:
            self.forget()
        self.learn({r for runs in held if runs for r in runs})
        for runs in held:
            if not runs:
                yield UNDETERMINED, 0.0
                continue
            at = np.fromiter(map(self.place.__getitem__, runs), np.int64, len(runs))
            total = self.sums[at].sum(0, dtype=np.float64)
            best = int(total.argmax())
            yield self.model.langs[best], float(total[best] / total.sum())


_LABELLERS: dict[str, Labeller] = {}
keeps("langid", _LABELLERS.clear)


def _labeller(model: Model) -> Labeller:
    if model.name not in _LABELLERS:
        _LABELLERS.clear()
        _LABELLERS[model.name] = Labeller(model)
    return _LABELLERS[model.name]


def predict(model: Model | None) -> Column:
    """``lang_pred`` and ``score`` of the column ``text``.

    ``und`` with score 0 where the text is null or has no letter, and for every text where there
    was nothing to learn from.
    """

    @F.pandas_udf(RESULT)
    def label(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        claim("langid")
        for batch in texts:
            found = [(UNDETERMINED, 0.0)] * len(batch) if model is None else list(_labeller(model).label(batch))
            yield pd.DataFrame(found, columns=["lang_pred", "score"])
            trim()
        if model is not None:
            _labeller(model).forget()
        give_back()

    return label.asNondeterministic()("text")


def identify(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``; language, source and id are no inputs of a prediction."""
    found = docs.select(
        "doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), predict(train(docs)).alias("p")
    )
    return found.select("doc_id", "held_out", "p.*")


def keep_identified(docs: DataFrame, least: float = 0.35) -> DataFrame:
    """Rows whose language the model can tell: not ``und``, and a score of at least ``least``."""
    name = free_name(docs, "predicted")
    found = docs.withColumn(name, predict(train(docs)))
    told = (F.col(name)["lang_pred"] != UNDETERMINED) & (F.col(name)["score"] >= least)
    return found.where(told).drop(name)
