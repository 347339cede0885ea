"""Secret scans: every rule in one pass over the bytes of a text.

All rules are compiled into one minimal automaton whose transition array is walked once per
text.  Where it accepts, the rule's reversed automaton walks back to the start of the match and
its own forward automaton to the end; both only touch the bytes of the match.  Matches of one
kind are leftmost, as long as possible and don't overlap; kinds may overlap each other.  A match
that fails its rule's length is dropped, and its bytes stay consumed for that kind.

The first accepted end belongs to the leftmost match as long as no match of a rule lies
strictly inside what another match of the same rule needs to be accepted; that holds for the
rules here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noisemix.llm.automaton import Automaton, compile_rules, parse, reverse
from noisemix.llm.common import claim, give_back, trim

#: Texts of a batch that are held as Python strings.
TEXTS_HELD = 256

Span = tuple[int, int, int]


class Rule(NamedTuple):
    """``head`` then ``body``; the body needs ``least`` bytes for the match to count."""

    kind: str
    head: str
    body: str
    least: int


#: The three kinds of the contract.
BASE = (
    Rule("assign", "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?", "[A-Za-z0-9+/_.=-]+", 6),
    Rule("access", "AKIA", "[A-Z0-9]+", 16),
    # A run of less than 24 is dropped anyway, so the automaton need not accept it.
    Rule("hex", "", "[0-9a-f]{24,}", 24),
)
#: Further kinds, after the base ones in the order of a tie.
MORE = (
    Rule("pem", "-----BEGIN [A-Z0-9 ]*", "PRIVATE KEY-----", 1),
    Rule("forge", "gh[pousr]_", "[A-Za-z0-9]+", 36),
    Rule("chat", "xox[baprs]-", "[A-Za-z0-9-]+", 10),
)
RULES = BASE + MORE
RESULT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


class _Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        nodes = [parse(r.head + r.body) for r in rules]
        self.rules = rules
        self.all = compile_rules(nodes, anywhere=True)
        self.whole = [compile_rules([x], anywhere=False) for x in nodes]
        self.back = [compile_rules([reverse(x)], anywhere=False) for x in nodes]
        self.head = [compile_rules([parse(r.head)], anywhere=False) for r in rules]

    def spans(self, data: bytes) -> list[Span]:
        """``(start, rule, end)`` in bytes, by start, then rule."""
        step, first, state = self.all.step, self.all.first_accepting, self.all.start
        accepts = self.all.accepts
        done = [0] * len(self.rules)
        out: list[Span] = []
        for at, byte in enumerate(data):
            state = step[state + byte]
            if state >= first:
                for rule in accepts[state >> 8]:
                    if at >= done[rule]:
                        self._match(data, rule, at, done, out)
        out.sort()
        return out

    def _match(self, data: bytes, rule: int, at: int, done: list[int], out: list[Span]) -> None:
        start = _last(self.back[rule], data, at, done[rule] - 1, -1)
        if start is None:
            return  # it began inside the match before
        end = _last(self.whole[rule], data, start, len(data), 1) + 1
        body = _last(self.head[rule], data, start, end, 1)
        body = start if body is None else body + 1
        if end - body >= self.rules[rule].least:
            out.append((start, rule, end))
        done[rule] = end


def _last(automaton: Automaton, data: bytes, at: int, stop: int, way: int) -> int | None:
    """The last byte, going from ``at`` until before ``stop``, at which the automaton accepts."""
    step, first, dead, state = automaton.step, automaton.first_accepting, automaton.dead, automaton.start
    found = None
    for i in range(at, stop, way):
        state = step[state + data[i]]
        if state >= first:
            found = i
        elif state == dead:
            break
    return found


@cache
def scanner(rules: tuple[Rule, ...] = RULES) -> _Scanner:
    return _Scanner(rules)


def find_secrets(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, end exclusive; none for null."""
    data = (text or "").encode("utf-8", "surrogatepass")
    found = scanner(rules).spans(data)
    if not found:
        return []
    if len(data) == len(text):
        return [(rules[k].kind, start, end) for start, k, end in found]
    place, points, before = {}, 0, 0
    for x in sorted({x for start, _, end in found for x in (start, end)}):
        points += len(data[before:x].decode("utf-8", "surrogatepass"))
        place[x], before = points, x
    return [(rules[k].kind, place[start], place[end]) for start, k, end in found]


def redact(text: str | None) -> str | None:
    """The text with every run of overlapping spans replaced by the first span's kind."""
    out, at, covered = [], 0, -1
    for kind, start, end in find_secrets(text):
        if start >= covered:
            out += [text[at:start], f"[{kind}]"]
        covered = at = max(covered, end)
    return text if not out else "".join(out) + text[at:]


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def _digest(text: str | None) -> tuple:
    spans = find_secrets(text)
    kinds = [r.kind for r in BASE]
    base = [s for s in spans if s[0] in kinds]
    counts = [sum(s[0] == k for s in base) for k in kinds]
    return *counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)


def _column(name: str, make: Callable[[str | None], object], kind: str) -> Column:
    if kind == "string":

        @F.arrow_udf(kind)
        def one(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            claim("secrets")
            for batch in texts:
                cuts = range(0, len(batch), TEXTS_HELD)  # no more texts than these are held as Python strings
                parts = [pa.array([make(t) for t in batch.slice(at, TEXTS_HELD).to_pylist()], pa.string()) for at in cuts]
                yield pa.concat_arrays(parts) if parts else pa.array([], pa.string())
                del batch, parts
                trim()
            give_back()

    else:
        names = [x.split()[0] for x in kind.split(", ")]

        @F.pandas_udf(kind)
        def one(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            claim("secrets")
            for batch in texts:
                yield pd.DataFrame([make(t) for t in batch], columns=names)

    return one.asNondeterministic()(name)


def scan_documents(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: counts by base kind, a digest of the base spans, all spans.

    A null text is empty: no spans.  An empty table gives no rows; repeated rows repeat.
    """
    found = docs.select("doc_id", _column("text", _digest, RESULT).alias("found"))
    return found.select("doc_id", "found.*")


def redact_documents(docs: DataFrame) -> DataFrame:
    """The same rows and columns with secrets replaced and ``n_chars``, where it is there, renewed."""
    out = docs.withColumn("text", _column("text", redact, "string"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
