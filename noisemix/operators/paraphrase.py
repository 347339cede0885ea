"""Hook for an external paraphraser."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Paraphraser = Callable[[list[str]], list[list[str]]]

# what a call gets and what is sent on at once: a line of many sentences has a rewrite as long as itself for each
CALL_LINES = 1000
CALL_CHARACTERS = 1 << 18
OUT_CHARACTERS = 1 << 23


def candidates_from(
    lines: DataFrame, paraphraser: Paraphraser, keys: list[str], line: str = "src"
) -> DataFrame:
    """Run a user function over batches of sentences: ``keys, rank, phrase``.

    ``paraphraser`` gets a list of sentences and returns the ranked rewrites of each.  A worker holds the
    rewrites of one call, and rows of bounded size made of them.
    """
    chosen = lines.select(*keys, line)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema[:-1])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _parts(batch, line):
                rewritten = paraphraser(part[line].tolist())
                yield from _rows(part[keys], rewritten)

    return chosen.mapInPandas(run, f"{schema}, rank int, phrase string")


def _parts(batch: pd.DataFrame, line: str) -> Iterator[pd.DataFrame]:
    """Consecutive lines with at most ``CALL_LINES`` lines and, but for a longer line alone, ``CALL_CHARACTERS``."""
    start = held = 0
    for n, size in enumerate(batch[line].str.len().fillna(0).astype(int)):
        if n > start and (n - start == CALL_LINES or held + size > CALL_CHARACTERS):
            yield batch.iloc[start:n]
            start, held = n, 0
        held += size
    if start < len(batch):
        yield batch.iloc[start:]


def _rows(named: pd.DataFrame, rewritten: list[list[str]]) -> Iterator[pd.DataFrame]:
    """Rewrites as rows, let go whenever they have ``OUT_CHARACTERS``."""
    places: list[int] = []
    ranks: list[int] = []
    phrases: list[str] = []
    held = 0

    def out() -> pd.DataFrame:
        rows = named.iloc[places].reset_index(drop=True)
        return rows.assign(rank=pd.Series(ranks, dtype="int32"), phrase=phrases)

    for place, found in enumerate(rewritten):
        for rank, phrase in enumerate(found):
            places.append(place)
            ranks.append(rank)
            phrases.append(phrase)
            held += len(phrase or "")
            if held >= OUT_CHARACTERS:
                yield out()
                places, ranks, phrases, held = [], [], [], 0
    if places:
        yield out()
