"""Joint subword vocabulary: character coverage, merge training, encoding, decoding."""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noisemix.functions import text
from noisemix.functions.draws import let
from noisemix.sources.checkpoints import cut
from noisemix.sources.partitions import spread

MARK = chr(0x2581)  # stands for the space before a word
COVERAGE = 0.9995  # fixed values: share of characters kept, longest piece, symbols, sentence cap
MAX_PIECE = 4
VOCABULARY = 50_000
MAX_PIECES = 512
UNKNOWN_PIECE = "<unk>"
#: Pairs that a training round looks at, and runs of symbols that it takes to the driver.
LOOK = 20_000
HELD = 200_000
# what an encoding worker keeps and makes at once
KNOWN_WORDS, ROWS_AT_ONCE = 100_000, 1000

_OPEN, _CLOSE, _GAP = "\x02", "\x03", "\x01"


def pool_text(pairs: DataFrame, src: str = "src", tgt: str = "tgt") -> DataFrame:
    """Source and target sentences as one training column."""
    return pairs.select(F.lit("src").alias("side"), text.normalise_space(F.col(src)).alias("line")).unionAll(
        pairs.select(F.lit("tgt").alias("side"), text.normalise_space(F.col(tgt)).alias("line"))
    )


def word_counts(lines: DataFrame, line: str = "line") -> DataFrame:
    """Distinct words with counts: the one pass over the whole text that training needs."""
    return (
        lines.select(F.explode(text.tokens(F.col(line))).alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def character_coverage(words: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``char, cnt, covered``: the most frequent characters up to the given share.

    Counted over distinct words, not over the text.  The final window holds one row per
    character, which Unicode bounds.
    """
    chars = (
        words.select("cnt", F.explode(text.characters(F.col("word"))).alias("char"))
        .groupBy("char")
        .agg(F.sum("cnt").alias("cnt"))
    )
    ranked = Window.orderBy(F.desc("cnt"), "char")
    before = F.sum("cnt").over(ranked.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cnt")
    total = F.sum("cnt").over(Window.partitionBy())
    return chars.select(
        "char", "cnt", (before < total * F.lit(float(coverage))).alias("covered")
    )


def word_symbols(words: DataFrame, covered: list[str]) -> DataFrame:
    """Words as wrapped symbols, broken at characters outside the alphabet: ``seg, cnt``."""
    wrapped = F.transform(
        text.characters(F.concat(F.lit(MARK), F.col("word"))),
        lambda c: F.when(
            c.isin(*covered, MARK), F.concat(F.lit(_OPEN), c, F.lit(_CLOSE))
        ).otherwise(F.lit(_GAP)),
    )
    return (
        words.select("cnt", F.explode(F.split(F.array_join(wrapped, ""), _GAP)).alias("seg"))
        .filter(F.col("seg") != "")
        .groupBy("seg")
        .agg(F.sum("cnt").alias("cnt"))
    )


def pair_counts(segments: DataFrame, max_piece: int = MAX_PIECE) -> DataFrame:
    """Adjacent symbol pairs that may still become one piece: ``l, r, cnt``."""
    symbols = F.split(F.substr("seg", F.lit(2), F.length("seg") - 2), _CLOSE + _OPEN)
    adjacent = let(
        symbols,
        lambda s: F.transform(
            F.slice(s, 2, F.size(s)),
            lambda right, i: F.struct(F.get(s, i).alias("l"), right.alias("r")),
        ),
    )
    return (
        segments.select("cnt", F.inline(adjacent))
        .filter(F.length("l") + F.length("r") <= max_piece)
        .groupBy("l", "r")
        .agg(F.sum("cnt").alias("cnt"))
    )


class Fragments:
    """Weighted symbol sequences on the driver; merges are learned and applied one by one.

    Counts are kept up by deltas: an index leads from a pair to the sequences that hold it.
    """

    def __init__(self, rows: list[tuple[list[str], int]], max_piece: int):
        self.rows, self.max_piece = rows, max_piece
        self.count: Counter[tuple[str, str]] = Counter()
        self.where: dict[tuple[str, str], set[int]] = {}
        for i, (symbols, n) in enumerate(rows):
            self._add(i, symbols, n, self.count)
        self.heap = [(-n, pair) for pair, n in self.count.items()]
        heapq.heapify(self.heap)

    def _add(self, i: int, symbols: list[str], n: int, to: Counter) -> None:
        for pair in zip(symbols, symbols[1:]):
            if len(pair[0]) + len(pair[1]) <= self.max_piece:
                to[pair] += n
                self.where.setdefault(pair, set()).add(i)

    def best(self) -> tuple[int, tuple[str, str]] | None:
        """Count and symbols of the most frequent pair, the first in order of those; None without pairs."""
        while self.heap:
            n, pair = self.heap[0]
            if self.count.get(pair) == -n:
                return -n, pair
            heapq.heappop(self.heap)
        return None

    def merge(self, pair: tuple[str, str]) -> None:
        change: Counter[tuple[str, str]] = Counter()
        for i in self.where.pop(pair):
            symbols, n = self.rows[i]
            merged = merge_pair(symbols, pair)
            if len(merged) < len(symbols):
                self._add(i, symbols, -n, change)
                self._add(i, merged, n, change)
                self.rows[i] = merged, n
        for other, n in change.items():
            if n:
                self.count[other] += n
                if self.count[other] > 0:
                    heapq.heappush(self.heap, (-self.count[other], other))
                else:
                    del self.count[other]


def merge_pair(symbols: list[str], pair: tuple[str, str]) -> list[str]:
    """Merges a pair from left to right."""
    out, i = [], 0
    while i < len(symbols):
        if i + 1 < len(symbols) and symbols[i] == pair[0] and symbols[i + 1] == pair[1]:
            out.append(pair[0] + pair[1])
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return out


def _symbols(seg: str) -> list[str]:
    return seg[1:-1].split(_CLOSE + _OPEN)


def _weighted(segs: list[str], counts: list[int]) -> pd.DataFrame:
    return pd.DataFrame({"seg": pd.Series(segs, dtype=object), "cnt": pd.Series(counts, dtype="int64")})


def fragments(segments: DataFrame, pairs: set[tuple[str, str]]) -> DataFrame:
    """``seg, cnt``: runs of symbols in which every two neighbours are one of the pairs, summed up."""
    shared = segments.sparkSession.sparkContext.broadcast(pairs)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = shared.value
        for batch in batches:
            found: Counter[str] = Counter()
            for seg, n in zip(batch["seg"], batch["cnt"].tolist(), strict=True):
                symbols = _symbols(seg)
                first = 0
                for i in range(1, len(symbols) + 1):
                    if i == len(symbols) or (symbols[i - 1], symbols[i]) not in held:
                        if i - first > 1:
                            found[_CLOSE.join(symbols[first:i])] += n
                        first = i
            yield _weighted(list(found), list(found.values()))

    found = segments.select("seg", "cnt").mapInPandas(rows, "seg string, cnt long")
    return found.groupBy("seg").agg(F.sum("cnt").alias("cnt"))


def apply_merges(segments: DataFrame, merges: list[tuple[str, str]], max_piece: int = MAX_PIECE) -> DataFrame:
    """Segments after the merges, one after another; those in which nothing is left to merge go."""
    turns: dict[tuple[str, str], list[int]] = {}
    for i, pair in enumerate(merges):
        turns.setdefault(pair, []).append(i)
    shared = segments.sparkSession.sparkContext.broadcast(turns)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = shared.value
        for batch in batches:
            open_ = {}
            for i, seg in enumerate(batch["seg"]):
                symbols = merge_in_turn(_symbols(seg), held)
                if any(len(a) + len(b) <= max_piece for a, b in zip(symbols, symbols[1:])):
                    open_[i] = _OPEN + (_CLOSE + _OPEN).join(symbols) + _CLOSE
            yield _weighted(list(open_.values()), batch["cnt"].iloc[list(open_)].tolist())

    return segments.select("seg", "cnt").mapInPandas(rows, "seg string, cnt long")


def merge_in_turn(symbols: list[str], turns: dict[tuple[str, str], list[int]]) -> list[str]:
    """Applies numbered merges in the order of their numbers; none has a second turn."""
    now = 0
    while len(symbols) > 1:
        coming = []
        for pair in zip(symbols, symbols[1:]):
            numbers = turns.get(pair)
            if numbers and numbers[-1] >= now:
                coming.append((numbers[bisect_left(numbers, now)], pair))
        if not coming:
            break
        turn, pair = min(coming)
        symbols, now = merge_pair(symbols, pair), turn + 1
    return symbols


def train_merges(
    words: DataFrame,
    covered: list[str],
    vocabulary: int = VOCABULARY,
    max_piece: int = MAX_PIECE,
    look: int = LOOK,
    held: int = HELD,
) -> DataFrame:
    """Learn merges until the vocabulary is full or no pair is left: ``rank, l, r, cnt``.

    The vocabulary holds the alphabet, one symbol for unknown characters and the pieces that were
    made.  The result is that of merging the most frequent pair, the first in order of those, again
    and again.

    A round looks at the ``look`` most frequent pairs.  Let ``rest`` be the count of the next one.
    Pairs that don't belong to the list never get above ``rest``: counts of old pairs only fall, and
    wherever a new pair stands, the two symbols in its middle were a pair before.  So every merge
    above ``rest`` happens inside runs of symbols whose neighbours are pairs of the list.  Such runs are
    short and repeat; summed up over all words they come to the driver, which learns every merge above
    ``rest`` from them, with counts kept up by deltas.  If there are more than ``held`` runs, the
    round looks at fewer pairs; the runs of one pair are no more than the longest word is long.  Words
    are then rewritten to reliable storage, without those that are done.  So a round is two passes over
    distinct words and learns hundreds of merges, and a lost executor costs a part of one pass.

    A list that ends among pairs of equal counts takes all of them if ``look`` allows; else pairs of
    that count are merged from the top as far as no two share a symbol (``independent_prefix``).
    """
    spark = words.sparkSession
    state = spread(cut(word_symbols(words, covered)))
    learned: list[tuple[int, str, str, int]] = []
    pieces = {UNKNOWN_PIECE, MARK, *covered}
    most = look

    def full() -> bool:
        return len(pieces) >= vocabulary

    def learn(pair: tuple[str, str], n: int) -> None:
        learned.append((len(learned), *pair, n))
        pieces.add("".join(pair))

    while not full():
        order = [F.desc("cnt"), "l", "r"]
        top = pair_counts(state, max_piece).orderBy(*order).limit(look + 1).collect()
        if not top:
            break
        known = len(learned)
        chosen, rest = frequent_pairs(top, most, len(top) <= look)
        runs = None
        while chosen:
            found = cut(fragments(state, {(p.l, p.r) for p in chosen}))
            if found.count() <= held:
                runs = Fragments([(r.seg.split(_CLOSE), r.cnt) for r in found.collect()], max_piece)
                break
            most = max(1, len(chosen) // 4)
            fewer, rest = frequent_pairs(top, most, len(top) <= look)
            chosen = fewer if len(fewer) < len(chosen) else []  # pairs of one count can't be parted
        if runs is None:
            for p in independent_prefix(top, len(top) <= look):
                if not full():
                    learn((p.l, p.r), p.cnt)
        else:
            most = min(look, 2 * most)
            while not full() and (best := runs.best()) and best[0] > rest:
                learn(best[1], best[0])
                runs.merge(best[1])
        state = cut(apply_merges(state, [m[1:3] for m in learned[known:]], max_piece))
    return spark.createDataFrame(learned, "rank int, l string, r string, cnt long")


def frequent_pairs(top: list, most: int, complete: bool) -> tuple[list, int]:
    """The first pairs of a sorted list, cut between different counts, and the count behind the cut.

    About ``most`` pairs: the count at that place is taken whole, or left out if the list ends in it.
    ``complete`` says that there are no further pairs.
    """
    border = top[min(most, len(top)) - 1].cnt
    chosen = [p for p in top if p.cnt >= border]
    if len(chosen) < len(top):
        return chosen, top[len(chosen)].cnt
    return (top, 0) if complete else ([p for p in top if p.cnt > border], border)


def _overlaps(pair, symbols: set[str]) -> bool:
    return pair.l in symbols or pair.r in symbols


def independent_prefix(top: list, complete: bool) -> list:
    """How far down a sorted pair list merging all at once equals merging one by one.

    Merging (a, b) can only create pairs out of pairs that contain a or b, and none of them
    gets more frequent than the pair it came from.  So while the next pair shares no symbol
    with the ones before it, and every pair that does is strictly rarer, its turn comes next.
    A pair of equal symbols overlaps itself and ends the run.
    """
    batch, used = [top[0]], {top[0].l, top[0].r}
    for i in range(1, len(top)):
        pair = top[i]
        last = batch[-1]
        tied = [q for q in top[i:] if q.cnt == pair.cnt]
        cut_tie = not complete and top[-1].cnt == pair.cnt
        if last.l == last.r or cut_tie or any(_overlaps(q, used) for q in tied):
            break
        batch.append(pair)
        used |= {pair.l, pair.r}
    return batch


def _merge_word(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """Pieces of one word: the best-ranked adjacent pair is merged until none is left."""
    pieces = list(word)
    while len(pieces) > 1:
        best = min(zip(pieces, pieces[1:]), key=lambda pair: ranks.get(pair, len(ranks)))
        if best not in ranks:
            break
        pieces = merge_pair(pieces, best)
    return pieces


def encode(df: DataFrame, merges: DataFrame, line: str, out: str = "pieces") -> DataFrame:
    """Add the subword pieces of a text column; narrow, no shuffle.

    The merge table is bounded by the vocabulary size and goes to every task; each task
    remembers the words it has met, so frequent words are worked out once per task.
    """
    table = {(m.l, m.r): m.rank for m in merges.select("rank", "l", "r").orderBy(F.desc("rank")).collect()}
    shared = df.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ranks, known, same = shared.value, {}, {}

        def one(line: str | None) -> list[str] | None:
            if line is None:
                return None
            out: list[str] = []
            for word in line.split(" "):
                if word not in known:
                    if len(known) >= KNOWN_WORDS:
                        known.clear()
                        same.clear()
                    # one copy of a piece for all words
                    known[word] = tuple(same.setdefault(p, p) for p in _merge_word(MARK + word, ranks)) if word else ()
                out += known[word]
            return out

        for batch in batches:
            for start in range(0, len(batch), ROWS_AT_ONCE):
                yield batch.iloc[start : start + ROWS_AT_ONCE].map(one)

    return df.withColumn(out, pieces(text.normalise_space(F.col(line))))


def pieces_to_text(pieces: Column) -> Column:
    """Subword pieces back to text."""
    return F.trim(F.replace(F.array_join(pieces, ""), F.lit(MARK), F.lit(" ")))


def within_limits(
    src_pieces: Column, tgt_pieces: Column, longest: int = MAX_PIECES
) -> Column:
    """Neither side has more than ``longest`` pieces."""
    return (F.size(src_pieces) <= longest) & (F.size(tgt_pieces) <= longest)
