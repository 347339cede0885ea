"""SentencePiece encoding and decoding by a table of each prefix's last token.

Whatever a text's tokens are, the tokens of each of its prefixes that ends at a token are the
first of them, and every two neighbours encode as themselves when they stand alone.  So each
prefix has one last token: of the vocabulary's pieces that end there, the one that is compatible
with the last token of what stands before it.  An automaton over all pieces finds the candidates;
a pair test, which merges the characters of two tokens as the model does, tells if they stay
apart; its answers are kept.  Ids are recovered backwards from the end of the table.

A piece never continues across a blank behind another character, so a text is cut there, and the
table is built for all new words of a run of texts at once, one position after another.  Words
that were encoded before are kept, in a table of bounded size; a full one starts anew.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noisemix.llm.bpe import Ragged
from noisemix.llm.common import claim, keeps

RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"
BLANK = "▁"
#: A worker that keeps more words, or more tested pairs, than this starts anew.
KEPT_WORDS = 500_000
KEPT_PAIRS = 4_000_000
#: Words after which a run of texts ends, and encoded texts that leave a task together.
RUN_WORDS = 300_000
TEXTS_OUT = 256
#: Pairs that are tested together.
PAIRS_AT_ONCE = 20_000
#: Longer words are worked off one by one.
LONG_WORD = 64
_SEGMENT = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
#: Fixed values of the model format: kinds of pieces, and the model type "byte pairs".
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BYTE_PAIRS = 2


class Piece(NamedTuple):
    text: str
    score: float
    kind: int


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a message in the protocol-buffer wire format."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = raw[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(raw):
        key, at = number(at)
        if key & 7 == 0:
            value, at = number(at)
        else:
            size, at = number(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


def read_model(file: str) -> list[Piece]:
    """The pieces of a model file, by id.

    Only byte-pair models with byte fallback are read that take texts as they are, put one blank
    in front and write blanks as U+2581; any other file is an error.
    """
    with open(file, "rb") as f:
        model = list(_fields(f.read()))
    pieces = []
    for _, raw in (x for x in model if x[0] == 1):
        own = dict(_fields(raw))
        pieces.append(Piece(own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
    trainer, normaliser = (dict(_fields(dict(model).get(n, b""))) for n in (2, 3))
    kinds = [p.kind for p in pieces]
    expected = (
        trainer.get(3) == BYTE_PAIRS
        and not trainer.get(24, 0)  # blanks stand in front of words
        and not normaliser.get(2)  # no character map
        and normaliser.get(3, 1)
        and not normaliser.get(4, 1)
        and normaliser.get(5, 1)
        and 5 not in dict(model)  # no map back
        and set(kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE}
        and kinds.count(BYTE) == 256
        and all(BLANK not in p.text.lstrip(BLANK) for p in pieces if p.kind == NORMAL)
    )
    if not expected:
        raise ValueError(f"{file} isn't a byte-pair model with byte fallback and texts left as they are")
    return pieces


class Places:
    """Numbers keys in the order in which they are added; many keys are looked up at once."""

    def __init__(self, keys: np.ndarray):
        self.n, self.bits = 0, 10
        self._empty()
        self.add(keys)

    def _empty(self) -> None:
        self.keys, self.at = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for keys that were not added.  Keys aren't negative."""
        slot = self._slots(keys)
        seen = self.keys[slot]
        out = np.where(seen == keys, self.at[slot], -1)
        left = np.nonzero((seen != keys) & (seen >= 0))[0]
        while len(left):
            slot[left] = (slot[left] + 1) & len(self.keys) - 1
            seen = self.keys[slot[left]]
            hit = seen == keys[left]
            out[left[hit]] = self.at[slot[left[hit]]]
            left = left[~hit & (seen >= 0)]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Adds distinct keys that are not there yet."""
        number = np.arange(self.n, self.n + len(keys))
        self.n += len(keys)
        if 2 * self.n > len(self.keys):
            has = self.keys >= 0
            keys, number = np.concatenate([self.keys[has], keys]), np.concatenate([self.at[has], number])
            while 2 * self.n > 1 << self.bits:
                self.bits += 1
            self._empty()
        slot = self._slots(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]
            won = free & (self.keys[slot] == keys)
            self.at[slot[won]] = number[won]
            keys, number, slot = keys[~won], number[~won], (slot[~won] + 1) & len(self.keys) - 1


class PieceAutomaton:
    """Finds all pieces that end at a character, for many words at once."""

    def __init__(self, pieces: dict[str, int]):
        """``pieces``: ids by text."""
        self.code = np.full(0x110000, 0, np.int64)  # 0 for characters of no piece
        letters = sorted({c for text in pieces for c in text})
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        code = {c: i for i, c in enumerate(letters, 1)}
        self.width = len(letters) + 1
        step: dict[int, int] = {}
        own, fall, edges = [-1], [0], []
        for text, i in pieces.items():
            state = 0
            for c in text:
                key = state * self.width + code[c]
                if key not in step:
                    step[key] = len(own)
                    edges.append((state, code[c]))
                    own.append(-1)
                    fall.append(0)
                state = step[key]
            own[state] = i
        ends: list[list[int]] = [[] for _ in own]
        below: list[list[tuple[int, int]]] = [[] for _ in own]
        for made, (state, c) in enumerate(edges, 1):
            below[state].append((c, made))
        level = [0]
        while level:  # by length, so that shorter states are done
            deeper = []
            for state in level:
                ends[state] = ([own[state]] if own[state] >= 0 else []) + (ends[fall[state]] if state else [])
                for c, made in below[state]:
                    back = fall[state]
                    while state and back and back * self.width + c not in step:
                        back = fall[back]
                    fall[made] = step.get(back * self.width + c, 0) if state else 0
                    deeper.append(made)
            level = deeper
        keys = np.array(list(step), np.int64)
        self.steps, self.target = Places(keys), np.array(list(step.values()), np.int64)
        self.opening = np.zeros(self.width, np.int64)
        first = keys < self.width
        self.opening[keys[first]] = self.target[first]
        self.fall = np.array(fall, np.int64)
        self.ends = Ragged(np.array([x for e in ends for x in e], np.int64), np.array([len(e) for e in ends]))

    def move(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The states behind a further character."""
        out = self.opening[code]
        left = np.nonzero(state)[0]
        state = state[left]
        while len(left):
            found = self.steps.find(state * self.width + code[left])
            hit = found >= 0
            out[left[hit]] = self.target[found[hit]]
            left, state = left[~hit], self.fall[state[~hit]]
            left, state = left[state > 0], state[state > 0]
        return out


class PairTest:
    """Tells which pairs of tokens encode as themselves."""

    def __init__(self, pieces: list[Piece]):
        self.n = len(pieces)
        self.ids = {p.text: i for i, p in enumerate(pieces) if p.kind == NORMAL}
        by_score = {s: r for r, s in enumerate(sorted({p.score for p in pieces}, reverse=True))}
        merges = [
            (self.ids[t[:k]] * self.n + self.ids[t[k:]], by_score[pieces[i].score], i)
            for t, i in self.ids.items()
            for k in range(1, len(t))
            if t[:k] in self.ids and t[k:] in self.ids
        ]
        keys, self.rank, self.made = np.array(merges, np.int64).reshape(-1, 3).T
        self.merges = Places(keys)
        longest = max(map(len, self.ids))
        #: The characters of each token; a character that is no piece is in no piece either.
        self.spelled = np.full((self.n + 1, longest), -1, np.int64)
        for t, i in self.ids.items():
            if all(c in self.ids for c in t):
                self.spelled[i, : len(t)] = [self.ids[c] for c in t]
        self.length = (self.spelled >= 0).sum(1)
        self.forget()

    def forget(self) -> None:
        self.known, self.apart = Places(np.zeros(0, np.int64)), np.zeros(0, bool)

    def _merge_of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of the merge of two symbols; no merge has a rank above all others."""
        key = np.where((left < 0) | (right < 0), self.n * self.n, left * self.n + right)
        at = self.merges.find(key.ravel()).reshape(key.shape)
        return np.where(at < 0, self.n, self.rank[at]), np.where(at < 0, -1, self.made[at])

    def stay_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merges the characters of both tokens, best and leftmost pair first, all rows at once.

        ``left`` is -1 for a token that stands alone.
        """
        width = 2 * self.spelled.shape[1] + 1
        row = np.arange(len(right))
        symbols = np.full((len(right), width), -1, np.int64)
        size = np.where(left < 0, 0, self.length[left])
        symbols[:, : width // 2] = np.where((left < 0)[:, None], -1, self.spelled[left])
        symbols[row[:, None], size[:, None] + np.arange(width // 2)] = self.spelled[right]
        rank, made = self._merge_of(symbols[:, :-1], symbols[:, 1:])
        spelled = (left < 0) | (self.length[left] > 0) & (self.length[right] > 0)
        place = np.arange(width - 1)
        while True:
            best = rank.argmin(1)
            open_ = np.nonzero(rank[row, best] < self.n)[0]
            if not len(open_):
                break
            best = best[open_][:, None]
            some, its_rank, its_made = symbols[open_], rank[open_], made[open_]
            lone = np.arange(len(open_))
            some[lone, best[:, 0]] = its_made[lone, best[:, 0]]
            keep = np.where(place > best, place + 1, place)  # what stands behind moves up
            some[:, :-1] = np.take_along_axis(some, keep, 1)
            some[:, -1] = -1
            keep = np.minimum(np.where(place > best, place + 1, place), width - 2)
            its_rank, its_made = np.take_along_axis(its_rank, keep, 1), np.take_along_axis(its_made, keep, 1)
            its_rank[:, -1], its_made[:, -1] = self.n, -1
            for beside in (best[:, 0] - 1, best[:, 0]):
                at = np.maximum(beside, 0)
                r, m = self._merge_of(some[lone, at], some[lone, at + 1])
                inside = beside >= 0
                its_rank[lone[inside], at[inside]], its_made[lone[inside], at[inside]] = r[inside], m[inside]
            symbols[open_], rank[open_], made[open_] = some, its_rank, its_made
        alone = (symbols[:, 0] == right) & (symbols[:, 1] < 0)
        both = (symbols[:, 0] == left) & (symbols[:, 1] == right) & (symbols[:, 2] < 0)
        return spelled & np.where(left < 0, alone, both)

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For pairs of tokens; -1 on the left stands for the start, the id ``n`` for an unknown character."""
        left = np.where(left == self.n, -1, left)  # what follows an unknown character starts anew
        key = (left + 1) * (self.n + 1) + right
        at = self.known.find(key)
        if (at < 0).any():
            fresh = np.unique(key[at < 0])
            parts = np.split(fresh, range(PAIRS_AT_ONCE, len(fresh), PAIRS_AT_ONCE))
            found = [self.stay_apart(x // (self.n + 1) - 1, x % (self.n + 1)) for x in parts]
            self.known.add(fresh)
            self.apart = np.concatenate([self.apart, *found])
            at = self.known.find(key)
        return (right == self.n) | self.apart[at]


class Encoder:
    """Encodes and decodes as the model file says; keeps what it has encoded."""

    def __init__(self, file: str):
        pieces = read_model(file)
        self.n = len(pieces)
        self.test = PairTest(pieces)
        self.begin, self.end = (next(i for i, p in enumerate(pieces) if p.kind == CONTROL and p.text == t) for t in ("<s>", "</s>"))
        self.byte = np.array([i for i, p in enumerate(pieces) if p.kind == BYTE], "<u4")  # in the order of bytes
        self.pieces = PieceAutomaton(self.test.ids)
        self.length = np.array([len(p.text) if p.kind == NORMAL else 0 for p in pieces] + [1])
        place = {int(i): bytes([b]) for b, i in enumerate(self.byte)}
        shown = {NORMAL: lambda p: p.text.replace(BLANK, " "), UNKNOWN: lambda p: " ⁇ ", CONTROL: lambda p: ""}
        spelled = [place[i] if p.kind == BYTE else shown[p.kind](p).encode() for i, p in enumerate(pieces)]
        self.is_byte = np.array([p.kind == BYTE for p in pieces])
        self.opens = np.array([p.kind == NORMAL and p.text.startswith(BLANK) for p in pieces])
        self.spelled = Ragged(np.frombuffer(b"".join(spelled), np.uint8), np.array([len(x) for x in spelled]))
        self.forget()

    def forget(self) -> None:
        self.kept: dict[str, int] = {}
        self.answers: dict[tuple[int, int], bool] = {}  # of the pair test, and steps of the automaton,
        self.steps: dict[tuple[int, int], int] = {}  # that long words asked for
        self.ids = Ragged(np.zeros(0, "<u4"), np.zeros(0, np.int64))

    def table(self, words: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
        """Characters of all words in a row, the last token of each prefix, and where words begin.

        Ids of pieces; ``n`` for a character of no piece.
        """
        text = "".join(words)
        code = self.pieces.code[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        size = np.fromiter(map(len, words), np.int64, len(words))
        begins = np.cumsum(size) - size
        order = np.argsort(-size, kind="stable")
        begin, size = begins[order], size[order]
        table = np.full(len(code), -1, np.int64)
        state = np.zeros(len(words), np.int64)
        for depth in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -depth, "left"))  # words that have a character here
            at = begin[:n] + depth
            state = self.pieces.move(state[:n], code[at])
            token, per = self.pieces.ends.take(state)
            strange = np.nonzero(code[at] == 0)[0]
            word = np.concatenate([np.repeat(np.arange(n), per), strange])
            token = np.concatenate([token, np.full(len(strange), self.n)])
            before = depth - self.length[token]
            left = np.where(before < 0, -1, table[begin[word] + before])
            usable = np.nonzero((before < 0) | (left >= 0))[0]
            left, token, word = left[usable], token[usable], word[usable]
            fits = self.test.compatible(left, token)
            table[at[word[fits]]] = token[fits]
        return text, table, begins

    def learn(self, fresh: list[str]) -> None:
        """Encodes new words and keeps them."""
        if self.test.known.n > KEPT_PAIRS:
            self.test.forget()
            self.answers.clear()
        short = [w for w in fresh if len(w) <= LONG_WORD]
        long = [w for w in fresh if len(w) > LONG_WORD]
        if short:
            text, table, begins = self.table(short)
            ends = np.append(begins[1:], len(text)) - 1
            self._keep(short, *self._backwards(text, table, begins, ends))
        for word in long:
            self._keep([word], *self._one(word))

    def _backwards(self, text: str, table: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in a row and how many each has, from the ends of the words to their starts."""
        at, of = ends, np.arange(len(ends))
        places, words = [], []
        while len(at):
            places.append(at)
            words.append(of)
            at = at - self.length[table[at]]
            more = at >= begins[of]
            at, of = at[more], of[more]
        if not places:
            return np.zeros(0, "<u4"), np.zeros(len(ends), np.int64)
        place = np.sort(np.concatenate(places))
        word = np.searchsorted(begins, place, "right") - 1
        return self._with_bytes(text, table[place], place, word, len(ends))

    def _with_bytes(self, text: str, token: np.ndarray, place: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Unknown characters become the tokens of their bytes."""
        strange = np.nonzero(token == self.n)[0]
        if len(strange):
            raw = [text[p].encode("utf-8", "surrogatepass") for p in place[strange]]
            times = np.ones(len(token), np.int64)
            times[strange] = [len(x) for x in raw]
            spread = np.repeat(token, times)
            spread[spread == self.n] = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
            token, word = spread, np.repeat(word, times)
        return token.astype("<u4"), np.bincount(word, minlength=n)

    def _one(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        """A long word: the same table, position by position, in time linear in its length."""
        code = self.pieces.code[np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)].tolist()
        table = np.full(len(word), self.n, np.int64)
        answers, steps = self.answers, self.steps
        state = 0
        for at, c in enumerate(code):
            if (state, c) not in steps:
                steps[state, c] = int(self.pieces.move(np.array([state]), np.array([c]))[0])
            state = steps[state, c]
            start = self.pieces.ends.start[state]
            for token in self.pieces.ends.flat[start : start + self.pieces.ends.length[state]].tolist():
                before = at - int(self.length[token])
                left = -1 if before < 0 or table[before] == self.n else int(table[before])
                if (left, token) not in answers:
                    answers[left, token] = bool(self.test.compatible(np.array([left]), np.array([token]))[0])
                if answers[left, token]:
                    table[at] = token
                    break
        places, at = [], len(word) - 1
        while at >= 0:
            places.append(at)
            at -= int(self.length[table[at]])
        place = np.array(places[::-1], np.int64)
        return self._with_bytes(word, table[place], place, np.zeros(len(place), np.int64), 1)

    def _keep(self, words: list[str], flat: np.ndarray, per: np.ndarray) -> None:
        at = len(self.kept)
        self.kept.update(zip(words, range(at, at + len(words))))
        self.ids.extend(flat, per)

    @staticmethod
    def segments(text: str) -> list[str]:
        """The words of a text, each behind the blanks before it.  An empty text has none."""
        return _SEGMENT.findall((BLANK + text).replace(" ", BLANK)) if text else []

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text between the begin and the end id.  Null counts as empty."""
        run: list[list[str]] = []
        size = 0
        for text in texts:
            run.append(self.segments(text or ""))
            size += len(run[-1])
            if size >= RUN_WORDS:
                yield from self._run(run)
                run, size = [], 0
        yield from self._run(run)

    def _run(self, run: list[list[str]]) -> Iterator[np.ndarray]:
        if len(self.kept) > KEPT_WORDS:
            self.forget()
        fresh = {w for words in run for w in words if w not in self.kept}
        if fresh:
            self.learn(list(fresh))
        for words in run:
            at = np.fromiter(map(self.kept.__getitem__, words), np.int64, len(words))
            yield np.concatenate([np.array([self.begin], "<u4"), self.ids.take(at)[0], np.array([self.end], "<u4")])

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text; one blank in front goes, and bytes that are no character become U+FFFD each."""
        ids = np.asarray(ids, np.int64)
        shown = ids[self.spelled.length[ids] > 0]
        text = self.spelled.take(shown)[0].tobytes()
        cut = len(shown) > 0 and self.opens[shown[0]]
        if self.is_byte[shown].any():  # a control id between bytes parts them
            runs = np.split(ids, np.nonzero(self.spelled.length[ids] == 0)[0])
            text = b"".join(_mended(self.spelled.take(run)[0].tobytes()) for run in runs if len(run))
        return text[1:] if cut else text


def _mended(raw: bytes) -> bytes:
    try:
        raw.decode()
        return raw
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            try:
                return b"".join([*out, raw[at:].decode().encode()])
            except UnicodeDecodeError as error:
                out += [raw[at : at + error.start], "�".encode()]
                at += error.start + 1
        return b"".join(out)


@cache
def encoder(file: str) -> Encoder:
    return Encoder(file)


keeps("prefixtable", encoder.cache_clear)


def _digests(file: str) -> Column:
    @F.pandas_udf(RESULT)
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        claim("prefixtable")
        model = encoder(file)
        for batch in texts:
            rows = [
                (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(model.decode(ids)).hexdigest())
                for ids in model.encode(batch)
            ]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in RESULT.split(", ")])

    return encode.asNondeterministic()("text")


def encode_digests(docs: DataFrame, file: str) -> DataFrame:
    """One row per row of ``docs``: count of all ids, digests of the ids and of the decoded text.

    A null or empty text has the begin and the end id only and decodes to nothing.  Texts of any
    length are encoded whole.  Repeated rows repeat; an empty table gives no rows; other columns
    play no part.
    """
    return docs.select("doc_id", _digests(file).alias("found")).select("doc_id", "found.*")


def encode_documents(docs: DataFrame, file: str) -> DataFrame:
    """``doc_id, ids, decoded`` of every row; null and empty texts as in ``encode_digests``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("prefixtable")
        model = encoder(file)
        for batch in batches:
            for at in range(0, len(batch), TEXTS_OUT):
                some = batch.iloc[at : at + TEXTS_OUT]
                found = [(ids.astype(np.int32), model.decode(ids).decode()) for ids in model.encode(some["text"])]
                made = pd.DataFrame(found, columns=["ids", "decoded"])
                made.insert(0, "doc_id", some["doc_id"].to_numpy())
                yield made

    named = docs.select(F.col("doc_id").cast("string"), "text")  # pandas has no exact integers beside nulls
    found = named.mapInPandas(rows, "doc_id string, ids array<int>, decoded string")
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))


def decode_ids(encoded: DataFrame, file: str) -> DataFrame:
    """Replaces the column ``ids`` by ``decoded``; null ids give a null, no ids an empty text."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        claim("prefixtable")
        model = encoder(file)
        for batch in batches:
            yield pd.Series([None if x is None else model.decode(x).decode() for x in batch], dtype=object)

    return encoded.withColumn("decoded", decode("ids")).drop("ids")


def default_file() -> str:
    """Place of the public vocabulary in this environment; pass another file to use that."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
