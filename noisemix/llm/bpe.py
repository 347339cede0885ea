"""BPE encoding and decoding by a pair occurrence index.

The texts of a batch are cut at white space; every word not seen before is normalised and cut
into pieces, and the new pieces of the batch are laid end to end in one flat array of symbols.
An index maps each mergeable pair of neighbours to all its positions.  Active ranks are applied
in ascending order: one rank's merges happen at all its positions at once, and the lists of the
neighbouring pairs that this makes are updated.  Pieces are independent, so the lowest rank that
is active anywhere is also the lowest in each piece that holds it.

Encoded words are kept for later batches in a table of bounded size; a full table starts anew.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import cache, cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from noisemix.llm.common import claim, give_back, keeps, trim

RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"
#: A worker that keeps more words than this starts anew.
KEPT_WORDS = 200_000
#: Words after which a run of texts ends.
RUN_WORDS = 300_000
#: Encoded texts that leave a task together.
TEXTS_OUT = 128
#: Words kept from frame to frame where ids and texts leave a task: those of the frame come on top.
KEPT_BETWEEN = 100_000
#: Fixed value: the vocabulary's own pattern, with line ends as pieces between words.
PIECE = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: White space as the vocabulary's normaliser sees it; ``str.split`` also cuts at \x1c-\x1f.
SPACE = re.compile(r"[\t-\r \x85\xa0  -     　]+")
_ODD = re.compile(r"[\x1c-\x1f]")
#: Words with such characters go through the library's own normaliser.
_RARE = re.compile(r"[^\x21-\x7e\xa1-\u024f]|\u0130")


def byte_letters() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


#: How the vocabulary file says that texts are normalised, cut, merged and decoded.
BUILT_IN = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "decoder": None,
}
MODEL = {
    "type": "BPE",
    "dropout": None,
    "unk_token": None,
    "continuing_subword_prefix": None,
    "end_of_word_suffix": "</w>",
    "fuse_unk": False,
    "byte_fallback": False,
    "ignore_merges": False,
}


def refuse_foreign(made: dict, file: str) -> None:
    """Raises ``ValueError`` for a vocabulary file whose rules aren't those that are built in here."""
    model = made.get("model") or {}
    odd = [k for k, v in BUILT_IN.items() if made.get(k) != v] + [f"model.{k}" for k, v in MODEL.items() if model.get(k, v) != v]
    if odd:
        raise ValueError(f"{file}: other rules than the built-in ones: {', '.join(odd)}")


def _sorted_unique(x: np.ndarray) -> np.ndarray:
    x.sort()
    return x if len(x) < 2 else x[np.concatenate(([True], x[1:] != x[:-1]))]


class PairIndex:
    """Merges pieces, given as lists of symbol ids, all at once."""

    def __init__(self, merges: list[tuple[int, int, int]], symbols: int):
        """``merges``: (left, right, made) by rank."""
        keys = np.array([left * symbols + right for left, right, _ in merges], np.int64)
        self.symbols = symbols
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.left = np.array([m[0] for m in merges])
        self.right = np.array([m[1] for m in merges])
        self.made = np.array([m[2] for m in merges])
        self.twice = self.left == self.right
        # A merge may make a pair of lower rank than its own; then places must go one by one.
        first = np.full(symbols, len(merges))
        np.minimum.at(first, self.left, np.arange(len(merges)))
        np.minimum.at(first, self.right, np.arange(len(merges)))
        self.falls = first[self.made] < np.arange(len(merges))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where there is no merge."""
        key = left.astype(np.int64) * self.symbols + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)

    def merge(self, flat: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Merges in place; returns which places still hold a symbol.

        ``piece`` numbers the piece of each place, ascending.
        """
        n = len(flat)
        alive = np.ones(n, bool)
        if n < 2:
            return alive
        after = np.arange(1, n + 1)
        after[:-1][piece[1:] != piece[:-1]] = n
        after[-1] = n
        before = np.full(n + 1, -1)
        has = np.nonzero(after < n)[0]
        before[after[has]] = has
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(places: np.ndarray) -> None:
            """Puts pairs that begin at these places into the index."""
            places = places[after[places] < n]
            rank = self.ranks(flat[places], flat[after[places]])
            places, rank = places[rank >= 0], rank[rank >= 0]
            by = np.argsort(rank, kind="stable")
            places, rank = places[by], rank[by]
            cuts = [0, *(np.nonzero(np.diff(rank))[0] + 1).tolist(), len(rank)] if len(rank) else []
            for begin, end in zip(cuts, cuts[1:]):
                r = int(rank[begin])
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(places[begin:end])

        note(np.arange(n))
        while active:
            r = heapq.heappop(active)
            places = _sorted_unique(np.concatenate(index.pop(r)))
            places = places[alive[places]]
            right = after[places]
            ok = right < n
            places, right = places[ok], right[ok]
            ok = (flat[places] == self.left[r]) & (flat[right] == self.right[r])
            places, right = places[ok], right[ok]
            if not len(places):
                continue
            rest = None
            if self.falls[r]:  # the first place of each piece; the others wait for lower ranks
                lead = np.ones(len(places), bool)
                lead[1:] = piece[places[1:]] != piece[places[:-1]]
                rest = places[~lead]
                places, right = places[lead], right[lead]
            elif self.twice[r]:  # of overlapping places in a row, every other one
                joined = np.zeros(len(places), bool)
                joined[1:] = right[:-1] == places[1:]
                start = np.maximum.accumulate(np.where(joined, 0, np.arange(len(places))))
                keep = (np.arange(len(places)) - start) % 2 == 0
                places, right = places[keep], right[keep]
            flat[places] = self.made[r]
            alive[right] = False
            beyond = after[right]
            after[places] = beyond
            inside = beyond < n
            before[beyond[inside]] = places[inside]
            previous = before[places]
            note(_sorted_unique(np.concatenate([places, previous[previous >= 0]])))
            if rest is not None and len(rest):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(rest)
        return alive


class Encoder:
    """Encodes as the vocabulary file says; keeps what it has encoded."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            made = json.load(f)
        refuse_foreign(made, file)
        self.file = file
        model = made["model"]
        end = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        # the library's normaliser and cutter alone: its vocabulary isn't needed a second time
        self.rules = Tokenizer.from_str(json.dumps(made | {"added_tokens": [], "model": model | {"vocab": {}, "merges": []}}))
        self.special = {x["content"]: x["id"] for x in made["added_tokens"]}
        self.special_at = re.compile("|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)))
        self.token = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        merges = []
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            merges.append((vocab[left], vocab[right], vocab[left + right]))
        self.index = PairIndex(merges, max(self.token) + 1)
        letters = byte_letters()
        self.byte = {c: b for b, c in enumerate(letters)}
        self.inner = np.array([vocab.get(c, -1) for c in letters])
        self.last = np.array([vocab.get(c + end, -1) for c in letters])
        spelled = [(self.token.get(i, "") + " ").encode() for i in range(max(self.token) + 1)]
        self.spelled = Ragged(np.frombuffer(b"".join(spelled), np.uint8), np.array([len(x) for x in spelled]))
        self.forget()

    @cached_property
    def tokenizer(self) -> Tokenizer:
        """The library's own, to compare with; encoding doesn't load it."""
        return Tokenizer.from_file(self.file)

    def forget(self) -> None:
        """Starts the table of kept words anew, with the special tokens."""
        self.kept = {name: i for i, name in enumerate(self.special)}
        self.ids = Ragged(np.array(list(self.special.values()), "<u4"), np.ones(len(self.special), np.int64))

    def cut(self, words: list[str]) -> Iterator[list[bytes]]:
        """The pieces of each word as bytes, normalised."""
        plain = [w for w in words if not _RARE.search(w)]
        pieces = iter(PIECE.findall("\n".join(plain).lower()))
        for word in words:
            if _RARE.search(word):
                shown = self.rules.normalizer.normalize_str(word)
                parts = self.rules.pre_tokenizer.pre_tokenize_str(shown)
                yield [bytes(map(self.byte.__getitem__, p)) for p, _ in parts]
                continue
            own = []
            for piece in pieces:
                if piece == "\n":
                    break
                own.append(piece.encode())
            yield own

    def learn(self, fresh: list[str]) -> None:
        """Encodes new words: the pair index works on all of them together."""
        pieces, word = [], []
        for i, own in enumerate(self.cut(fresh)):
            pieces += own
            word += [i] * len(own)
        flat, piece = self.merged(pieces)
        per = np.bincount(np.array(word, np.int64)[piece], minlength=len(fresh)) if len(piece) else np.zeros(len(fresh), np.int64)
        at = len(self.kept)
        self.kept.update(zip(fresh, range(at, at + len(fresh))))
        self.ids.extend(flat, per)

    def merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pieces in a row, and the piece of each."""
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        length = np.array([len(p) for p in pieces], np.int64)
        piece = np.repeat(np.arange(len(pieces)), length)
        flat = self.inner[raw]
        ends = np.cumsum(length) - 1
        flat[ends] = self.last[raw[ends]]
        known = flat >= 0  # a character outside the vocabulary gives no token
        flat, piece = flat[known], piece[known]
        alive = self.index.merge(flat, piece)
        return flat[alive].astype("<u4"), piece[alive]

    def segments(self, text: str) -> list[str]:
        """Words and special tokens in order."""
        out, at = [], 0
        for m in self.special_at.finditer(text) if "<|" in text else ():
            out += self.words(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self.words(text[at:] if at else text)

    @staticmethod
    def words(text: str) -> list[str]:
        """``str.split`` also cuts at \\x1c-\\x1f, which aren't white space to the vocabulary."""
        return [w for w in SPACE.split(text) if w] if _ODD.search(text) else text.split()

    def encode(self, texts: Iterable[str | None]) -> Iterator[tuple[bytes, bytes]]:
        """Ids as little-endian unsigned 32-bit integers, and the decoded text, of each text.

        Null counts as empty.  Texts are worked off in runs of bounded size.
        """
        run: list[list[str]] = []
        size = 0
        for text in texts:
            run.append(self.segments(text or ""))
            size += len(run[-1])
            if size >= RUN_WORDS:
                yield from self._run(run)
                run, size = [], 0
        yield from self._run(run)

    def _run(self, run: list[list[str]]) -> Iterator[tuple[bytes, bytes]]:
        if len(self.kept) > KEPT_WORDS:
            self.forget()
        fresh = {w for words in run for w in words if w not in self.kept}
        if fresh:
            self.learn(list(fresh))
        for words in run:
            at = np.fromiter(map(self.kept.__getitem__, words), np.int64, len(words))
            ids, _ = self.ids.take(at)
            yield ids.tobytes(), self.spelled.take(ids.astype(np.int64))[0][:-1].tobytes()

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by spaces: the vocabulary file names no decoder."""
        return " ".join(self.token[int(i)] for i in ids if int(i) in self.token)


class Ragged:
    """Rows of different length in one array that grows."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        self.flat, self.length, self.n, self.used = flat, lengths, len(lengths), len(flat)
        self.start = np.cumsum(lengths) - lengths

    def extend(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        starts = np.cumsum(lengths) - lengths + self.used
        self.flat = _appended(self.flat, self.used, flat)
        self.length = _appended(self.length, self.n, lengths)
        self.start = _appended(self.start, self.n, starts)
        self.n += len(lengths)
        self.used += len(flat)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows one behind another, and their lengths."""
        length = self.length[rows]
        ends = np.cumsum(length)
        place = np.repeat(self.start[rows] - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)
        return self.flat[place], length


def _appended(old: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    if used + len(more) > len(old):
        grown = np.empty(max(2 * used, used + len(more)), old.dtype)
        grown[:used] = old[:used]
        old = grown
    old[used : used + len(more)] = more
    return old


@cache
def encoder(file: str) -> Encoder:
    return Encoder(file)


keeps("bpe", encoder.cache_clear)


def _digests(file: str) -> Column:
    @F.pandas_udf(RESULT)
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        claim("bpe")
        bpe = encoder(file)
        for batch in texts:
            rows = [
                (len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded).hexdigest())
                for raw, decoded in bpe.encode(batch)
            ]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in RESULT.split(", ")])

    return encode.asNondeterministic()("text")


def encode_digests(docs: DataFrame, file: str) -> DataFrame:
    """One row per row of ``docs``: token count and digests of ids and decoded text.

    A null text is empty: no tokens, digests of nothing.  Repeated rows repeat.
    """
    return docs.select("doc_id", _digests(file).alias("found")).select("doc_id", "found.*")


def encode_documents(docs: DataFrame, file: str) -> DataFrame:
    """``doc_id, ids, decoded`` of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe")
        bpe = encoder(file)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_OUT):  # no more texts than these are held as Python strings
                if len(bpe.kept) > KEPT_BETWEEN:
                    bpe.forget()
                some = batch.slice(at, TEXTS_OUT)
                raw, decoded = zip(*bpe.encode(some.column("text").to_pylist()), strict=True)
                ends = np.cumsum([0, *[len(x) // 4 for x in raw]]).astype(np.int32)
                ids = pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(raw), "<u4").astype(np.int32))
                texts = pa.array([x.decode() for x in decoded], pa.string())
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), ids, texts], ["doc_id", "ids", "decoded"])
                del raw, decoded, ids, texts
                trim()
        bpe.forget()
        give_back()

    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, ids array<int>, decoded string")


def decode_ids(encoded: DataFrame, file: str) -> DataFrame:
    """Replaces the column ``ids`` by ``decoded``; null ids give a null."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        claim("bpe")
        bpe = encoder(file)
        for batch in batches:
            yield pd.Series([None if x is None else bpe.decode(x) for x in batch], dtype=object)

    return encoded.withColumn("decoded", decode("ids")).drop("ids")


def default_file() -> str:
    """Place of the public vocabulary in this environment; pass another file to use that."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


