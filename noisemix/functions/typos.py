"""Keyboard typos on words and sentences."""

from __future__ import annotations

import hashlib
import math
import string
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import letters, text
from .draws import (
    RESOLUTION,
    draw_hash,
    lane,
    let,
    running_weights,
    weighted_index,
)

MIN_WORD = 6
MIN_SENTENCE = 4
EDIT = "struct<word:string,sub:int,swap:int>"


def _edit(word: Column, sub, swap) -> Column:
    return F.struct(
        word.alias("word"),
        F.lit(sub).cast("int").alias("sub"),
        F.lit(swap).cast("int").alias("swap"),
    )


def _put(word: Column, replacement: Column, at: Column, size: int = 1) -> Column:
    """``word`` with ``size`` characters from 0-based position ``at`` replaced."""
    return F.concat(F.substr(word, F.lit(1), at), replacement, F.substr(word, at + (size + 1)))


def substitute_letter(word: Column, u_slot: Column, u_letter: Column) -> Column:
    """Hit a neighbouring key instead of one letter, keeping its case."""

    def hit(slot: Column) -> Column:
        def typed(old: Column) -> Column:
            number = letters.letter_number(old)
            pick = let(
                letters.transition_running(number),
                lambda running: weighted_index(running, u_letter),
            )
            new = F.substr(letters.transition_letters(number), pick + 1, F.lit(1))
            return let(new, lambda n: F.when(old >= "a", n).otherwise(F.upper(n)))

        old = F.substr(word, slot + 1, F.lit(1))
        return _edit(_put(word, let(old, typed), slot), 1, 0)

    weights = F.transform(
        F.sequence(F.lit(1), F.length(word)),
        lambda i: letters.letter_weight(F.substr(word, i, F.lit(1))),
    )
    return F.when(
        word.rlike("[A-Za-z]"),
        let(running_weights(weights), lambda cum: let(weighted_index(cum, u_slot), hit)),
    ).otherwise(_edit(word, 0, 0))


def swap_letters(word: Column, u_slot: Column) -> Column:
    """Swap two adjacent characters of a word that has at least two letters."""

    def swapped(at: Column) -> Column:
        pair = F.concat(
            F.substr(word, at + 2, F.lit(1)),
            F.substr(word, at + 1, F.lit(1)),
        )
        return _edit(_put(word, pair, at, 2), 0, 1)

    return F.when(
        word.rlike(r"\p{L}.*\p{L}"),
        let(F.floor(u_slot * (F.length(word) - 1)).cast("int"), swapped),
    ).otherwise(_edit(word, 0, 0))


def edit_word(word: Column, digest: Column) -> Column:
    """One typo, a substitution or a swap with equal chance, from lanes 1 to 3 of a draw."""
    return F.when(
        lane(digest, 1) < 0.5, substitute_letter(word, lane(digest, 2), lane(digest, 3))
    ).otherwise(swap_letters(word, lane(digest, 2)))


def word_weights(toks: Column) -> Column:
    """Length without punctuation of every word long enough to mistype, 0 for the others."""
    return F.transform(
        text.strip_tokens(toks),
        lambda s: F.when((F.length(s) >= MIN_WORD) & text.is_letters(s), F.length(s)).otherwise(
            F.lit(0)
        ),
    )


#: What may follow the letters of a word at the end of a line, for ``text.is_letters`` as for this.
_LINE_ENDS = "\n\r\x85\u2028\u2029"
_NO_MARKS = {ord(c): None for c in string.punctuation}  # the marks of text.PUNCTUATION
_WEIGHT = {x: w for a, w in letters.LETTER_WEIGHT.items() for x in (a, a.upper())}
_TYPED = {
    x: (list(accumulate(hits.values())), [new if x == a else new.upper() for new in hits])
    for a, hits in letters.LETTER_TRANSITION.items()
    for x in (a, a.upper())
}


def _substituted(word: str, u_slot: float, u_letter: float) -> str | None:
    """:func:`substitute_letter` of a string; nothing for a word without an ASCII letter."""
    running = list(accumulate([_WEIGHT.get(c, 0) for c in word]))
    if not running[-1]:
        return None
    slot = bisect_right(running, u_slot * running[-1])
    reach, hits = _TYPED[word[slot]]
    return word[:slot] + hits[bisect_right(reach, u_letter * reach[-1])] + word[slot + 1 :]


def _typed_line(line: str, key: str, p: float) -> tuple[str, int, int] | None:
    """A line of tokens with its typos and how many are substitutions and swaps; nothing if it has none to offer."""
    words = line.split(" ")
    if len(words) < MIN_SENTENCE:
        return None
    places, running, total = [], [], 0
    for at, word in enumerate(words):
        size = len(word)
        if size < MIN_WORD:
            continue
        if not word.isalpha():
            bare = word.translate(_NO_MARKS)
            size = len(bare)
            if size < MIN_WORD or not (bare.isalpha() or bare[-1] in _LINE_ENDS and bare[:-1].isalpha()):
                continue
        total += size
        places.append(at)
        running.append(total)
    if not places:
        return None
    made = [0, 0]
    for d in range(1, min(max(math.floor(len(words) * p), 1), len(places)) + 1):
        digest = hashlib.md5(f"{key}|{d}".encode(), usedforsecurity=False).hexdigest()
        u = [int(digest[i : i + 8], 16) / RESOLUTION for i in (0, 8, 16, 24)]
        at = places[bisect_right(running, math.floor(u[0] * total))]
        word = words[at]
        swapped = u[1] >= 0.5
        if swapped:  # a drawn word has letters side by side, whatever was typed before
            slot = math.floor(u[2] * (len(word) - 1))
            word = word[:slot] + word[slot + 1] + word[slot] + word[slot + 2 :]
        else:
            word = _substituted(word, u[2], u[3])
        if word is not None:
            words[at] = word
            made[swapped] += 1
    return " ".join(words), *made


_TYPED_LINE = "struct<line:string,sub:int,swap:int>"


def _typed_lines(lines: pa.Array, keys: pa.Array, p: float) -> pa.Array:
    """:func:`_typed_line` of each line, as ``_TYPED_LINE``."""
    pairs = zip(lines.to_pylist(), keys.to_pylist(), strict=True)
    found = [None if line is None else _typed_line(line, key, p) for line, key in pairs]
    columns = zip(*[x or (None, 0, 0) for x in found], strict=True) if found else ([], [], [])
    kinds = (pa.string(), pa.int32(), pa.int32())
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    return pa.StructArray.from_arrays(arrays, ["line", "sub", "swap"])


def _key(row_key: Column, seed: int) -> Column:
    return F.concat_ws("|", F.lit(f"{seed}|typo"), row_key)


def edited_tokens(toks: Column, made: Column) -> Column:
    """``struct(tokens, sub, swap)`` of a line's tokens and what came of them (``_TYPED_LINE``)."""
    return F.struct(
        F.when(made["line"].isNull(), toks).otherwise(F.split(made["line"], " ")).alias("tokens"),
        made["sub"].alias("sub"),
        made["swap"].alias("swap"),
    )


def typo_sentence(toks: Column, row_key: Column, p: float, seed: int) -> Column:
    """Typos in a sentence: ``struct(tokens, sub, swap)``.

    The number of typos is ``p`` times the token count, at least one and at most the
    number of long-enough words; words are drawn with replacement, weighted by length
    (:func:`word_weights`), and each draw makes one typo as :func:`edit_word` does, on what the
    draws before it have left.  Lines go through Python in Arrow batches; a line without typos
    stays as it is.
    """

    @F.arrow_udf(_TYPED_LINE)
    def typed(lines: pa.Array, keys: pa.Array) -> pa.Array:
        return _typed_lines(lines, keys, float(p))

    return edited_tokens(toks, typed(text.untokens(toks), _key(row_key, seed)))


def typo_sentences(lines: Column, row_keys: Column, p: float, seed: int) -> Column:
    """:func:`typo_sentence` for an array of lines, tokens joined by spaces, and one of their keys.

    Gives an array of ``_TYPED_LINE``, to be made a column of its own; :func:`edited_tokens` reads it in lambdas.
    """

    @F.arrow_udf(f"array<{_TYPED_LINE}>")
    def typed(lines: pa.Array, keys: pa.Array) -> pa.Array:
        ends = np.append(0, np.cumsum(lines.value_lengths().to_numpy(zero_copy_only=False)))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _typed_lines(lines.flatten(), keys.flatten(), float(p)))

    return typed(lines, F.transform(row_keys, lambda k: _key(k, seed)))


def typo_each_word(toks: Column, row_key: Column, p: float, seed: int) -> Column:
    """Older per-word rule: a word of six or more characters is hit with chance p * length / 10."""

    def word(t: Column, i: Column) -> Column:
        return let(
            draw_hash(seed, "typo_word", row_key, i),
            lambda digest: F.when(
                (F.length(t) >= MIN_WORD)
                & (lane(digest, 0) <= F.length(t) * F.lit(float(p)) / 10.0),
                edit_word(t, digest),
            ).otherwise(_edit(t, 0, 0)),
        )

    return F.transform(toks, word)
