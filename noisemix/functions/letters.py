"""Letter statistics for substitution typos, in units of 1/10000."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALPHABET = "abcdefghijklmnopqrstuvwxyz"

# How often each letter is the one mistyped.
LETTER_WEIGHT = {
    "a": 233, "b": 282, "c": 312, "d": 920, "e": 850, "f": 472, "g": 501, "h": 333, "i": 760,
    "j": 43, "k": 185, "l": 496, "m": 180, "n": 307, "o": 587, "p": 185, "q": 13, "r": 904,
    "s": 1023, "t": 548, "u": 333, "v": 124, "w": 201, "x": 46, "y": 121, "z": 42,
}

# Which letter is hit instead of the intended one.
LETTER_TRANSITION = {
    "a": {"q": 98, "s": 6975, "w": 1785, "x": 639, "z": 504},
    "b": {"f": 2188, "g": 2876, "h": 1470, "n": 2631, "v": 835},
    "c": {"d": 2348, "f": 1855, "s": 4657, "v": 913, "x": 227},
    "d": {"c": 798, "e": 1645, "f": 670, "r": 2668, "s": 3366, "v": 327, "w": 442, "x": 84},
    "e": {"d": 1780, "f": 770, "r": 3447, "s": 3409, "w": 594},
    "f": {"b": 1307, "c": 1227, "d": 1305, "e": 1386, "g": 1082, "r": 1519, "t": 1702, "v": 472},
    "g": {"b": 1619, "f": 1020, "h": 775, "n": 1789, "r": 1688, "t": 2315, "v": 389, "y": 405},
    "h": {"b": 1247, "g": 1168, "j": 307, "m": 1323, "n": 1366, "t": 2748, "u": 1205, "y": 636},
    "i": {"j": 35, "k": 503, "l": 2067, "o": 4184, "u": 3210},
    "j": {"h": 2351, "i": 617, "k": 1102, "m": 3059, "n": 1776, "u": 502, "y": 593},
    "k": {"i": 2071, "j": 259, "l": 3040, "m": 1763, "o": 1736, "u": 1132},
    "l": {"i": 3166, "k": 1132, "o": 3376, "p": 2327},
    "m": {"h": 2450, "j": 739, "k": 1812, "n": 4999},
    "n": {"b": 2419, "g": 2923, "h": 1481, "j": 251, "m": 2926},
    "o": {"i": 5419, "k": 546, "l": 2854, "p": 1180},
    "p": {"l": 6250, "o": 3750},
    "q": {"a": 1766, "s": 6069, "w": 2165},
    "r": {"d": 2715, "e": 3242, "f": 793, "g": 936, "t": 2313},
    "s": {"a": 1589, "c": 1423, "d": 3028, "e": 2835, "q": 76, "w": 640, "x": 135, "z": 274},
    "t": {"f": 1467, "g": 2119, "h": 1668, "r": 3816, "y": 929},
    "u": {"h": 1203, "i": 7324, "j": 65, "k": 627, "y": 780},
    "v": {"b": 1900, "c": 2301, "d": 2426, "f": 1800, "g": 1574},
    "w": {"a": 2069, "d": 2023, "e": 2515, "q": 139, "s": 3255},
    "x": {"a": 3267, "c": 1560, "d": 1698, "s": 3040, "z": 434},
    "y": {"g": 1678, "h": 1749, "j": 213, "t": 4211, "u": 2150},
    "z": {"a": 2815, "s": 6711, "x": 474},
}


def _ints(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _by_code(letter: Column, values: list[int]) -> Column:
    """Look up an ASCII letter of either case; 0 for anything else."""
    table = _ints([*values, *[0] * 6, *values])  # code points 65 (A) to 122 (z)
    return F.coalesce(F.get(table, F.ascii(letter) - 65), F.lit(0))


def letter_number(letter: Column) -> Column:
    """1..26 for an ASCII letter of either case, 0 for anything else."""
    return _by_code(letter, list(range(1, 27)))


def letter_weight(letter: Column) -> Column:
    return _by_code(letter, [LETTER_WEIGHT[a] for a in ALPHABET])


def transition_running(number: Column) -> Column:
    """Running weights of the letters hit instead of letter ``number``."""
    table = F.array(*[_ints(accumulate(LETTER_TRANSITION[a].values())) for a in ALPHABET])
    return F.element_at(table, number)


def transition_letters(number: Column) -> Column:
    table = F.array(*[F.lit("".join(LETTER_TRANSITION[a])) for a in ALPHABET])
    return F.element_at(table, number)


def letter_weight_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LETTER_WEIGHT.items()), "letter string, w int")


def letter_transition_table(spark: SparkSession) -> DataFrame:
    rows = [(a, b, w) for a, hits in LETTER_TRANSITION.items() for b, w in hits.items()]
    return spark.createDataFrame(rows, "from_letter string, to_letter string, w int")
