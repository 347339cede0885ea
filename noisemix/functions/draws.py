"""Reproducible random draws as plain column expressions.

A draw is a hash of ``seed | operator | row key | draw number``, so it depends on
the row and nothing else: not on the partitioning, the task attempt or the order
in which rows arrive.  ``rand(seed)`` has none of these properties.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

RESOLUTION = 4294967296  # draws are multiples of 2**-32


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value))


def draw_hash(seed: int, op: str, *key) -> Column:
    """32 hex digits holding four independent 32-bit lanes."""
    parts = [p.cast("string") if isinstance(p, Column) else _col(p) for p in key]
    return F.md5(F.concat_ws("|", F.lit(f"{seed}|{op}"), *parts))


def lane(digest: Column, number: int | Column = 0) -> Column:
    """Uniform double in [0, 1) from one 8-digit lane of a :func:`draw_hash`."""
    start = F.lit(1) + F.lit(8) * number
    digits = F.substr(digest, start, F.lit(8))
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(RESOLUTION))


def uniform(seed: int, op: str, *key) -> Column:
    """One uniform double in [0, 1) for the given operator and row key."""
    return lane(draw_hash(seed, op, *key))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def running_weights(weights: Column) -> Column:
    """Running sums of an integer weight array."""
    return F.aggregate(
        weights,
        F.array().cast("array<int>"),
        lambda acc, w: F.concat(
            acc, F.array((F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + w).cast("int"))
        ),
    )


def weighted_index(cumulative: Column, u: Column) -> Column:
    """0-based index of the first running weight above ``u * total``."""
    # bound once: inside the filter the draw would be hashed again for every weight
    return let(
        u * F.element_at(cumulative, -1),
        lambda x: F.size(F.filter(cumulative, lambda c: c <= x)),
    )


def block_numbers(size: Column, block: int) -> Column:
    """0-based numbers of the blocks of ``block`` elements of a non-empty array."""
    return F.sequence(F.lit(0), F.floor((size - 1) / block).cast("int"))


def block_weights(weights: Column, block: int) -> Column:
    """Running sums over the blocks of a weight array."""
    return running_weights(
        F.transform(
            block_numbers(F.size(weights), block),
            lambda b: F.aggregate(
                F.slice(weights, b * block + 1, block), F.lit(0), lambda acc, w: acc + w
            ),
        )
    )


def weighted_index_in_blocks(weights: Column, blocks: Column, block: int, u: Column) -> Column:
    """:func:`weighted_index` over the running sums of ``weights``, without making them all."""

    def within(x: Column, b: Column) -> Column:
        before = F.coalesce(F.get(blocks, b - 1), F.lit(0)).cast("int")
        found = F.aggregate(
            F.slice(weights, b * block + 1, block),
            F.struct(before.alias("sum"), F.lit(0).alias("n")),
            lambda acc, w: F.struct(
                (acc["sum"] + w).cast("int").alias("sum"),
                (acc["n"] + F.when(acc["sum"] + w <= x, 1).otherwise(0)).alias("n"),
            ),
        )
        return (b * block + found["n"]).cast("int")

    return let(
        u * F.element_at(blocks, -1),
        lambda x: let(F.size(F.filter(blocks, lambda c: c <= x)), lambda b: within(x, b)),
    )


def index_by_weight(weights: Column) -> Column:
    """Every index as often as its integer weight says, in order.

    The element at ``floor(u * size)`` is what :func:`weighted_index` finds in the running sums, without
    looking at any other weight.
    """
    return F.flatten(F.transform(weights, lambda w, i: F.array_repeat(i, w)))
