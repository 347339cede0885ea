"""Joining sentences into run-ons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text
from .draws import draw_hash, lane, let

# What replaces the period between two clauses, each equally likely.
CONJUNCTIONS = [" and", ", and", ",", ",", ";"]
QUOTED_CONJUNCTIONS = [",", ",", ";"]


def pick_conjunction(u: Column, choices: list[str] = CONJUNCTIONS) -> Column:
    slots = F.array(*[F.lit(c) for c in choices])
    return F.element_at(slots, F.floor(u * len(choices)).cast("int") + 1)


def open_clause(first: Column, is_proper: Column) -> Column:
    """First token of a clause that no longer starts a sentence."""
    return (
        F.when(first == "I", first)
        .when(is_proper, text.capitalise(first))
        .otherwise(F.lower(first))
    )


def close_clause(clause: Column, u: Column) -> Column:
    """Replace the closing punctuation of a clause by a conjunction."""
    size = F.length(clause)
    last = F.substr(clause, size, F.lit(1))
    before = F.substr(clause, size - 1, F.lit(1))
    punct = f"^{text.PUNCTUATION}$"
    body = F.substr(clause, F.lit(1), size - 1)
    conj = pick_conjunction(u)
    quoted = (
        F.when(
            before.rlike(punct),
            F.concat(
                F.substr(clause, F.lit(1), size - 2),
                pick_conjunction(u, QUOTED_CONJUNCTIONS),
                last,
            ),
        )
        .when(conj == " and", F.concat(clause, conj))
        .when(conj == ", and", F.concat(body, F.lit(","), last, F.lit(" and")))
        .otherwise(F.concat(body, conj, last))
    )
    lone = (size < 2) | (before == " ")
    return (
        F.when(~last.rlike(punct), F.concat(clause, conj))
        .when(last.isin('"', "'") & ~lone, quoted)
        .otherwise(F.concat(body, conj))
    )


def runon_line(
    toks: Column, proper_at: Column, row_key: Column, p: float, seed: int
) -> Column:
    """Turn detached periods inside a line into conjunctions: ``struct(tokens, runons)``.

    Clause ``j`` follows the ``j``-th detached period.  ``proper_at`` holds the numbers of
    the clauses that open with a proper noun, which keeps its capital.
    """

    def digest(j: Column) -> Column:
        return draw_hash(seed, "runon", row_key, j)

    def result(t: Column, runons: Column) -> Column:
        return F.struct(t.alias("tokens"), runons.cast("int").alias("runons"))

    def by_clause(line: Column) -> Column:
        """No two periods in a row: every clause is on its own."""

        def join(clause: Column, j: Column) -> Column:
            def glued(d: Column) -> Column:
                first = F.substring_index(clause, " ", 1)
                opened = F.concat(
                    open_clause(first, F.array_contains(proper_at, j)),
                    F.substr(clause, F.length(first) + 1),
                )
                return F.when(
                    lane(d, 0) < p,
                    F.struct(
                        F.concat(pick_conjunction(lane(d, 1)), F.lit(" "), opened).alias("text"),
                        F.lit(1).alias("made"),
                    ),
                ).otherwise(plain(F.concat(F.lit(". "), clause)))

            return F.when(j == 0, plain(clause)).otherwise(let(digest(j), glued))

        def plain(t: Column) -> Column:
            return F.struct(t.alias("text"), F.lit(0).alias("made"))

        return let(
            F.transform(F.split(line, r" \. "), join),
            lambda parts: result(
                text.tokens(F.array_join(F.transform(parts, lambda x: x["text"]), "")),
                F.size(F.filter(parts, lambda x: x["made"] == 1)),
            ),
        )

    def by_token() -> Column:
        """General walk: a period turned into a conjunction swallows whatever follows it."""

        def step(acc: Column, item: Column) -> Column:
            t = item["t"]
            inner = (t == ".") & (item["i"] < F.size(toks) - 1)

            def to(out: Column, skip: bool, more: int) -> Column:
                return F.struct(
                    out.alias("out"),
                    F.lit(skip).alias("skip"),
                    (acc["seen"] + inner.cast("int")).alias("seen"),
                    (acc["runons"] + F.lit(more)).alias("runons"),
                )

            opened = open_clause(t, F.array_contains(proper_at, acc["seen"]))
            joined = let(
                digest(acc["seen"] + 1),
                lambda d: F.when(
                    lane(d, 0) < p,
                    to(F.concat(acc["out"], pick_conjunction(lane(d, 1))), True, 1),
                ).otherwise(to(F.concat(acc["out"], F.lit(".")), False, 0)),
            )
            return (
                F.when(acc["skip"], to(F.concat(acc["out"], F.lit(" "), opened), False, 0))
                .when(inner, joined)
                .otherwise(to(F.concat(acc["out"], F.lit(" "), t), False, 0))
            )

        return F.aggregate(
            F.transform(toks, lambda t, i: F.struct(t.alias("t"), i.alias("i"))),
            F.struct(
                F.lit("").alias("out"),
                F.lit(False).alias("skip"),
                F.lit(0).alias("seen"),
                F.lit(0).alias("runons"),
            ),
            step,
            lambda acc: result(text.tokens(acc["out"]), acc["runons"]),
        )

    def choose(line: Column) -> Column:
        return (
            F.when(F.startswith(line, F.lit(". ")) | F.contains(line, F.lit(" . . ")), by_token())
            .when(F.contains(line, F.lit(" . ")), by_clause(line))
            .otherwise(result(toks, F.lit(0)))
        )

    return let(text.untokens(toks), choose)


def join_clauses(clauses: Column, row_key: Column, seed: int) -> Column:
    """One run-on line from already opened clauses; every clause but the last is closed."""
    return F.array_join(
        F.transform(
            clauses,
            lambda c, j: F.when(
                j < F.size(clauses) - 1,
                close_clause(c, lane(draw_hash(seed, "close", row_key, j))),
            ).otherwise(c),
        ),
        " ",
    )


def opened_line(toks: Column, is_proper: Column) -> Column:
    """A token array as a clause string with its first token opened."""
    return F.concat_ws(
        " ",
        open_clause(F.element_at(toks, 1), is_proper),
        F.slice(toks, 2, F.greatest(F.size(toks), F.lit(1))),
    )


def repair_paraphrase(original: Column, phrase: Column) -> Column:
    """Give a paraphrase the capital, closing mark and enclosure of the original."""
    mark = f"{text.PUNCTUATION}$"
    size = F.length(original)
    first, last = F.substr(original, F.lit(1), F.lit(1)), F.substr(original, size, F.lit(1))
    before = F.substr(original, size - 1, F.lit(1))
    inner = F.when((size > 1) & before.rlike(mark), before).otherwise(F.lit(""))
    cap = text.capitalise(phrase)
    return (
        F.when(~original.rlike(mark) | phrase.rlike(mark), cap)
        .when((first == '"') & (last == '"'), F.concat(F.lit('"'), cap, inner, F.lit('"')))
        .when((first == "(") & (last == ")"), F.concat(F.lit("("), cap, inner, F.lit(")")))
        .otherwise(F.concat(cap, last))
    )
