"""Token and sentence scalars.  Whitespace is ASCII whitespace throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# any whitespace that is not one plain space
_ODD_SPACE = r"[\t\n\x0B\f\r][ \t\n\x0B\f\r]*| [ \t\n\x0B\f\r]+"
PUNCTUATION = r"[!-/:-@\[-`{-~]"

# Word endings whose final period does not end a sentence.
ABBREVIATIONS = [
    "a.m.", "p.m.", "A.M.", "P.M.", "A.m.", "P.m.", "e.g.", "E.g.", "E.G.", "i.e.", "I.e.",
    "cf.", "U.S.", "Mr.", "St.", "Mrs.", "Ms.", "Dr.", "Inc.", "No.", "...",
]

# A word with any capital is never split, so only all-lower endings need a pattern.
_KEPT = [a.replace(".", r"\.") for a in ABBREVIATIONS if a == a.lower()]
# a word is read once: only a period before a space can end it
_DETACH = r"(?<![^ ])((?:[^ A-Z.]++|\.(?! ))++)\.(?= )(?<!" + "|".join(_KEPT) + ")"


def collapse_spaces(c: Column) -> Column:
    """Repeated spaces become one; outer spaces go."""
    return F.trim(F.regexp_replace(c, " +", " "))


def normalise_space(c: Column) -> Column:
    """Any whitespace run becomes one space; outer whitespace goes."""
    return F.trim(F.regexp_replace(c, _ODD_SPACE, " "))


def tokens(c: Column) -> Column:
    """Whitespace tokens of a string; an empty array for a blank one."""
    return F.array_remove(F.split(normalise_space(c), " "), "")


def untokens(c: Column) -> Column:
    return F.array_join(c, " ")


def retokens(line: Column) -> Column:
    """The tokens that :func:`untokens` joined; they hold no spaces and are not empty."""
    return F.when(line != "", F.split(line, " ")).when(line.isNotNull(), F.array().cast("array<string>"))


def differs(a: Column, b: Column) -> Column:
    """True when two sentences differ by more than whitespace."""
    return normalise_space(a) != normalise_space(b)


def strip_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, PUNCTUATION, "")


def strip_tokens(toks: Column) -> Column:
    """Every token without punctuation, in one pass over the line; marks become ``''``."""
    return F.split(strip_punctuation(untokens(toks)), " ")


def is_letters(c: Column) -> Column:
    return c.rlike(r"^\p{L}+$")


def is_punctuation_only(token: Column) -> Column:
    return strip_punctuation(token) == ""


def ends_sentence(token: Column) -> Column:
    """A closing period that is neither an abbreviation nor follows a capital."""
    kept = F.lit(False)
    for suffix in ABBREVIATIONS:
        if suffix == suffix.lower():
            kept = kept | token.endswith(suffix)
    return token.endswith(".") & ~token.rlike("[A-Z]") & ~kept


def detach_periods(line: Column) -> Column:
    """Tokens with every sentence-final period but the last one on its own."""
    return F.array_remove(F.split(detached_line(line), " "), "")


def detached_line(line: Column) -> Column:
    """The tokens of :func:`detach_periods` joined by spaces."""
    return F.regexp_replace(normalise_space(line), _DETACH, "$1 .")


def reattach_periods(toks: Column) -> Column:
    """Undo :func:`detach_periods` on a token array."""
    return tokens(F.replace(untokens(toks), F.lit(" . "), F.lit(". ")))


def reattached_line(toks: Column) -> Column:
    """The tokens of :func:`reattach_periods` joined by spaces."""
    return normalise_space(F.replace(untokens(toks), F.lit(" . "), F.lit(". ")))


def not_blank(line: Column) -> Column:
    return line.rlike(r"[^ \t\n\x0B\f\r]")


def detokenise(c: Column) -> Column:
    """Drop the space before ``. , ? !`` and trim."""
    return F.regexp_replace(
        F.regexp_replace(c, " ([.,?!])", "$1"), r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", ""
    )


def is_pair(toks: Column, target: Column) -> Column:
    """Both sides of a pair hold something."""
    return (F.size(toks) > 0) & not_blank(target)


def capitalise(c: Column) -> Column:
    """First letter upper, the rest lower; a letter without a one-letter upper form stays."""
    first = F.substring(c, 1, 1)
    upper = F.upper(first)
    return F.concat(
        F.when(F.length(upper) == 1, upper).otherwise(first),
        F.lower(F.substring(c, 2, 2147483647)),
    )


def tokenise_13a(c: Column) -> Column:
    """Word units of the standard WMT scorer: punctuation split off, digits kept whole."""
    s = F.replace(c, F.lit("<skipped>"), F.lit(""))
    for entity, char in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        s = F.replace(s, F.lit(entity), F.lit(char))
    # most lines hold no markup and skip the five passes
    marked = F.contains(c, F.lit("&")) | F.contains(c, F.lit("<skipped>"))
    s = F.when(marked, s).otherwise(c)
    s = F.concat(F.lit(" "), s, F.lit(" "))
    s = F.regexp_replace(s, r"([\{-~\[-` -&\(-\+:-@/])", " $1 ")
    s = F.regexp_replace(s, r"([^0-9])([\.,])", "$1 $2 ")
    s = F.regexp_replace(s, r"([\.,])([^0-9])", " $1 $2")
    s = F.regexp_replace(s, r"([0-9])(-)", "$1 $2 ")
    return tokens(s)


def characters(c: Column) -> Column:
    """Code points of a string."""
    return F.when(F.length(c) > 0, F.split(c, "")).otherwise(F.array().cast("array<string>"))
