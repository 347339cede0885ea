"""Proper nouns mined from the corpus, and their positions in a line.

A word is proper when more than half of its occurrences inside a sentence are
capitalised.  This plays the role of a part-of-speech tagger with a different rule,
so the casing of some clause openings differs from what a tagger would give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noisemix.functions import text
from noisemix.sources.checkpoints import cut

# Above this many words the lexicon is joined instead of shipped inside the plan.
INLINE_WORDS = 20_000
# The word that opens a line, or follows one that ends a sentence.
_OPENING = r"^[^ ]+|(?<=[.?!][\x85\u2028\u2029]?) [^ ]+"
# The token after a period that stands alone.
_OPENS = r"(?<=(?:^| )\. )[^ ]+"
# Opening words with at least this share of all openings don't travel.
HOT_SHARE = 0.001


def _word(token: Column) -> Column:
    return F.lower(text.strip_punctuation(token))


def mine_proper_nouns(df: DataFrame, line: str = "src") -> DataFrame:
    """``lexicon(word, inside, capitalised)``; one map-side combined shuffle on the word."""
    # three passes over the line, whatever its number of words: the words that open a sentence go, then the marks
    inside = F.regexp_replace(text.normalise_space(F.col(line)), _OPENING, "")
    # outer: for a plain explode the optimizer would ask first whether there are words, and cut the line twice
    words = df.select(F.explode_outer(F.split(text.strip_punctuation(inside), " ")).alias("w")).filter("w != ''")
    first = F.substring("w", 1, 1)
    return (
        words.groupBy(F.lower("w").alias("word"))
        .agg(
            F.count(F.lit(1)).alias("inside"),
            F.sum((first != F.lower(first)).cast("long")).alias("capitalised"),
        )
        .filter(F.col("capitalised") * 2 > F.col("inside"))
    )


def mark_proper_nouns(
    df: DataFrame, lexicon: DataFrame, keys: list[str], inline_words: int = INLINE_WORDS
) -> DataFrame:
    """Add ``proper_at``: the numbers of the clauses that open with a proper noun.

    Clause 0 is the start of the line, clause ``j`` follows its ``j``-th detached period.
    A lexicon of at most ``inline_words`` words becomes a hash-set predicate in the plan
    (no shuffle).  A larger one is joined on the word; lines then meet their matches on
    ``keys``.  Both ways give the same column.
    """
    words = [r[0] for r in lexicon.select("word").limit(inline_words + 1).collect()]
    toks = F.col("tokens")

    def openings(opens: Column) -> Column:
        return F.transform(opens, lambda t, j: F.struct(j.alias("clause"), _word(t).alias("word")))

    # a period that is not last opens a clause with the token after it
    opens = F.concat(F.slice(toks, 1, 1), F.regexp_extract_all(text.untokens(toks), F.lit(_OPENS), F.lit(0)))
    if len(words) <= inline_words:
        known = (lambda w: w.isin(words)) if words else (lambda w: F.lit(False))
        return df.withColumn(
            "proper_at",
            F.transform(
                F.filter(openings(opens), lambda o: known(o["word"])), lambda o: o["clause"]
            ),
        )
    # frequent opening words, names or not, are settled by broadcast: 1 / share of them at most
    each = df.select(*keys, F.inline(openings(opens)))
    counts = each.groupBy("word").agg(F.count(F.lit(1)).alias("_n"))
    names = lexicon.select("word", F.lit(True).alias("_name"))
    looked_up = cut(counts.join(names, "word", "left").withColumn("_name", F.coalesce("_name", F.lit(False))))
    total = looked_up.agg(F.sum("_n")).first()[0] or 0
    is_hot = F.col("_n") >= F.lit(total * HOT_SHARE)
    each = each.join(F.broadcast(looked_up.filter(is_hot).select("word", "_name")), "word", "left")
    rare = looked_up.filter(~is_hot & F.col("_name")).select("word")
    found = (
        each.filter("_name")
        .select(*keys, "clause")
        .unionByName(each.filter("_name IS NULL").join(rare, "word").select(*keys, "clause"))
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list("clause")).alias("proper_at"))
    )
    return df.join(found, keys, "left").withColumn(
        "proper_at", F.coalesce("proper_at", F.array().cast("array<int>"))
    )


def no_proper_nouns(df: DataFrame) -> DataFrame:
    """Every clause opening is lower-cased."""
    return df.withColumn("proper_at", F.array().cast("array<int>"))
