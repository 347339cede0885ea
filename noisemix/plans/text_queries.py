"""Queries on the text scalars."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from noisemix.functions import clauses, text
from noisemix.functions.draws import uniform
from noisemix.functions.typos import word_weights
from noisemix.operators.lexicon import mark_proper_nouns, mine_proper_nouns
from noisemix.operators.noise import prepare
from noisemix.plans import sql as S
from noisemix.plans.catalog import SEED, query
from noisemix.sources.checkpoints import shared_folder
from noisemix.sources.corpora import (
    conversation_pairs,
    denoising_pairs,
    document_lines,
    numbered_lines,
    rotated_candidates,
)
from noisemix.sources.sinks import reuse

KEYS = ["doc_id", "pos"]


@query(
    "b1_tokens",
    S.with_(
        S.LINES,
        select=f"""SELECT doc_id, pos, len(tk) AS n_tokens, tk[1] AS first_token, tk[-1] AS last_token
FROM (SELECT doc_id, pos, {S.tokens("src")} AS tk FROM lines)""",
    ),
)
def b1(spark, sf_dir):
    df = document_lines(spark, sf_dir).withColumn("tk", text.tokens(F.col("src")))
    return df.select(
        *KEYS,
        F.size("tk").cast("long").alias("n_tokens"),
        F.element_at("tk", 1).alias("first_token"),
        F.element_at("tk", -1).alias("last_token"),
    )


@query(
    "b2_join_tokens",
    S.with_(
        S.LINES,
        select=f"SELECT doc_id, pos, {S.joined(S.tokens('src'))} AS joined FROM lines",
    ),
)
def b2(spark, sf_dir):
    return document_lines(spark, sf_dir).select(
        *KEYS, text.untokens(text.tokens(F.col("src"))).alias("joined")
    )


@query(
    "b3_collapse_spaces",
    S.with_(
        S.LINES,
        select="SELECT doc_id, pos, trim(regexp_replace(replace(src, 'e', '  '), ' +', ' ', 'g')) "
        "AS collapsed FROM lines",
    ),
)
def b3(spark, sf_dir):
    return document_lines(spark, sf_dir).select(
        *KEYS, text.collapse_spaces(F.expr("replace(src, 'e', '  ')")).alias("collapsed")
    )


@query(
    "b4_sentence_end",
    S.with_(
        S.LINES,
        select=f"""SELECT lang, source, count(*) AS n_tokens,
  count(*) FILTER ({S.ends_sentence("t")}) AS n_ends
FROM (SELECT lang, source, unnest({S.tokens("src")}) AS t FROM lines) GROUP BY ALL""",
    ),
)
def b4(spark, sf_dir):
    df = document_lines(spark, sf_dir).select(
        "lang", "source", F.explode(text.tokens(F.col("src"))).alias("t")
    )
    return df.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.count_if(text.ends_sentence(F.col("t"))).alias("n_ends"),
    )


@query(
    "b5_detach_periods",
    S.with_(
        S.LINES,
        select=f"""SELECT doc_id, pos, len(tk) AS n_tokens, {S.joined("tk")} AS detached
FROM (SELECT doc_id, pos, {S.detached("src")} AS tk FROM lines)""",
    ),
)
def b5(spark, sf_dir):
    df = document_lines(spark, sf_dir).withColumn("tk", text.detach_periods(F.col("src")))
    return df.select(
        *KEYS, F.size("tk").cast("long").alias("n_tokens"), text.untokens(F.col("tk")).alias("detached")
    )


@query(
    "b6_reattach_periods",
    S.with_(
        S.LINES,
        select=f"""SELECT doc_id, pos, {S.joined(S.reattached("tk"))} AS reattached,
  {S.joined(S.reattached("tk"))} = {S.norm("src")} AS restored
FROM (SELECT doc_id, pos, src, {S.detached("src")} AS tk FROM lines)""",
    ),
)
def b6(spark, sf_dir):
    df = document_lines(spark, sf_dir).withColumn(
        "reattached", text.untokens(text.reattach_periods(text.detach_periods(F.col("src"))))
    )
    return df.select(
        *KEYS,
        "reattached",
        (F.col("reattached") == text.normalise_space(F.col("src"))).alias("restored"),
    )


_SHORT = "CASE WHEN length(src) < 20 THEN ' ' ELSE src END"


@query(
    "b7_nonempty_pairs",
    S.with_(
        S.LINES,
        select=f"""SELECT split, count(*) AS n_pairs, count(*) FILTER (
  len({S.tokens("src")}) > 0 AND length({S.norm(_SHORT)}) > 0) AS n_kept FROM lines GROUP BY split""",
    ),
)
def b7(spark, sf_dir):
    pairs = document_lines(spark, sf_dir).withColumn("tgt", F.expr(_SHORT))
    kept = text.is_pair(text.tokens(F.col("src")), F.col("tgt"))
    return pairs.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_if(kept).alias("n_kept")
    )


_SPACED = "replace(replace(replace(src, '.', ' .'), ',', ' ,'), '!', ' !')"


@query(
    "b8_detokenise",
    S.with_(
        S.LINES,
        select=f"""SELECT doc_id, pos, trim(replace(replace(replace(replace({_SPACED},
  ' .', '.'), ' ,', ','), ' ?', '?'), ' !', '!')) AS plain FROM lines""",
    ),
)
def b8(spark, sf_dir):
    return document_lines(spark, sf_dir).select(
        *KEYS, text.detokenise(F.expr(_SPACED)).alias("plain")
    )


@query(
    "b9_space_blind_equality",
    S.with_(
        S.LINES,
        select=f"""SELECT doc_id, pos, {S.norm("src")} <> {S.norm("replace(src, 'the', ' ')")} AS changed
FROM lines""",
    ),
)
def b9(spark, sf_dir):
    return document_lines(spark, sf_dir).select(
        *KEYS, text.differs(F.col("src"), F.expr("replace(src, 'the', ' ')")).alias("changed")
    )


@query(
    "b10_strip_punctuation",
    S.with_(
        S.LINES,
        select=f"""SELECT lang, t AS token, {S.strip("t")} AS stripped,
  {S.letters_only(S.strip("t"))} AS letters, count(*) AS n
FROM (SELECT lang, unnest({S.tokens("src")}) AS t FROM lines) GROUP BY ALL""",
    ),
)
def b10(spark, sf_dir):
    df = document_lines(spark, sf_dir).select(
        "lang", F.explode(text.tokens(F.col("src"))).alias("token")
    )
    stripped = text.strip_punctuation(F.col("token"))
    # count first: the scalars then run once per distinct token
    return (
        df.groupBy("lang", "token")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "lang", "token", stripped.alias("stripped"), text.is_letters(stripped).alias("letters"), "n"
        )
    )


@query(
    "b11_punctuation_tokens",
    S.with_(
        S.LINES,
        select=f"""SELECT doc_id, pos, len(list_filter(tk, lambda x: {S.strip("x")} = '')) AS n_marks
FROM (SELECT doc_id, pos, {S.detached("src")} AS tk FROM lines)""",
    ),
)
def b11(spark, sf_dir):
    toks = text.detach_periods(F.col("src"))
    return document_lines(spark, sf_dir).select(
        *KEYS, F.size(F.filter(toks, text.is_punctuation_only)).cast("long").alias("n_marks")
    )


@query(
    "b12_typo_eligibility",
    S.with_(
        S.LINES,
        select=f"""SELECT doc_id, pos, len(words) AS n_words,
  len(tk) >= 4 AND len(list_filter(tk, lambda x: {S.letters_only(S.strip("x"))})) > 0 AS eligible
FROM (SELECT *, list_filter(tk, lambda x: length({S.strip("x")}) >= 6
        AND {S.letters_only(S.strip("x"))}) AS words
      FROM (SELECT doc_id, pos, {S.detached("src")} AS tk FROM lines))""",
    ),
)
def b12(spark, sf_dir):
    df = document_lines(spark, sf_dir).withColumn("tk", text.detach_periods(F.col("src")))
    return df.select(
        *KEYS,
        F.size(F.filter(word_weights(F.col("tk")), lambda w: w > 0)).cast("long").alias("n_words"),
        (
            (F.size("tk") >= 4)
            & F.exists("tk", lambda t: text.is_letters(text.strip_punctuation(t)))
        ).alias("eligible"),
    )


@query(
    "k2_proper_nouns",
    S.with_(S.LINES, S.BASE, select="SELECT word, inside, capitalised FROM lexicon"),
)
def k2(spark, sf_dir):
    return mine_proper_nouns(document_lines(spark, sf_dir))


def lexicon(spark, sf_dir):
    """Mined once per application and table."""
    name = hashlib.md5(f"lexicon|{sf_dir}".encode()).hexdigest()
    return reuse(
        spark,
        f"{shared_folder(spark)}/lexicon-{name}",
        lambda: mine_proper_nouns(document_lines(spark, sf_dir)),
    )


def marked_lines(spark, sf_dir, numbered=False, overall=False):
    """Prepared document lines with proper nouns marked, numbered inside their split (and overall) if need be."""
    pairs = denoising_pairs(spark, sf_dir)
    if numbered:
        pairs = numbered_lines(spark, sf_dir, overall).withColumn("tgt", F.col("src"))
    return mark_proper_nouns(pairs.transform(prepare(KEYS)), lexicon(spark, sf_dir), KEYS)


@query(
    "b13_open_clause",
    S.with_(
        S.LINES,
        S.BASE,
        select=f"""SELECT doc_id, pos, {S.open_token("tokens[1]", "list_contains(proper_at, 0)")} AS opened
FROM base""",
    ),
)
def b13(spark, sf_dir):
    return marked_lines(spark, sf_dir).select(
        *KEYS,
        clauses.open_clause(
            F.element_at("tokens", 1), F.array_contains("proper_at", 0)
        ).alias("opened"),
    )


_QUOTED = """CASE pos % 4 WHEN 0 THEN src WHEN 1 THEN src || '"' WHEN 2 THEN rtrim(src, '.') || '"'
  ELSE src || ' "' END"""


@query(
    "b14_close_clause",
    S.with_(
        S.LINES,
        select=f"""SELECT doc_id, pos, {S.close_clause("c", S.uniform("close", "row_key", "0"))} AS closed
FROM (SELECT doc_id, pos, row_key, {S.norm(_QUOTED)} AS c FROM lines)""",
    ),
)
def b14(spark, sf_dir):
    quoted = _QUOTED.replace("rtrim(src, '.')", "rtrim('.', src)")
    return (
        document_lines(spark, sf_dir)
        .withColumn("c", text.normalise_space(F.expr(quoted)))
        .select(
            *KEYS,
            clauses.close_clause(
                F.col("c"), uniform(SEED, "close", F.concat_ws(":", "doc_id", "pos"), 0)
            ).alias("closed"),
        )
    )


CANDIDATES = r"""candidates AS (
  SELECT doc_id, pos, "by" - 1 AS rank,
    array_to_string(list_concat(parts["by" + 1:], parts[1:"by"]), ' ') AS phrase
  FROM (SELECT doc_id, pos, parts, unnest(range(1, len(parts))) AS "by"
        FROM (SELECT doc_id, pos, string_split(src, '. ') AS parts FROM lines)))"""


def repaired_sql(original: str, phrase: str) -> str:
    cap, mark = S.capital(phrase), f"{S.PUNCT}$"
    inner = f"CASE WHEN regexp_matches(left(right({original}, 2), 1), '{S.PUNCT}') AND length({original}) > 1 THEN left(right({original}, 2), 1) ELSE '' END"
    return (
        f"(CASE WHEN NOT regexp_matches({original}, '{mark}') OR regexp_matches({phrase}, '{mark}') "
        f"THEN {cap} WHEN left({original}, 1) = '\"' AND right({original}, 1) = '\"' "
        f"THEN '\"' || {cap} || {inner} || '\"' "
        f"WHEN left({original}, 1) = '(' AND right({original}, 1) = ')' "
        f"THEN '(' || {cap} || {inner} || ')' ELSE {cap} || right({original}, 1) END)"
    )


_ENCLOSED = """CASE pos % 3 WHEN 0 THEN src WHEN 1 THEN '"' || src || '"' ELSE '(' || src || ')' END"""


@query(
    "b15_repair_paraphrase",
    S.with_(
        S.LINES,
        CANDIDATES,
        select=f"""SELECT doc_id, pos, rank::bigint AS rank, {repaired_sql("original", "phrase")} AS repaired
FROM (SELECT doc_id, pos, {_ENCLOSED} AS original FROM lines) JOIN candidates USING (doc_id, pos)""",
    ),
)
def b15(spark, sf_dir):
    lines = document_lines(spark, sf_dir)
    originals = lines.select(*KEYS, F.expr(_ENCLOSED).alias("original"))
    return originals.join(rotated_candidates(lines), KEYS).select(
        *KEYS,
        F.col("rank").cast("long").alias("rank"),
        clauses.repair_paraphrase(F.col("original"), F.col("phrase")).alias("repaired"),
    )


@query(
    "b18_remove_subword_marks",
    S.with_(
        S.LINES,
        select=f"SELECT doc_id, pos, {S.norm('src')} AS plain FROM lines",
    ),
)
def b18(spark, sf_dir):
    from noisemix.operators.subword import pieces_to_text

    marked = F.concat(
        F.lit(S.MARK), F.replace(text.normalise_space(F.col("src")), F.lit(" "), F.lit(S.MARK))
    )
    return document_lines(spark, sf_dir).select(
        *KEYS, pieces_to_text(text.characters(marked)).alias("plain")
    )


@query(
    "d7_conversation_pairs",
    """SELECT u.conv_id, u.turn, u.text AS src, a.text AS tgt FROM conversations u
JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'""",
)
def d7(spark, sf_dir):
    return conversation_pairs(spark, sf_dir)
