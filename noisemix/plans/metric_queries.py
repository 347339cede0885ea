"""Queries on corpus metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from noisemix.functions import text
from noisemix.operators import metrics
from noisemix.plans import sql as S
from noisemix.plans.catalog import query
from noisemix.plans.text_queries import KEYS
from noisemix.sources.corpora import HYPOTHESIS_SQL, document_lines, hypothesis_pairs, table

BY = ["system", "eval_set"]


def _thirteen(x: str) -> str:
    s = f"replace({x}, '<skipped>', '')"
    for entity, char in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        s = f"replace({s}, '{entity}', '{char}')"
    s = f"' ' || {s} || ' '"
    for pattern, put in (
        (r"([\{-~\[-` -&\(-\+:-@/])", r" \1 "),
        (r"([^0-9])([\.,])", r"\1 \2 "),
        (r"([\.,])([^0-9])", r" \1 \2"),
        (r"([0-9])(-)", r"\1 \2 "),
    ):
        s = f"regexp_replace({s}, '{pattern}', '{put}', 'g')"
    return S.tokens(s)


def bleu_sql(units: str, name: str, smooth: bool) -> str:
    """Relation ``name`` of scores from ``units(system, eval_set, rid, h, r)``."""
    def side(c: str) -> str:
        return " UNION ALL ".join(
            f"SELECT system, eval_set, rid, {n} AS n, g{n} AS g FROM {name}_{c} WHERE g{n} IS NOT NULL"
            for n in range(1, 5)
        )

    def grams(c: str) -> str:
        made = ["t"]
        for n in range(1, 4):
            made.append(f"{made[-1]} || chr(31) || lead(t, {n}) OVER w")
        return f"""{name}_{c} AS (SELECT system, eval_set, rid, {", ".join(f"{g} AS g{n + 1}" for n, g in enumerate(made))}
  FROM (SELECT system, eval_set, rid, unnest({c}) AS t, unnest(range(len({c}))) AS i FROM {units})
  WINDOW w AS (PARTITION BY system, eval_set, rid ORDER BY i)),
"""

    share = "match::double"
    if smooth:
        share = "CASE WHEN match > 0 THEN match::double ELSE pow(0.5::double, zeros) END"
    else:
        share = "CASE WHEN match > 0 THEN match::double END"
    return grams("h") + grams("r") + f"""{name}_match AS (
  SELECT system, eval_set, n, sum(least(ch, cr))::bigint AS match FROM (
    SELECT system, eval_set, rid, n, g, count(*) AS ch FROM ({side("h")}) GROUP BY ALL)
  JOIN (SELECT system, eval_set, rid, n, g, count(*) AS cr FROM ({side("r")}) GROUP BY ALL)
    USING (system, eval_set, rid, n, g) GROUP BY ALL),
{name}_total AS (
  SELECT system, eval_set, n, sum(greatest(len(h) - n + 1, 0))::bigint AS total
  FROM {units}, (VALUES (1), (2), (3), (4)) o(n) GROUP BY ALL),
{name}_len AS (
  SELECT system, eval_set, sum(len(h))::bigint AS hyp_len, sum(len(r))::bigint AS ref_len
  FROM {units} GROUP BY ALL),
{name}_n AS (
  SELECT *, sum((match = 0)::int) OVER (PARTITION BY system, eval_set ORDER BY n) AS zeros FROM (
    SELECT system, eval_set, n, coalesce(match, 0) AS match, total
    FROM {name}_total LEFT JOIN {name}_match USING (system, eval_set, n))),
{name} AS (
  SELECT system, eval_set, hyp_len, ref_len, round(bp, 6) AS brevity, {", ".join(
      f"max(CASE WHEN n = {n} THEN match END) AS match_{n}, max(CASE WHEN n = {n} THEN total END) AS total_{n}"
      for n in range(1, 5))},
    round(CASE WHEN count({share} / nullif(total, 0)) = 4
      THEN 100.0::double * bp * exp(sum(ln({share} / nullif(total, 0))) / 4) ELSE 0.0::double END, 6) AS bleu
  FROM {name}_n JOIN (SELECT *, CASE WHEN hyp_len = 0 THEN 0.0::double
      WHEN hyp_len < ref_len THEN exp(1 - ref_len::double / hyp_len) ELSE 1.0::double END AS bp
    FROM {name}_len) USING (system, eval_set)
  GROUP BY system, eval_set, hyp_len, ref_len, bp)"""


def _units(fn) -> str:
    return (
        f"units AS (SELECT system, eval_set, concat(doc_id, ':', pos) AS rid, {fn('hyp')} AS h, "
        f"{fn('ref')} AS r FROM pairs)"
    )


@query(
    "e4_word_bleu",
    S.with_(S.LINES, S.pairs(), _units(_thirteen), bleu_sql("units", "b", True), select="SELECT * FROM b"),
)
def e4(spark, sf_dir):
    unit = metrics.UNITS["word"]
    lines = document_lines(spark, sf_dir).withColumn("ref_units", unit(F.col("src")))
    pairs = hypothesis_pairs(lines, "ref_units")  # a line is cut once for all its hypotheses
    hyp = F.when(F.col("hyp") == F.col("ref"), F.col("ref_units")).otherwise(unit(F.col("hyp")))
    return metrics.corpus_bleu(pairs, BY, hyp, F.col("ref_units"), smooth=True)


_CHAR = HYPOTHESIS_SQL[("robust", "l2")]


@query(
    "e5_character_bleu",
    S.with_(
        S.LINES,
        f"""units AS (SELECT lang AS system, split AS eval_set, row_key AS rid,
  regexp_extract_all({_CHAR}, '.') AS h, regexp_extract_all(src, '.') AS r FROM lines)""",
        bleu_sql("units", "b", False),
        select="SELECT system AS lang, eval_set AS split, * EXCLUDE (system, eval_set) FROM b",
    ),
)
def e5(spark, sf_dir):
    lines = document_lines(spark, sf_dir).withColumn("hyp", F.expr(_CHAR))
    unit = metrics.UNITS["char"]
    return metrics.corpus_bleu(lines, ["lang", "split"], unit(F.col("hyp")), unit(F.col("src")))


@query("e7_translation_edit_rate")
def e7(spark, sf_dir):
    pairs = hypothesis_pairs(document_lines(spark, sf_dir))
    return metrics.corpus_ter(pairs, BY, text.tokens(F.col("hyp")), text.tokens(F.col("ref")))


@query("e7_word_error_rate")
def e7_wer(spark, sf_dir):
    pairs = hypothesis_pairs(document_lines(spark, sf_dir))
    return metrics.corpus_wer(pairs, BY, text.tokens(F.col("hyp")), text.tokens(F.col("ref")))


_METEOR = """places AS (
  SELECT rid, system, eval_set, w, i, row_number() OVER (PARTITION BY rid, system, eval_set, w ORDER BY i DESC) AS copy
  FROM (SELECT rid, system, eval_set, unnest({side}) AS w, unnest(range(len({side}))) AS i FROM units))"""

METEOR = f"""m_h AS ({_METEOR.format(side="h").split("AS (", 1)[1][:-1]}),
m_r AS ({_METEOR.format(side="r").split("AS (", 1)[1][:-1]}),
m_pair AS (
  SELECT rid, system, eval_set, h.i AS hi, r.i AS ri FROM m_h h JOIN m_r r USING (rid, system, eval_set, w, copy)),
m_chunk AS (
  SELECT rid, system, eval_set, count(*) AS matches, count(*) FILTER (
    hi <> coalesce(ph, -9) + 1 OR ri <> coalesce(pr, -9) + 1) AS chunks
  FROM (SELECT *, lag(hi) OVER w AS ph, lag(ri) OVER w AS pr FROM m_pair
        WINDOW w AS (PARTITION BY rid, system, eval_set ORDER BY hi)) GROUP BY ALL),
m AS (
  SELECT system, eval_set, sum(matches)::bigint AS matches, sum(chunks)::bigint AS chunks,
    round(avg(CASE WHEN matches > 0 THEN (1 - 0.5::double * pow(chunks::double / matches, 3)) *
      (matches::double / len(h)) * (matches::double / len(r)) /
      (0.9::double * (matches::double / len(h)) + 0.1::double * (matches::double / len(r)))
      ELSE 0.0::double END) * 100.0::double, 6) AS meteor
  FROM (SELECT rid, system, eval_set, h, r, coalesce(matches, 0) AS matches, coalesce(chunks, 0) AS chunks
        FROM units LEFT JOIN m_chunk USING (rid, system, eval_set)) GROUP BY system, eval_set)"""


def _lower_tokens(x: str) -> str:
    return S.tokens(f"lower({x})")


@query(
    "e8_meteor",
    S.with_(S.LINES, S.pairs(), _units(_lower_tokens), METEOR, select="SELECT * FROM m"),
)
def e8(spark, sf_dir):
    pairs = hypothesis_pairs(document_lines(spark, sf_dir))
    return metrics.corpus_meteor(pairs, BY, text.tokens(F.col("hyp")), text.tokens(F.col("ref")))


@query(
    "e9_embedding_score",
    """WITH t AS (SELECT vec_id // 16 AS sent_id, vec_id % 16 // 2 AS pos,
  CASE WHEN vec_id % 2 = 0 THEN 'hyp' ELSE 'ref' END AS side, embedding::double[] AS vec FROM embeddings),
c AS (SELECT h.sent_id, h.pos AS hp, r.pos AS rp, list_cosine_similarity(h.vec, r.vec) AS c
  FROM t h JOIN t r ON h.sent_id = r.sent_id AND h.side = 'hyp' AND r.side = 'ref'),
p AS (SELECT sent_id, avg(b) AS p FROM (SELECT sent_id, hp, max(c) AS b FROM c GROUP BY 1, 2) GROUP BY 1),
q AS (SELECT sent_id, avg(b) AS r FROM (SELECT sent_id, rp, max(c) AS b FROM c GROUP BY 1, 2) GROUP BY 1)
SELECT sent_id, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1
FROM p JOIN q USING (sent_id)""",
)
def e9(spark, sf_dir):
    """Sixteen consecutive vectors make a sentence pair, even ones the hypothesis."""
    vec_id = F.col("vec_id")
    vectors = table(spark, sf_dir, "embeddings").select(
        F.floor(vec_id / 16).cast("long").alias("sent_id"),
        F.floor(vec_id % 16 / 2).cast("int").alias("pos"),
        F.when(vec_id % 2 == 0, "hyp").otherwise("ref").alias("side"),
        F.col("embedding").alias("vec"),
    )
    return metrics.embedding_score(vectors, ["sent_id"])


@query(
    "e10_score_matrix",
    S.with_(
        S.LINES,
        S.pairs(),
        _units(_lower_tokens).replace("units AS", "lower_units AS"),
        METEOR.replace("FROM units", "FROM lower_units"),
        _units(S.tokens),
        bleu_sql("units", "b", False),
        "s AS (SELECT system, eval_set, bleu, meteor FROM b JOIN m USING (system, eval_set))",
        select="SELECT system, "
        + ", ".join(
            f"max(CASE WHEN eval_set = '{e}' THEN {x} END) AS {e}_{x}"
            for e in ("ref", "l2")
            for x in ("bleu", "meteor")
        )
        + ", "
        + ", ".join(
            f"round(max(CASE WHEN eval_set = 'ref' THEN {x} END) - "
            f"max(CASE WHEN eval_set = 'l2' THEN {x} END), 6) AS gap_{x}"
            for x in ("bleu", "meteor")
        )
        + " FROM s GROUP BY system",
    ),
)
def e10(spark, sf_dir):
    pairs = hypothesis_pairs(document_lines(spark, sf_dir))
    hyp, ref = text.tokens(F.col("hyp")), text.tokens(F.col("ref"))
    scores = metrics.corpus_scores(pairs, BY, hyp, ref, [metrics.bleu(), metrics.METEOR])
    return metrics.score_matrix(scores, ["bleu", "meteor"])
