"""Queries on alignment, sampling, mixing and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noisemix.operators import mixing, noise, reports
from noisemix.operators.ordering import dense_row_number
from noisemix.plans import sql as S
from noisemix.plans.catalog import SEED, query
from noisemix.plans.noise_queries import BATCH, BATCH_KEYS, LINE_ORDER, PLAIN_RUNON, _recipe_sql, batched_lines
from noisemix.plans.text_queries import KEYS
from noisemix.sources.corpora import VARIANT_SQL, denoising_pairs, document_lines, line_variants

KINDS = list(VARIANT_SQL)
WEIGHTS = {k: i + 1 for i, k in enumerate(KINDS)}
RATIO = 3

CLEAN = "clean AS (SELECT doc_id, pos, split, row_key, src, src AS tgt FROM lines)"

def _detok(x: str) -> str:
    return (
        f"regexp_replace(replace(replace(replace(replace({x}, ' .', '.'), ' ,', ','), ' ?', '?'), ' !', '!'), "
        f"'^{S.WS}+|{S.WS}+$', '', 'g')"
    )


_WEIGHT_SQL = "MAP {" + ", ".join(f"'{k}': {w}" for k, w in WEIGHTS.items()) + "}[kind]"
HALF = repr(0.5 / 4294967296)

SAMPLE = [
    S.LINES,
    CLEAN,
    S.variants(),
    f"""ready AS (
  SELECT v.doc_id, v.pos, v.split, v.kind, v.src, c.row_key, {_detok("c.src")} AS clean_src,
    {S.norm("coalesce(CASE WHEN trim(v.tgt) <> '' THEN v.tgt END, c.tgt)")} AS tgt
  FROM (SELECT doc_id, pos, split, kind, {_detok("src")} AS src, tgt FROM variants) v
  JOIN clean c USING (doc_id, pos) WHERE v.src <> '')""",
    f"""ranked AS (
  SELECT *, count(*) OVER (PARTITION BY row_key) AS n,
    row_number() OVER (PARTITION BY row_key ORDER BY
      -ln({S.uniform("variant", "row_key", "kind")} + {HALF}::double) / {_WEIGHT_SQL}::double, kind) AS sample_rank
  FROM ready)""",
    f"""sampled AS (
  SELECT * FROM ranked WHERE sample_rank <=
    least(trunc({RATIO}::double + 2.0::double * {S.uniform("count", "row_key")} - 1.0::double)::int, n))""",
    """kept AS (
  SELECT * FROM (SELECT *, min(CASE WHEN src = clean_src THEN sample_rank END)
      OVER (PARTITION BY row_key) AS first_same FROM sampled)
  WHERE src <> clean_src OR sample_rank = first_same)""",
    f"""mixed AS (
  SELECT doc_id, pos, split, kind, src, tgt, sample_rank::int AS out_rank FROM kept
  UNION ALL SELECT doc_id, pos, split, 'clean', {S.norm("src")}, {S.norm("tgt")}, {len(KINDS) + 1}::int
  FROM clean)""",
]


def clean_and_variants(spark, sf_dir):
    clean = denoising_pairs(spark, sf_dir).select(*KEYS, "split", "src", "tgt")
    return clean, line_variants(document_lines(spark, sf_dir))


@query(
    "b16_skip_blank_variants",
    S.with_(
        S.LINES,
        S.variants(),
        select=f"""SELECT doc_id, pos, kind, s AS src FROM (
  SELECT doc_id, pos, kind, {_detok("CASE WHEN kind = 'dropone' THEN regexp_replace(src, '^[A-Z]+.*$', ' ') ELSE src END")} AS s
  FROM variants) WHERE s <> ''""",
    ),
)
def b16(spark, sf_dir):
    variants = line_variants(document_lines(spark, sf_dir)).withColumn(
        "src",
        F.expr("CASE WHEN kind = 'dropone' THEN regexp_replace(src, '^[A-Z]+.*$', ' ') ELSE src END"),
    )
    return mixing.skip_blank(variants).select(*KEYS, "kind", "src")


def ranked_lines(spark, sf_dir, lang):
    lines = document_lines(spark, sf_dir).filter(F.col("lang") == lang)
    return dense_row_number(lines.select(*KEYS, "src"), KEYS, "sent_id")


def _ranked(lang: str) -> str:
    return f"(SELECT row_number() OVER (ORDER BY doc_id, pos) - 1 AS sent_id, src FROM lines WHERE lang = '{lang}')"


TARGET_LANGS = ("de", "es", "fr")
ZIPPED = " UNION ALL ".join(
    f"""SELECT sent_id, '{lang}' AS lang, e.src, s.src AS tgt FROM {_ranked("en")} e JOIN {_ranked(lang)} s USING (sent_id)"""
    for lang in TARGET_LANGS
)


@query(
    "d1_positional_zip",
    S.with_(
        S.LINES,
        select=ZIPPED,
    ),
)
def d1(spark, sf_dir):
    """English lines paired by position with those of each other language; the shorter side decides the length."""
    english = ranked_lines(spark, sf_dir, "en").select("sent_id", "src")
    parts = [
        mixing.align(
            english,
            ranked_lines(spark, sf_dir, lang).select("sent_id", F.lit(lang).alias("lang"), F.col("src").alias("tgt")),
            ["sent_id"],
        )
        for lang in TARGET_LANGS
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "d2_align_kinds",
    S.with_(
        S.LINES,
        S.variants(),
        select="SELECT doc_id, pos, l.src, "
        + ", ".join(f"max(CASE WHEN kind = '{k}' THEN v.src END) AS \"{k}\"" for k in KINDS)
        + " FROM lines l LEFT JOIN variants v USING (doc_id, pos) GROUP BY doc_id, pos, l.src",
    ),
)
def d2(spark, sf_dir):
    clean, variants = clean_and_variants(spark, sf_dir)
    return mixing.align_kinds(clean.select(*KEYS, "src"), variants, KEYS, KINDS)


@query(
    "d3_target_fallback",
    S.with_(*SAMPLE[:4], select="SELECT doc_id, pos, kind, tgt FROM ready"),
)
def d3(spark, sf_dir):
    clean, variants = clean_and_variants(spark, sf_dir)
    return mixing.with_target(mixing.skip_blank(variants), clean, KEYS).select(*KEYS, "kind", "tgt")


@query(
    "d6_changed_by_kind",
    S.with_(
        S.LINES,
        S.variants(),
        select=f"""SELECT kind, count(*) FILTER ({S.norm("l.src")} <> {S.norm("v.src")}) AS n_changed,
  count(*) AS n_lines, round(count(*) FILTER ({S.norm("l.src")} <> {S.norm("v.src")}) * 100.0::double
    / count(*), 6) AS pct_changed
FROM lines l JOIN variants v USING (doc_id, pos) GROUP BY kind""",
    ),
)
def d6(spark, sf_dir):
    clean, variants = clean_and_variants(spark, sf_dir)
    pairs = mixing.align(
        clean.select(*KEYS, "src"), variants.select(*KEYS, "kind", F.col("src").alias("noisy")), KEYS
    )
    return reports.changed_rate(pairs, "src", "noisy", ["kind"])


@query(
    "f1_weighted_sample",
    S.with_(*SAMPLE[:6], select="SELECT doc_id, pos, kind, sample_rank::int AS sample_rank FROM sampled"),
)
def f1(spark, sf_dir):
    clean, variants = clean_and_variants(spark, sf_dir)
    ready = mixing.with_target(mixing.skip_blank(variants), clean, KEYS)
    return mixing.sample_variants(ready, KEYS, RATIO, SEED, WEIGHTS).select(
        *KEYS, "kind", "sample_rank"
    )


@query(
    "f2_jittered_count",
    S.with_(
        S.LINES,
        select=f"""SELECT doc_id, pos, least(trunc(2.0::double + 2.0::double * {S.uniform("count", "row_key")}
  - 1.0::double)::int, (pos % 4)::int) AS k FROM lines""",
    ),
)
def f2(spark, sf_dir):
    return document_lines(spark, sf_dir).select(
        *KEYS,
        mixing.jittered_count(2, F.col("pos") % 4, mixing.row_key(KEYS), SEED).alias("k"),
    )


@query(
    "f3_unchanged_once",
    S.with_(*SAMPLE[:7], select="SELECT doc_id, pos, kind, src FROM kept"),
)
def f3(spark, sf_dir):
    clean, variants = clean_and_variants(spark, sf_dir)
    ready = mixing.with_target(mixing.skip_blank(variants), clean, KEYS)
    sampled = mixing.sample_variants(ready, KEYS, RATIO, SEED, WEIGHTS)
    return mixing.drop_repeated_unchanged(sampled, KEYS).select(*KEYS, "kind", "src")


@query(
    "f4_sample_distinct",
    S.with_(
        S.LINES,
        S.variants(),
        "d AS (SELECT doc_id, pos, src, min(kind) AS kind FROM variants GROUP BY 1, 2, 3)",
        select=f"""SELECT doc_id, pos, kind, src, sample_rank::int AS sample_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, pos
    ORDER BY {S.uniform("distinct", "concat(doc_id, ':', pos)", "src")}, src) AS sample_rank FROM d)
WHERE sample_rank <= 3""",
    ),
)
def f4(spark, sf_dir):
    variants = line_variants(document_lines(spark, sf_dir))
    return mixing.sample_distinct(variants, KEYS, 3, SEED)


_REFS = {
    0: "src",
    1: "lower(src)",
    2: "replace(src, 'e', 'a')",
    3: "replace(src, 'a', 'o')",
}


@query(
    "f5_random_reference",
    S.with_(
        S.LINES,
        "refs AS ("
        + " UNION ALL ".join(
            f"SELECT doc_id, pos, row_key, {n}::int AS ref_no, {sql} AS text FROM lines"
            for n, sql in _REFS.items()
        )
        + ")",
        select=f"""SELECT doc_id, pos, ref_no, text FROM refs
WHERE ref_no = floor({S.uniform("reference", "row_key")} * 4)""",
    ),
)
def f5(spark, sf_dir):
    refs = F.array(
        *[F.struct(F.lit(n).alias("ref_no"), F.expr(sql).alias("text")) for n, sql in _REFS.items()]
    )
    rows = document_lines(spark, sf_dir).select(*KEYS, F.inline(refs))
    return mixing.pick_reference(rows, KEYS, 4, SEED)


@query(
    "f6_partner_order",
    S.with_(
        *_recipe_sql(PLAIN_RUNON),
        select="""SELECT l.doc_id, l.pos, string_agg(b.row_key, ' ' ORDER BY p.j) AS partners
FROM out_pair p JOIN lines l USING (row_key)
JOIN out_n n ON n.batch_id = p.batch_id AND n.me = p.who JOIN lines b ON b.row_key = n.row_key
GROUP BY 1, 2""",
    ),
)
def f6(spark, sf_dir):
    """The lines appended to each line, in order; targets are replaced by keys to read them off."""
    df = batched_lines(spark, sf_dir).withColumn("tgt", F.col("row_key"))
    out = df.transform(noise.apply_recipe(PLAIN_RUNON, BATCH_KEYS, LINE_ORDER, BATCH, SEED))
    partners = F.array_join(F.slice(F.split("noisy_tgt", " "), F.lit(2), F.size(F.split("noisy_tgt", " "))), " ")
    return out.filter("n_append > 0").select(*KEYS, partners.alias("partners"))


def mixed(spark, sf_dir, split=None):
    """The mix, of one split if need be."""
    clean, variants = clean_and_variants(spark, sf_dir)
    if split is not None:
        clean, variants = (df.filter(F.col("split") == split) for df in (clean, variants))
    return mixing.mix(clean, variants, KEYS, RATIO, SEED, WEIGHTS)


@query(
    "f7_mix",
    S.with_(*SAMPLE, select="SELECT doc_id, pos, split, kind, src, tgt, out_rank FROM mixed"),
)
def f7(spark, sf_dir):
    return mixed(spark, sf_dir)


@query(
    "f9_stable_order",
    S.with_(
        *SAMPLE,
        select="""SELECT row_number() OVER (ORDER BY doc_id, pos, out_rank) - 1 AS line_no, src
FROM mixed""",
    ),
)
def f9(spark, sf_dir):
    numbered = dense_row_number(mixed(spark, sf_dir), [*KEYS, "out_rank"], "line_no")
    return numbered.select("line_no", "src")


@query(
    "g1_clean_and_corrupted",
    S.with_(
        S.LINES,
        S.variants(),
        select="""SELECT doc_id, pos, split, 'clean' AS kind, src FROM lines
UNION ALL SELECT doc_id, pos, split, kind, src FROM variants WHERE kind = 'runon'""",
    ),
)
def g1(spark, sf_dir):
    clean, variants = clean_and_variants(spark, sf_dir)
    cols = [*KEYS, "split", "kind", "src"]
    return mixing.concat_corpora(
        clean.withColumn("kind", F.lit("clean")).select(*cols),
        variants.filter(F.col("kind") == "runon").select(*cols),
    )


@query(
    "g2_weighted_concat",
    S.with_(
        *SAMPLE,
        select="""SELECT kind, split, count(*) AS n, sum(length(src))::bigint AS chars FROM (
  SELECT kind, split, src FROM mixed UNION ALL
  SELECT kind, split, src FROM variants, (VALUES (1), (2)) copies(c) WHERE kind = 'para')
GROUP BY kind, split""",
    ),
)
def g2(spark, sf_dir):
    """The mix with the paraphrase set added twice."""
    _, variants = clean_and_variants(spark, sf_dir)
    cols = ["kind", "split", "src"]
    both = mixing.concat_corpora(
        mixed(spark, sf_dir).select(*cols),
        variants.filter(F.col("kind") == "para").select(*cols),
        repeat=2,
    )
    return both.groupBy("kind", "split").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("src")).alias("chars")
    )


@query(
    "g3_distinct_variants",
    S.with_(
        S.LINES,
        S.variants(),
        select="SELECT doc_id, pos, src, min(kind) AS kind FROM variants GROUP BY doc_id, pos, src",
    ),
)
def g3(spark, sf_dir):
    return mixing.distinct_variants(line_variants(document_lines(spark, sf_dir)), KEYS)
