"""Queries on sources, sinks, resuming, the paraphraser hook and streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noisemix.functions import text
from noisemix.operators import noise
from noisemix.operators.paraphrase import candidates_from
from noisemix.plans import sql as S
from noisemix.plans.catalog import SEED, query
from noisemix.plans.mixing_queries import SAMPLE, TARGET_LANGS, ZIPPED, mixed
from noisemix.plans.noise_queries import _READ, _RECIPE_SELECT, BATCH, KEYS, _recipe_output, _recipe_sql, marked_lines
from noisemix.plans.recipes import RECIPES, recipe
from noisemix.plans.subword_queries import ENCODED, PIECES, TRAINED, encoded_sides, recursive
from noisemix.plans.text_queries import CANDIDATES, lexicon
from noisemix.sources import bitext, blocks, sinks, versions
from noisemix.sources.checkpoints import scratch
from noisemix.sources.corpora import (
    HYPOTHESIS_SQL,
    all_lines_of,
    denoising_pairs,
    document_lines,
    line_variants,
    number_documents,
    numbered_lines,
    split_of,
    table,
)
from noisemix.streaming import incremental

# lines in a block: a multiple of the lines in a batch
BLOCK = 64 * BATCH


@query(
    "a1_read_bitext",
    S.with_(
        S.LINES,
        select=ZIPPED,
    ),
)
def a1(spark, sf_dir):
    """Lines of each language written as text files and read back by line number, paired with the English ones."""
    lines = document_lines(spark, sf_dir)
    paths = {}
    for lang in ("en", *TARGET_LANGS):
        paths[lang] = scratch(spark, f"bitext-{lang}")
        sinks.write_aligned_text(lines.filter(F.col("lang") == lang), KEYS, {"src": paths[lang]})
    english = bitext.read_lines(spark, paths["en"], "src")
    parts = [
        english.join(bitext.read_lines(spark, paths[lang], "tgt").withColumn("lang", F.lit(lang)), "sent_id")
        for lang in TARGET_LANGS
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "a2_read_variants",
    S.with_(
        S.LINES,
        S.variants(),
        select="""SELECT split, kind, count(*) AS n, sum(length(src))::bigint AS chars FROM variants
WHERE split = 'train' AND kind <> 'sva' GROUP BY split, kind""",
    ),
)
def a2(spark, sf_dir):
    """A variants table partitioned by split and kind; a missing kind is an empty partition."""
    path = scratch(spark, "variants")
    variants = line_variants(document_lines(spark, sf_dir)).filter(F.col("kind") != "sva")
    sinks.write_pairs(variants, path, ("split", "kind"))
    read = spark.read.parquet(path).filter(F.col("split") == "train")
    return read.groupBy("split", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("src")).alias("chars")
    )


_HYP = HYPOTHESIS_SQL[("base", "ref")]


@query(
    "a3_read_hypotheses",
    S.with_(
        S.LINES,
        select=f"""SELECT row_number() OVER (ORDER BY doc_id, pos) - 1 AS sent_id, {S.norm(_HYP)} AS hyp,
  {S.norm("src")} AS ref FROM lines""",
    ),
)
def a3(spark, sf_dir):
    """Aligned hypothesis and reference files."""
    lines = document_lines(spark, sf_dir).withColumn("hyp", F.expr(_HYP))
    paths = {"hyp": scratch(spark, "pred"), "src": scratch(spark, "tgt")}
    sinks.write_aligned_text(lines, KEYS, paths)
    read = bitext.read_bitext(spark, paths["hyp"], paths["src"])
    return read.select(
        "sent_id",
        text.normalise_space(F.col("src")).alias("hyp"),
        text.normalise_space(F.col("tgt")).alias("ref"),
    )


_LOG_HYP = "replace(src, 'the ', 'T-the ')"
_LOG_SQL = f"SELECT doc_id * 1000000 + pos AS sent_id, {S.norm(_LOG_HYP)} AS hyp, {S.norm('src')} AS ref FROM lines"


def generation_log(spark, sf_dir):
    """Decoder output lines made from the corpus: source, reference, hypotheses, scores."""
    tag = F.concat((F.col("doc_id") * 1000000 + F.col("pos")).cast("string"), F.lit("\t"))
    hyp = F.expr(_LOG_HYP)
    rows = F.array(
        F.concat(F.lit("S-"), tag, F.col("src")),
        F.concat(F.lit("T-"), tag, F.col("src")),
        F.concat(F.lit("H-"), tag, F.lit("-0.5\t"), hyp),
        F.concat(F.lit("D-"), tag, F.lit("-0.5\t"), hyp),
        F.concat(F.lit("P-"), tag, F.lit("-0.1 -0.2")),
    )
    return document_lines(spark, sf_dir).select(F.explode(rows).alias("value"))


@query("a4_generation_log", S.with_(S.LINES, select=_LOG_SQL))
def a4(spark, sf_dir):
    return bitext.parse_generation_log(generation_log(spark, sf_dir))


@query("a5_materialise_once", S.with_(S.LINES, select=_LOG_SQL))
def a5(spark, sf_dir):
    """Extracted pairs written once; the second request reads what the first one wrote."""
    path = scratch(spark, "extracted")
    pairs = bitext.parse_generation_log(generation_log(spark, sf_dir))
    sinks.write_once(pairs, path)
    return sinks.write_once(pairs, path)


@query(
    "a6_write_partitions",
    S.with_(*SAMPLE, select="SELECT doc_id, pos, split, kind, src, tgt, out_rank FROM mixed"),
)
def a6(spark, sf_dir):
    """The mix written by split, then one split rewritten: nothing is doubled."""
    path = scratch(spark, "mixed")
    rows = mixed(spark, sf_dir)
    sinks.write_pairs(rows, path)
    sinks.write_pairs(mixed(spark, sf_dir, "dev"), path)
    return sinks.read_pairs(spark, path).select(*rows.columns)


@query(
    "a7_dry_run",
    S.with_(
        S.LINES,
        S.BASE,
        S.noise("base", "own", RECIPES["both"]),
        select="""SELECT count(*) AS lines, sum(coalesce(sub, 0))::bigint AS sub_typos,
  sum(coalesce(swap, 0))::bigint AS swap_typos, sum(coalesce(runon, 0))::bigint AS inline_runons FROM own""",
    ),
)
def a7(spark, sf_dir):
    """The whole noise job without output; only the observed counters come back."""
    noised = marked_lines(spark, sf_dir).transform(noise.compound_noise(RECIPES["both"], SEED))
    seen = sinks.dry_run(
        noised,
        "noise",
        F.count(F.lit(1)).alias("lines"),
        F.sum("n_sub").alias("sub_typos"),
        F.sum("n_swap").alias("swap_typos"),
        F.sum("n_runon").alias("inline_runons"),
    )
    return spark.createDataFrame(
        [tuple(seen[c] for c in ("lines", "sub_typos", "swap_typos", "inline_runons"))],
        "lines long, sub_typos long, swap_typos long, inline_runons long",
    )


@query(
    "a8_resume",
    S.with_(S.LINES, select="SELECT doc_id, pos, src FROM lines WHERE split <> 'train'"),
)
def a8(spark, sf_dir):
    """The training split is already written; the rest remains."""
    path = scratch(spark, "written")
    lines = document_lines(spark, sf_dir).select(*KEYS, "split", "src")
    sinks.write_pairs(lines.filter(F.col("split") == "train"), path)
    return sinks.remaining(lines, sinks.read_pairs(spark, path), KEYS).select(*KEYS, "src")


@query(
    "d9_exclude_written",
    S.with_(
        S.LINES,
        S.variants(),
        select="""SELECT doc_id, pos, split FROM lines l
WHERE NOT EXISTS (SELECT 1 FROM variants v WHERE v.doc_id = l.doc_id AND v.pos = l.pos AND kind = 'typo')""",
    ),
)
def d9(spark, sf_dir):
    """Lines that have no typo variant yet."""
    lines = document_lines(spark, sf_dir)
    done = line_variants(lines).filter(F.col("kind") == "typo")
    return sinks.remaining(lines.select(*KEYS, "split"), done, KEYS)


@query(
    "a10_sharded_input",
    S.with_(
        S.LINES,
        select="""SELECT (doc_id % 16)::int AS shard, count(*) AS n_lines, sum(length(src))::bigint AS chars
FROM lines GROUP BY 1""",
    ),
)
def a10(spark, sf_dir):
    """Sixteen shards written side by side and read in one scan."""
    path = scratch(spark, "shards")
    lines = document_lines(spark, sf_dir).withColumn("shard", (F.col("doc_id") % 16).cast("int"))
    lines.select("shard", "src").write.partitionBy("shard").text(path)
    return (
        bitext.read_shards(spark, f"{path}/shard=*")
        .groupBy("shard")
        .agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("chars"))
    )


_TIDY = S.joined(S.detached("src"))


@query(
    "a8_resume_by_offset",
    S.with_(S.LINES, select=f"SELECT doc_id, pos, {_TIDY} AS tidy FROM lines"),
)
def a8_by_offset(spark, sf_dir):
    """Tokens of all lines, made in four runs that each go on where the one before ended."""
    root, out = scratch(spark, "blocks"), scratch(spark, "made")
    blocks.write_blocks(numbered_lines(spark, sf_dir), root, BLOCK)
    # a fourth of the largest split a run
    share = -(-spark.read.parquet(f"{root}/sizes").agg(F.max("n_blocks")).first()[0] // 4)

    def tidy(lines):
        return lines.select(*KEYS, text.untokens(text.detach_periods(F.col("src"))).alias("tidy"))

    while blocks.advance(spark, root, out, tidy, share):
        pass
    return blocks.made(spark, out)


@query(
    "a10_sharded_output",
    S.with_(
        S.LINES,
        select=f"""SELECT (doc_id % 16)::int AS shard, row_number() OVER (PARTITION BY doc_id % 16 ORDER BY doc_id, pos) - 1
  AS line_no, src AS before, {_TIDY} AS after FROM lines""",
    ),
)
def a10_output(spark, sf_dir):
    """Shards read, worked on and written again: line k of shard n stays line k of shard n."""
    first, second = scratch(spark, "shards"), scratch(spark, "shards")
    lines = document_lines(spark, sf_dir).withColumn("shard", (F.col("doc_id") % 16).cast("int"))
    sinks.write_shards(lines, first, "shard", KEYS, "src")
    read = bitext.read_shard_lines(spark, first)
    tidy = read.withColumn("tidy", text.untokens(text.detach_periods(F.col("line"))))
    sinks.write_shards(tidy, second, "shard", ["line_no"], "tidy")
    after = bitext.read_shard_lines(spark, second).withColumnRenamed("line", "after")
    return read.withColumnRenamed("line", "before").join(after, ["shard", "line_no"])


@query(
    "a11_encode_many",
    recursive(*TRAINED, ENCODED, PIECES, select="SELECT split, side, conv_id, turn, pieces FROM pieces"),
)
def a11(spark, sf_dir):
    """All splits and sides encoded by one job, one partition folder each."""
    path = scratch(spark, "encoded")
    encoded = encoded_sides(spark, sf_dir).filter(F.size("pieces") > 0)
    out = encoded.select("split", "side", "conv_id", "turn", F.array_join("pieces", " ").alias("pieces"))
    sinks.write_pairs(out, path, ("split", "side"))
    return sinks.read_pairs(spark, path).select(*out.columns)


def _rotations(sentences: list[str]) -> list[list[str]]:
    """A stand-in paraphraser: the sentences of a line in rotated order."""
    out = []
    for sentence in sentences:
        parts = sentence.split(". ")
        out.append([" ".join(parts[n:] + parts[:n]) for n in range(1, len(parts))])
    return out


@query(
    "j1_paraphraser_hook",
    S.with_(S.LINES, CANDIDATES, select="SELECT doc_id, pos, rank::int AS rank, phrase FROM candidates"),
)
def j1(spark, sf_dir):
    return candidates_from(document_lines(spark, sf_dir), _rotations, KEYS)


def _published_lexicon(spark, sf_dir) -> str:
    """The mined lexicon as version 0 of a table."""
    root = scratch(spark, "lexicon")
    versions.publish(lexicon(spark, sf_dir), root, 0)
    return root


IN_LINE = recipe("in-line", ["typo", "runon_line"], [0.15, 0.9])


def _streamed(spark, sf_dir, job, used, out, columns=None):
    """Runs a job twice on one checkpoint: the second run finds nothing new."""
    checkpoint = scratch(spark, "stream-state")
    noiser = incremental.Noiser(used, SEED, _published_lexicon(spark, sf_dir), 0, columns=columns)
    for _ in range(2):
        job(incremental.stream_documents(spark, sf_dir), noiser, out, checkpoint).awaitTermination()


@query(
    "i1_incremental_noise",
    S.with_(
        S.LINES,
        S.BASE,
        S.noise("base", "own", IN_LINE),
        select=f"""SELECT doc_id, pos, split, {S.joined("own.tokens")} AS noisy, coalesce(sub, 0)::int AS n_sub,
  coalesce(swap, 0)::int AS n_swap, coalesce(runon, 0)::int AS n_runon FROM own JOIN lines USING (row_key)""",
    ),
)
def i1(spark, sf_dir):
    """The lines of ``c9_compound_noise``, made as a stream."""
    out = scratch(spark, "stream")
    columns = [*KEYS, "split", "noisy_src", "n_sub", "n_swap", "n_runon"]
    _streamed(spark, sf_dir, incremental.publish_noised, IN_LINE, out, columns)
    return versions.read_all(spark, out).select(*KEYS, "split", F.col("noisy_src").alias("noisy"), "n_sub", "n_swap", "n_runon")


@query("i1_incremental_runons", S.with_(*_recipe_sql(RECIPES["both"]), select=_RECIPE_SELECT))
def i1_runons(spark, sf_dir):
    """Multi-line run-ons in the stream: the lines of ``c10_compound_runon``, batches held in keyed state."""
    out, arrived, checkpoint = scratch(spark, "stream"), scratch(spark, "numbered"), scratch(spark, "stream-state")
    docs = number_documents(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    incremental.with_ends(all_lines_of(docs)).write.parquet(arrived)
    columns = [*KEYS, "n_append", "n_runon", "n_sub", "n_swap", "noisy_src", "noisy_tgt"]
    noiser = incremental.Noiser(RECIPES["both"], SEED, _published_lexicon(spark, sf_dir), 0, columns=columns)
    for _ in range(2):
        incremental.publish_run_ons(incremental.stream_lines(spark, arrived), noiser, out, checkpoint).awaitTermination()
    return _recipe_output(versions.read_all(spark, out))


@query(
    "i2_live_progress",
    S.with_(
        S.LINES,
        S.BASE,
        S.noise("base", "own", IN_LINE),
        _READ,
        f"""counted AS (SELECT b.split, b.tokens AS clean, {S.joined("o.tokens")} AS noisy, coalesce(sub, 0) AS sub,
  coalesce(swap, 0) AS swap, coalesce(runon, 0) AS runon FROM own o JOIN base b USING (row_key))""",
        select=f"""SELECT split, lines_before, count(*) AS lines_after,
  sum(len(list_filter(clean, lambda x: {S.strip("x")} <> '')))::bigint AS tokens_before,
  sum(len({S.tokens("noisy")}))::bigint AS tokens_after,
  sum(len(list_filter(clean, lambda y: NOT {S.letters_only(S.strip("y"))})))::bigint AS non_alpha,
  sum(sub)::bigint AS sub_typos, sum(swap)::bigint AS swap_typos, 0::bigint AS paraphrased,
  sum(runon)::bigint AS inline_runons, 0::bigint AS multiline_runons, sum(sub + swap + runon)::bigint AS inline_edits,
  count(*) FILTER (sub + swap + runon > 0) AS lines_changed, 0::bigint AS lines_joined
FROM counted JOIN (SELECT split, count(*) AS lines_before FROM raw_numbered GROUP BY split) USING (split)
GROUP BY split, lines_before""",
    ),
)
def i2(spark, sf_dir):
    """All counters of the noise report, kept up by a stream."""
    out = scratch(spark, "progress")
    _streamed(spark, sf_dir, incremental.publish_report, IN_LINE, out)
    return versions.read_version(spark, out)
