"""The corpora that the registered queries read, taken from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noisemix.functions.draws import let
from noisemix.functions.text import not_blank
from noisemix.operators.ordering import dense_row_number, group_row_number, running_totals

from .partitions import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_of(doc_id) -> F.Column:
    rest = doc_id % 10
    return F.when(rest < 8, "train").when(rest == 8, "dev").otherwise("test")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-blank lines of all documents: ``doc_id, pos, lang, source, split, src``."""
    docs = spread(
        table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), "doc_id"
    )
    return lines_of(docs)


def number_documents(docs: DataFrame, overall: bool = False) -> DataFrame:
    """Adds ``first_line``: where a document starts when its split is read line by line.

    Documents of a split follow each other by ``doc_id``, a key.  A row for each document is sorted and
    summed up, never one for each line; a null text has no lines.  With ``overall`` also ``first_of_all``:
    where it starts when all documents are read by ``doc_id``.
    """
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    counts = docs.select("doc_id", split_of(F.col("doc_id")).alias("_split"), lines.alias("_lines"), lines.alias("_own"))
    starts = _starts(group_row_number(counts, ["_split"], ["doc_id"], "_doc_no"), ["_split"], "first_line")
    if overall:
        everywhere = _starts(dense_row_number(counts, ["doc_id"], "_doc_no"), [], "first_of_all")
        starts = starts.join(everywhere, "doc_id")
    return docs.join(starts, "doc_id")


def _starts(numbered: DataFrame, group: list[str], name: str) -> DataFrame:
    ends = running_totals(numbered, group, "_doc_no", ["_lines"])
    return ends.select("doc_id", (F.col("_lines") - F.col("_own")).alias(name))


def numbered_documents(spark: SparkSession, sf_dir: str, overall: bool = False, blank: bool = False) -> DataFrame:
    """Documents with their places (:func:`number_documents`); with ``blank`` all their lines are empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    if blank:
        docs = docs.withColumn("text", F.regexp_replace("text", "[^\n]+", ""))
    return number_documents(spread(docs, "doc_id"), overall)


def numbered_lines(spark: SparkSession, sf_dir: str, overall: bool = False) -> DataFrame:
    """Non-blank lines with ``split_line``, their number among all lines of their split, blank ones too.

    With ``overall`` also ``line_no``, their number among all lines.
    """
    return lines_of(numbered_documents(spark, sf_dir, overall))


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of all documents, blank ones too."""
    return all_lines_of(table(spark, sf_dir, "documents"))


def all_lines_of(docs: DataFrame) -> DataFrame:
    """Lines of documents, with ``split_line`` (and ``line_no``) where the documents are numbered."""
    numbers = {"first_line": "split_line", "first_of_all": "line_no"}
    first = [c for c in numbers if c in docs.columns]
    lines = (
        docs.select(
            "doc_id", "lang", "source", *first, F.posexplode(F.split("text", "\n")).alias("pos", "src")
        )
        .withColumn("pos", F.col("pos").cast("long"))
        .withColumn("split", split_of(F.col("doc_id")))
    )
    for c in first:
        lines = lines.withColumn(numbers[c], F.col(c) + F.col("pos"))
    return lines.drop(*first)


def lines_of(docs: DataFrame) -> DataFrame:
    """Lines of a batch or streaming frame of documents that aren't blank."""
    return all_lines_of(docs).filter(not_blank(F.col("src")))


def denoising_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as a bitext whose target is the clean line itself."""
    return document_lines(spark, sf_dir).withColumn("tgt", F.col("src"))


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turn -> next assistant turn: ``conv_id, turn, src, tgt``."""
    turns = table(spark, sf_dir, "conversations")
    said = turns.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("src"))
    reply = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("tgt")
    )
    return said.join(reply, ["conv_id", "turn"])


# Kinds of corruption and the SQL that makes a stand-in for each from a clean line.
VARIANT_SQL = {
    "typo": "replace(src, 'th', 'ht')",
    "both": "replace(replace(src, 'th', 'ht'), '. ', ', ')",
    "runon": "replace(src, '. ', ', ')",
    "para": "replace(src, ' and ', ' plus ')",
    "article": "replace(src, ' the ', ' ')",
    "dropone": "regexp_replace(src, ' [^ ]+$', '')",
    "nounnum": "replace(src, 's ', ' ')",
    "prep": "replace(src, ' in ', ' on ')",
    "sva": "replace(src, ' is ', ' are ')",
}

# Systems and evaluation sets: what stands in for a decoded hypothesis of a line.
HYPOTHESIS_SQL = {
    ("base", "ref"): "replace(src, ' in ', ' on ')",
    ("base", "l2"): "replace(regexp_replace(src, ' [^ ]+$', ''), 'th', 'ht')",
    ("robust", "ref"): "replace(src, ' the ', ' ')",
    ("robust", "l2"): "replace(replace(src, ' is ', ' are '), 'tion', 'sion')",
}


def line_variants(lines: DataFrame) -> DataFrame:
    """Long table ``doc_id, pos, split, kind, src, tgt`` with gaps and missing targets."""
    kinds = F.array(
        *[
            F.struct(F.lit(k).alias("kind"), F.expr(sql).alias("src"))
            for k, sql in VARIANT_SQL.items()
        ]
    )
    held_back = F.conv(
        F.substring(F.md5(F.concat_ws("|", F.lit("gap"), "doc_id", "pos", "kind")), 1, 1), 16, 10
    ).cast("int")
    return (
        lines.select("doc_id", "pos", "split", F.explode(kinds).alias("v"))
        .select("doc_id", "pos", "split", "v.kind", "v.src")
        .filter(held_back >= 3)
        .withColumn("tgt", F.when(F.col("kind").isin("both", "runon"), F.lower("src")))
    )


def hypothesis_pairs(lines: DataFrame, *carried: str) -> DataFrame:
    """``doc_id, pos, system, eval_set, hyp, ref`` for four system / evaluation set cells."""
    cells = F.array(
        *[
            F.struct(
                F.lit(s).alias("system"), F.lit(e).alias("eval_set"), F.expr(sql).alias("hyp")
            )
            for (s, e), sql in HYPOTHESIS_SQL.items()
        ]
    )
    rows = lines.select("doc_id", "pos", F.col("src").alias("ref"), *carried, F.explode(cells).alias("c"))
    return rows.select("doc_id", "pos", "c.system", "c.eval_set", "c.hyp", "ref", *carried)


def rotations(line: F.Column) -> F.Column:
    """:func:`rotated_candidates` of one line as an array of ``struct(rank, phrase)``."""

    def turned(parts: F.Column) -> F.Column:
        size = F.size(parts)
        made = F.transform(
            F.sequence(F.lit(1), size - 1, F.lit(1)),
            lambda by: F.struct(
                (by - 1).cast("int").alias("rank"),
                F.concat_ws(" ", F.slice(parts, by + 1, size), F.slice(parts, F.lit(1), by)).alias("phrase"),
            ),
        )
        return F.when(size > 1, made).otherwise(F.array().cast("array<struct<rank:int,phrase:string>>"))

    return let(F.split(line, r"\. "), turned)


def rotated_candidates(lines: DataFrame) -> DataFrame:
    """Stand-in for a paraphraser: the sentences of a line rotated by one, two, ... places.

    Gives ``doc_id, pos, rank, phrase``; a line of one sentence has no candidate.
    """
    parts = F.split("src", r"\. ")
    return (
        lines.select("doc_id", "pos", parts.alias("parts"))
        .filter(F.size("parts") > 1)
        .select(
            "doc_id",
            "pos",
            "parts",
            F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("by"),
        )
        .select(
            "doc_id",
            "pos",
            (F.col("by") - 1).cast("int").alias("rank"),
            F.concat_ws(
                " ",
                F.slice("parts", F.col("by") + 1, F.size("parts")),
                F.slice("parts", F.lit(1), F.col("by")),
            ).alias("phrase"),
        )
    )
