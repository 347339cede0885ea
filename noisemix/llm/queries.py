"""The registered queries of this package, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noisemix.llm import (
    bpe,
    contextmixing,
    decontamination,
    jaccard,
    langid,
    merkle,
    prefixtable,
    prefixtrie,
    secrets,
    sharding,
    sql,
    tokenfiles,
    toolcalls,
    topk,
)
from noisemix.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def _documents(apply: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: apply(table(spark, sf_dir, "documents"))


def decontaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Query] = {
    "op1_top_k": nearest,
    "op2_token_counts": _documents(tokenfiles.count_documents),
    "op3_decontamination": decontaminated,
    "op4_bpe": _documents(lambda docs: bpe.encode_digests(docs, bpe.default_file())),
    "op5_lm_score": _documents(contextmixing.score_documents),
    "op6_chat_formatting": lambda spark, sf_dir: toolcalls.format_every_row(table(spark, sf_dir, "conversations")),
    "op7_language_id": _documents(langid.identify),
    "op8_secret_scan": _documents(secrets.scan_documents),
    "op9_ngram_jaccard": _documents(jaccard.join_documents),
    "op10_sharding": _documents(sharding.shard_documents),
    "op11_sentencepiece": _documents(lambda docs: prefixtable.encode_digests(docs, prefixtable.default_file())),
    "op12_prefix_trie": lambda spark, sf_dir: prefixtrie.conversation_trie(table(spark, sf_dir, "conversations")),
    "op13_merkle_manifest": _documents(merkle.manifest_documents),
}

SQL: dict[str, str] = {
    "op1_top_k": sql.TOP_K,
    "op2_token_counts": sql.TOKEN_COUNTS,
    "op3_decontamination": sql.DECONTAMINATION,
    "op6_chat_formatting": sql.TOOL_CALLS,
    "op9_ngram_jaccard": sql.JACCARD,
    "op12_prefix_trie": sql.PREFIX_TRIE,
    "op13_merkle_manifest": sql.MERKLE,
}
