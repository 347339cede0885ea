"""The pipeline against plain Python, from the documents that the first stage keeps."""

import inspect
from collections import Counter

import duckdb
import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from noisemix.llm import bpe, secrets
from noisemix.llm.common import table
from tests.llm.test_corpus_operators import plain_groups, plain_report
from tests.llm.test_text_operators import plain_spans

SF_DIR = "/root/testdata/sf0.001"


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id",
        "ngram_jaccard_join",
        "benchmark_decontamination",
        "secret_scans",
        "bpe",
    ]
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in corpus_pipeline.STAGES)


def test_pipeline_agrees_with_plain_python(spark):
    docs = table(spark, SF_DIR, "documents")
    first = corpus_pipeline.STAGES[0][1](spark, docs, SF_DIR)
    rows = [(r["doc_id"], r["text"]) for r in first.collect()]
    assert first.columns == docs.columns
    clean = docs.where("text is not null and length(text) > 40").count()
    assert len(rows) >= 0.99 * clean
    groups = plain_groups(rows)
    rows = [r for r, g in zip(rows, groups, strict=True) if g[1] == 0 or g[2] == r[0]]
    items = duckdb.sql(f"select item_id, text from '{SF_DIR}/benchmark.parquet'").fetchall()
    rows = [r for r in rows if not plain_report(r[1], items)[-1]]
    tokenizer = Tokenizer.from_file(bpe.default_file())
    expected = Counter()
    for i, text in rows:
        spans = secrets.find_secrets(text)
        assert set(plain_spans(text)) <= set(spans)
        redacted = secrets.redact(text)
        for kind, start, end in spans:
            assert text[start:end] not in redacted or len(text[start:end]) < 12
        expected[i, tuple(tokenizer.encode(redacted, add_special_tokens=False).ids)] += 1
    out = corpus_pipeline.run(spark, SF_DIR)
    assert out.columns == ["doc_id", "ids", "decoded"]
    got = out.collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == expected
    for r in got[:20]:
        assert r["decoded"] == tokenizer.decode(np.array(r["ids"]).tolist(), skip_special_tokens=False)
