"""The Merkle manifest against a tree that is built level by level."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from noisemix.llm import merkle

NO_ID = (0, -(1 << 70))


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, tamper=False):
    doc_id, text, lang, source, n_chars = row
    if tamper and doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
        text = text.replace("\n", "")
    values = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
    return digest(*values)


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([digest(*x[i : i + 3]) for i in range(0, len(x), 3)])
    return levels


def way(levels, k):
    out = []
    for x in levels[:-1]:
        first = k - k % 3
        out.append((x[first:k], x[k + 1 : first + 3]))
        k //= 3
    return out


def plain(rows):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, order = [], []
    for s in sources:
        own = sorted((r for r in rows if r[3] == s), key=lambda r: ((1, r[0]) if r[0] is not None else NO_ID, leaf(r)))
        order.append(own)
        trees.append(tree([leaf(r) for r in own]))
    top = tree([t[-1][0] for t in trees])
    out = []
    for i, own in enumerate(order):
        for k, row in enumerate(own):
            path = way(trees[i], k) + way(top, i)
            folded = leaf(row, tamper=True)
            for left, right in path:
                folded = digest(*left, folded, *right)
            proof = digest(*(x for left, right in path for x in left + right))
            root = top[-1][0]
            out.append((row[0], leaf(row), trees[i][-1][0], root, proof, folded, folded == root))
    return Counter(out)


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_manifest_of_odd_rows(odd_docs, odd_rows, no_docs):
    assert rows_of(merkle.manifest_documents(odd_docs)) == plain(odd_rows)
    assert merkle.manifest_documents(no_docs).collect() == []


@pytest.mark.parametrize("levels", [1, 2])
def test_tiers_of_blocks(spark, tmp_path, levels):
    """Sources of every size around the borders of blocks, many sources, a null one, repeated rows."""
    rng = random.Random(levels)
    rows = []
    for i, n in enumerate([1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 82, 100]):
        for _ in range(n):
            rows.append((rng.randrange(10**6), rng.choice(["a\nb", "", None, "é"]), "en", f"s{i}", 3))
    rows += [(7, "x\ny", None, None, None)] * 5 + [(None, "x", "en", "é", 1)] * 2 + [(-5, "\n", "en", "Z", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    manifest = merkle.build(merkle.document_leaves(docs), str(tmp_path / "manifest"), levels)
    assert manifest.low >= 2 and manifest.high >= 1
    found = merkle.verify(manifest, "claimed").select(
        "doc_id", "digest", "subroot", "root", "proof", "folded_root", F.col("folded_root") == F.col("root")
    )
    assert rows_of(found) == plain(rows)


def test_paths_lead_to_the_root(odd_docs, tmp_path):
    manifest = merkle.build(merkle.document_leaves(odd_docs), str(tmp_path / "manifest"))
    rows = merkle.verify(manifest, keep_paths=True).collect()
    assert rows and all(merkle.folded(r["digest"], r["proof"]) == r["root"] == manifest.root for r in rows)


@pytest.mark.parametrize("levels", [1, 2, 3])
@pytest.mark.parametrize("only", [True, False])
def test_places_in_the_log(levels, only):
    for n in range(1, 3**levels + 1):
        leaves = [digest(str(i)) for i in range(n)]
        counts, log = merkle.heights(n, only, levels), merkle.append_log(leaves, only, levels)
        assert len(log) == merkle.DIGEST * sum(counts)
        nodes = leaves
        for level, count in enumerate(counts):
            assert len(nodes) == count
            for k, node in enumerate(nodes):
                at = merkle.DIGEST * merkle.position(level, k, counts)
                assert log[at : at + merkle.DIGEST].hex() == node
            nodes = [digest(*nodes[i : i + 3]) for i in range(0, count, 3)]
        for k in range(n):
            path = ",".join(merkle.steps(log, k, counts))
            assert merkle.folded(leaves[k], path) == log[-merkle.DIGEST :].hex()
