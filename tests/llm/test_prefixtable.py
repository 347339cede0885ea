"""SentencePiece encoding and decoding against the library itself."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece

from noisemix.llm import prefixtable

STRANGE = [
    "",
    " ",
    "  a",
    "a  ",
    "\u2581a \u2581\u2581 b",
    "<s> </s> <unk> <0x0A>\n\n\tx\x00y",
    "日本語 テスト 漢字😀😀 𝒳",
    "a" * 300 + " " + "ab" * 500,
    " " * 100 + "x" + " " * 37,
    "é é ñ" * 3,
    "=====-----    ___ ((()))",
    "wide\u3000blank no\u00a0break",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=prefixtable.default_file())


@pytest.fixture(scope="module")
def model():
    return prefixtable.Encoder(prefixtable.default_file())


def plain(library, text):
    ids = library.encode(text or "", add_bos=True, add_eos=True)
    raw, decoded = np.array(ids, "<u4").tobytes(), library.decode(ids).encode()
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded).hexdigest()


def test_encoding_is_that_of_the_library(odd_docs, odd_rows, no_docs, library):
    file = prefixtable.default_file()
    found = Counter(tuple(r) for r in prefixtable.encode_digests(odd_docs, file).collect())
    assert found == Counter((r[0], *plain(library, r[1])) for r in odd_rows)
    assert prefixtable.encode_digests(no_docs, file).collect() == []


def test_strange_texts(model, library):
    rng = random.Random(2)
    alphabet = "abetinrs \u2581 \n.,é日😀0123<>/_-="
    texts = STRANGE + ["".join(rng.choices(alphabet, k=rng.randint(1, 200))) for _ in range(500)]
    for text, ids in zip(texts, model.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True)
        assert model.decode(ids).decode() == library.decode(ids.tolist())


def test_full_tables_start_anew(monkeypatch, library):
    monkeypatch.setattr(prefixtable, "KEPT_WORDS", 3)
    monkeypatch.setattr(prefixtable, "KEPT_PAIRS", 3)
    monkeypatch.setattr(prefixtable, "RUN_WORDS", 5)
    model = prefixtable.Encoder(prefixtable.default_file())
    texts = [f"word{i} other{i % 3} thing " + "x" * (i * 10) for i in range(20)]
    for text, ids in zip(texts, model.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_any_ids_decode(model, library):
    rng = random.Random(3)
    for _ in range(3000):
        ids = [rng.choice([1, 2, 0, 259, 28705, rng.randrange(3, 259), rng.randrange(32000)]) for _ in range(rng.randint(0, 7))]
        assert model.decode(np.array(ids, np.int64)).decode() == library.decode(ids)


def merged(symbols, scores):
    """Merges the best pair, the leftmost of equals, one by one."""
    symbols = list(symbols)
    while True:
        best = max(((scores[a + b], -i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in scores), default=None)
        if best is None:
            return symbols
        i = -best[1]
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


def small_model(rng):
    pieces = [prefixtable.Piece(c, -100.0 - i, prefixtable.NORMAL) for i, c in enumerate("abc")]
    made = {"".join(rng.choices("abc", k=rng.randint(2, 5))) for _ in range(25)}
    return pieces + [prefixtable.Piece(t, -float(rng.randint(0, 12)), prefixtable.NORMAL) for t in sorted(made)]


@pytest.mark.parametrize("seed", range(6))
def test_table_holds_the_last_token_of_each_prefix(seed, monkeypatch):
    """Any pieces, equal scores among them; also scores that rise where pieces grow."""
    rng = random.Random(seed)
    pieces = small_model(rng)
    scores = {p.text: p.score for p in pieces}
    model = prefixtable.Encoder.__new__(prefixtable.Encoder)
    model.n = len(pieces)
    model.test = prefixtable.PairTest(pieces)
    model.pieces = prefixtable.PieceAutomaton(model.test.ids)
    model.length = np.array([len(p.text) for p in pieces] + [1])
    words = ["".join(rng.choices("abcz", weights=[3, 3, 3, 1], k=rng.randint(1, 40))) for _ in range(300)]
    text, table, begins = model.table(words)
    for word, at in zip(words, begins.tolist(), strict=True):
        for n in range(1, len(word) + 1):
            last = merged(word[:n], scores)[-1]
            assert table[at + n - 1] == (model.test.ids[last] if last in scores else model.n)


def test_documents_and_ids(spark, odd_docs, odd_rows, library):
    file = prefixtable.default_file()
    encoded = prefixtable.encode_documents(odd_docs, file)
    rows = encoded.collect()
    want = Counter((r[0], tuple(library.encode(r[1] or "", add_bos=True, add_eos=True))) for r in odd_rows)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows) == want
    assert all(r["decoded"] == library.decode(list(r["ids"])) for r in rows)
    some = spark.createDataFrame([(1, [1, 264, 2]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert [r["decoded"] for r in prefixtable.decode_ids(some, file).orderBy("doc_id").collect()] == ["a", None, ""]


def test_other_files_are_refused(tmp_path):
    with open(prefixtable.default_file(), "rb") as f:
        raw = f.read()
    other = tmp_path / "other.model"
    other.write_bytes(raw.replace(b"\x0a\x08identity\x12\x00\x18\x01\x20\x00", b"\x0a\x08identity\x12\x00\x18\x00\x20\x00"))
    assert other.read_bytes() != raw
    with pytest.raises(ValueError, match="byte-pair model"):
        prefixtable.read_model(str(other))
