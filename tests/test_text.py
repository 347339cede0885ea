import pytest
from pyspark.sql import functions as F

from noisemix.functions import clauses, text
from noisemix.functions.draws import RESOLUTION


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    "token, ends",
    [("dog.", True), ("Spain.", False), ("e.g.", False), ("wait...", False), ("dog", False), (".", True)],
)
def test_sentence_end(spark, token, ends):
    assert one(spark, text.ends_sentence(F.col("t")), t=token) is ends


@pytest.mark.parametrize(
    "line, toks",
    [
        ("The dog ran. It slept.", ["The", "dog", "ran", ".", "It", "slept."]),
        ("  a \t b\nc ", ["a", "b", "c"]),
        ("see e.g. this. yes", ["see", "e.g.", "this", ".", "yes"]),
        ("wait... no. it", ["wait...", "no", ".", "it"]),
        ("end.. the", ["end.", ".", "the"]),
        (". . a", [".", ".", "a"]),
        ("U.S. is. ok", ["U.S.", "is", ".", "ok"]),
        ("", []),
        ("   ", []),
    ],
)
def test_detach_periods(spark, line, toks):
    assert one(spark, text.detach_periods(F.col("s")), s=line) == toks


def test_detached_matches_token_rule(spark):
    """The one-pass pattern agrees with the rule applied token by token."""
    lines = [
        " ".join(p)
        for p in [
            ["a.", "b.", "C.", "d"], ["x.y.", "z", "..", "...", "q."], ["cf.", "i.e.", "a.m.", "b"],
            ["café.", "Él.", "él.", "ñ"], [".", "a", ".", "."], ["p.m.x.", "no.", "No.", "x"],
        ]
    ]
    df = spark.createDataFrame([(s,) for s in lines], "s string")
    toks = text.tokens(F.col("s"))
    by_token = F.flatten(
        F.transform(
            toks,
            lambda t, i: F.when(
                (i < F.size(toks) - 1) & text.ends_sentence(t),
                F.array_remove(F.array(F.substr(t, F.lit(1), F.length(t) - 1), F.lit(".")), ""),
            ).otherwise(F.array(t)),
        )
    )
    for row in df.select(text.detach_periods(F.col("s")).alias("a"), by_token.alias("b")).collect():
        assert row.a == row.b


def test_reattach_periods(spark):
    toks = F.split(F.lit("The dog ran . It slept."), " ")
    assert one(spark, text.reattach_periods(toks)) == ["The", "dog", "ran.", "It", "slept."]


@pytest.mark.parametrize("raw, plain", [("Hello , world !", "Hello, world!"), ("a . . b", "a.. b"), (" x ?", "x?")])
def test_detokenise(spark, raw, plain):
    assert one(spark, text.detokenise(F.col("s")), s=raw) == plain


def test_space_blind_equality(spark):
    assert one(spark, text.differs(F.lit("a  b "), F.lit("a b"))) is False
    assert one(spark, text.differs(F.lit("a b"), F.lit("ab"))) is True


@pytest.mark.parametrize(
    "first, proper, out", [("I", False, "I"), ("Dogs", False, "dogs"), ("PARIS", True, "Paris"), ("I", True, "I")]
)
def test_open_clause(spark, first, proper, out):
    assert one(spark, clauses.open_clause(F.lit(first), F.lit(proper))) == out


# a draw in the middle of each of the five (or three) equal slots
AND, COMMA_AND, COMMA, SEMICOLON = 0.1, 0.3, 0.5, 0.9


@pytest.mark.parametrize(
    "clause, u, out",
    [
        ("I run", SEMICOLON, "I run;"),
        ("I run!", SEMICOLON, "I run;"),
        ("I run", AND, "I run and"),
        ('I "run"', COMMA_AND, 'I "run," and'),
        ('I "run"', AND, 'I "run" and'),
        ('I "run"', COMMA, 'I "run,"'),
        ('I "run."', SEMICOLON, 'I "run;"'),
        ('I "', COMMA, "I ,"),
        ("it's'", COMMA, "it's,'"),
        ('"', COMMA, ","),
    ],
)
def test_close_clause(spark, clause, u, out):
    assert one(spark, clauses.close_clause(F.col("c"), F.lit(u)), c=clause) == out


@pytest.mark.parametrize(
    "original, phrase, out",
    [
        ("He ran.", "he walked", "He walked."),
        ("He ran.", "he walked!", "He walked!"),
        ("He ran", "HE Walked", "He walked"),
        ('"He ran."', "he walked", '"He walked."'),
        ('"He ran"', "he walked", '"He walked"'),
        ("(He ran)", "he walked", "(He walked)"),
        ("(He ran!)", "he walked", "(He walked!)"),
        (".", "so", "So."),
    ],
)
def test_repair_paraphrase(spark, original, phrase, out):
    assert one(spark, clauses.repair_paraphrase(F.col("o"), F.col("p")), o=original, p=phrase) == out


def test_tokenise_13a(spark):
    toks = one(spark, text.tokenise_13a(F.lit('Say "no", it costs 3.50-4 &amp; more.')))
    assert toks == ["Say", '"', "no", '"', ",", "it", "costs", "3.50", "-", "4", "&", "more", "."]


def test_characters_keep_code_points(spark):
    assert one(spark, text.characters(F.lit("aé😀"))) == ["a", "é", "😀"]
    assert one(spark, text.characters(F.lit(""))) == []


def test_resolution():
    assert RESOLUTION == 2**32
