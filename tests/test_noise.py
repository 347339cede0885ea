import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from noisemix.functions import letters, text, typos
from noisemix.functions.draws import draw_hash, lane, running_weights, weighted_index
from noisemix.operators import lexicon, noise, reports
from noisemix.plans import registered
from noisemix.plans.recipes import RECIPES, recipe
from noisemix.sources.corpora import number_documents, rotated_candidates, rotations

KEYS = ["doc", "pos"]
WORDS = "the quick brown foxes jumping over lazydogs and running homewards yesterday".split()


def corpus(spark, docs=12, lines=20, partitions=4):
    rows = []
    for d in range(docs):
        for p in range(lines):
            words = [WORDS[(d * 7 + p * 3 + k) % len(WORDS)] for k in range(6 + (d + p) % 9)]
            half = len(words) // 2
            line = f"{' '.join(words[:half]).capitalize()}. {' '.join(words[half:]).capitalize()}."
            rows.append((d, p, line, f"t{d}-{p}"))
    return spark.createDataFrame(rows, "doc long, pos long, src string, tgt string").repartition(partitions)


def prepared(spark, **how):
    return corpus(spark, **how).transform(noise.prepare(KEYS)).transform(lexicon.no_proper_nouns)


def batched(df):
    return df.withColumn("batch", F.floor(F.col("pos") / 8))


def python_draw(*key, number=0):
    digest = hashlib.md5("|".join(str(k) for k in key).encode()).hexdigest()
    return int(digest[8 * number : 8 * number + 8], 16) / 2**32


def test_draw_is_the_documented_hash(spark):
    u = spark.range(1).select(lane(draw_hash(7, "op", F.lit("a"), 3), 2)).first()[0]
    assert u == python_draw("7", "op", "a", 3, number=2)


def test_weighted_index_skips_zero_weights(spark):
    cum = F.array(*[F.lit(x) for x in (0, 4, 4, 8)])
    picks = [spark.range(1).select(weighted_index(cum, F.lit(u))).first()[0] for u in (0.0, 0.49, 0.5, 0.99)]
    assert picks == [1, 1, 3, 3]


def test_letter_tables():
    assert len(letters.LETTER_WEIGHT) == 26
    assert sum(len(v) for v in letters.LETTER_TRANSITION.values()) == 138
    for letter, hits in letters.LETTER_TRANSITION.items():
        assert letter not in hits and abs(sum(hits.values()) - 10000) <= 1


@pytest.fixture(scope="module")
def edited_words(spark):
    words = spark.range(4000).select(
        F.concat(F.lit("Windmill"), (F.col("id") % 7).cast("string"), F.lit("Été")).alias("w"),
        draw_hash(1, "w", F.col("id")).alias("h"),
    )
    return words.select(
        "w",
        typos.edit_word(F.col("w"), F.col("h")).alias("e"),
        typos.swap_letters(F.col("w"), lane(F.col("h"), 2)).alias("swap"),
        typos.substitute_letter(F.col("w"), lane(F.col("h"), 2), lane(F.col("h"), 3)).alias("sub"),
    ).collect()


def test_swap_keeps_letters(edited_words):
    for row in edited_words:
        assert Counter(row.swap.word) == Counter(row.w) and row.swap.swap == 1


def test_substitution_changes_one_letter_and_keeps_case(edited_words):
    for row in edited_words:
        changed = [(a, b) for a, b in zip(row.w, row.sub.word, strict=True) if a != b]
        assert len(changed) == 1
        old, new = changed[0]
        assert new.lower() in letters.LETTER_TRANSITION[old.lower()]
        assert old.isupper() == new.isupper()


def test_substitutions_and_swaps_are_equally_likely(edited_words):
    subs = sum(row.e.sub for row in edited_words)
    assert abs(subs / len(edited_words) - 0.5) < 0.03


def test_words_without_letters_stay(spark):
    row = spark.range(1).select(
        typos.swap_letters(F.lit("1234a6"), F.lit(0.3))["word"].alias("swap"),
        typos.substitute_letter(F.lit("123456"), F.lit(0.3), F.lit(0.3))["word"].alias("sub"),
    ).first()
    assert (row.swap, row.sub) == ("1234a6", "123456")


def test_typo_counts(spark):
    df = prepared(spark).withColumn("clean", F.col("tokens")).transform(noise.typo_noise(0.15, 5))
    for row in df.collect():
        made = row.n_sub + row.n_swap
        assert len(row.tokens) == len(row.clean)
        long = sum(len(w.strip(".")) >= 6 for w in row.clean)
        assert made == (min(max(1, int(len(row.clean) * 0.15)), long) if long and len(row.clean) >= 4 else 0)
        assert all(a == b for a, b in zip(row.tokens, row.clean, strict=True) if len(b.strip(".")) < 6)


def test_short_or_wordless_sentences_get_no_typos(spark):
    df = spark.createDataFrame([(1, 0, "running home yesterday", "x"), (1, 1, "a b c d e", "x"), (1, 2, "!!! ... ??? -- ;;", "x")], "doc long, pos long, src string, tgt string")
    out = df.transform(noise.prepare(KEYS)).transform(noise.typo_noise(0.9, 1))
    assert out.agg(F.sum(F.col("n_sub") + F.col("n_swap"))).first()[0] == 0


def python_runon(toks, key, p, seed):
    """The rule written as a plain walk."""
    slots, out, i, seen, made = [" and", ", and", ",", ",", ";"], "", 0, 0, 0
    while i < len(toks):
        if toks[i] == "." and i < len(toks) - 1:
            seen += 1
            if python_draw(seed, "runon", key, seen) < p:
                conj = slots[int(python_draw(seed, "runon", key, seen, number=1) * 5)]
                following = toks[i + 1]
                if following == "." and i + 1 < len(toks) - 1:
                    seen += 1
                out = out.strip() + conj + " " + (following if following == "I" else following.lower()) + " "
                i, made = i + 2, made + 1
                continue
            out = out.strip() + ". "
        else:
            out += toks[i] + " "
        i += 1
    return out.split(), made


def test_runon_line_against_plain_walk(spark):
    lines = [
        "A b . C d . I e . f.", ". . x", "a . . . B . c", "a .", ". A", "no stop", "x . . y . . . z", "a . B",
    ] * 12
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "k long, s string").select(
        F.col("k").cast("string").alias("row_key"), F.split("s", " ").alias("tokens"), F.array().cast("array<int>").alias("proper_at"), F.split("s", " ").alias("clean")
    )
    for row in df.transform(noise.runon_noise(0.6, 3)).collect():
        assert (row.tokens, row.n_runon) == python_runon(row.clean, row.row_key, 0.6, 3)


def test_proper_nouns_keep_capitals(spark):
    rows = [(1, i, "We saw Paris again. Paris was open. Dogs ran.", "x") for i in range(20)]
    df = spark.createDataFrame(rows, "doc long, pos long, src string, tgt string")
    names = lexicon.mine_proper_nouns(df)
    assert [r.word for r in names.collect()] == ["paris"]
    lines = lexicon.mark_proper_nouns(df.transform(noise.prepare(KEYS)), names, KEYS)
    out = lines.transform(noise.runon_noise(1.0, 1)).first()
    assert "Paris" in out.tokens[out.tokens.index("Paris") + 2 :] and "dogs" in out.tokens


def test_lexicon_join_equals_inline(spark):
    df = corpus(spark).withColumn("src", F.replace("src", F.lit("foxes"), F.lit("Foxes")))
    names = lexicon.mine_proper_nouns(df)
    assert names.count() > 0
    lines = df.transform(noise.prepare(KEYS))
    inline = lexicon.mark_proper_nouns(lines, names, KEYS)
    joined = lexicon.mark_proper_nouns(lines, names, KEYS, inline_words=0)
    pick = ["row_key", "proper_at"]
    assert sorted(map(str, inline.select(pick).collect())) == sorted(map(str, joined.select(pick).collect()))


@pytest.mark.parametrize("name", list(RECIPES))
def test_recipes_keep_rows_and_do_not_depend_on_partitions(spark, name):
    results = []
    for partitions in (1, 4, 32):
        df = prepared(spark, partitions=partitions).withColumn(
            "candidates", F.array(F.lit("one two three"), F.lit("four five six"))
        )
        out = batched(df).transform(noise.apply_recipe(RECIPES[name], ["doc", "batch"], ["pos"], 8, 9))
        results.append(sorted((r.doc, r.pos, r.noisy_src, r.noisy_tgt) for r in out.collect()))
    assert len(results[0]) == 240
    assert results[0] == results[1] == results[2]


def test_partners_are_distinct_others_of_the_batch(spark):
    plain = recipe("x", ["runon_comb"], [0.8], compound=False)
    out = batched(prepared(spark)).transform(noise.apply_recipe(plain, ["doc", "batch"], ["pos"], 8, 2))
    appended = []
    for row in out.collect():
        ids = row.noisy_tgt.split(" ")
        assert ids[0] == f"t{row.doc}-{row.pos}" and len(set(ids)) == len(ids)
        assert len(ids) == row.n_append + 1
        for other in ids[1:]:
            doc, pos = other[1:].split("-")
            assert int(doc) == row.doc and int(pos) // 8 == row.pos // 8
        appended.append(row.n_append)
    assert max(appended) > 2


def test_mean_number_of_appended_lines(spark):
    plain = recipe("x", ["runon_comb"], [0.5], compound=False)
    df = prepared(spark, docs=60, lines=40)
    out = batched(df).transform(noise.apply_recipe(plain, ["doc", "batch"], ["pos"], 8, 2))
    mean = out.agg(F.avg("n_append")).first()[0]
    assert abs(mean - sum(0.5**i for i in range(1, 8))) < 0.06


def test_tail_batch_and_single_line_batch(spark):
    plain = recipe("x", ["runon_comb"], [0.9], compound=False)
    df = prepared(spark, docs=2, lines=9)  # batches of 8 and 1
    out = batched(df).transform(noise.apply_recipe(plain, ["doc", "batch"], ["pos"], 8, 2))
    assert out.count() == 18
    assert [r.n_append for r in out.filter("pos = 8").collect()] == [0, 0]


def test_large_batches(spark):
    plain = recipe("x", ["typo", "runon_comb"], [0.15, 0.5])
    df = prepared(spark, docs=2, lines=1500).withColumn("batch", F.floor(F.col("pos") / 1000))
    out = df.transform(noise.apply_recipe(plain, ["doc", "batch"], ["pos"], 1000, 2))
    assert out.count() == 3000
    assert abs(out.agg(F.avg("n_append")).first()[0] - 1.0) < 0.1


def test_a_chain_needs_an_end(spark):
    with pytest.raises(ValueError):
        noise.chain_runons(["doc"], "pos", 1.0, 1)


def test_batch_sizes(spark):
    df = spark.range(19).withColumnRenamed("id", "sent_id").transform(noise.assign_batches(8))
    assert sorted(r["count"] for r in df.groupBy("batch_id").count().collect()) == [3, 8, 8]


def test_chain_is_exact_across_blocks_and_on_a_hot_document(spark):
    rows = [(0 if i % 3 else 1 + i, i, f"Line {i}.", f"t{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc long, pos long, src string, tgt string")
    lines = df.transform(noise.prepare(KEYS)).transform(lexicon.no_proper_nouns)
    small = lines.transform(noise.chain_runons(["doc"], "pos", 0.7, 4, block=16))
    large = lines.transform(noise.chain_runons(["doc"], "pos", 0.7, 4))
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))
    targets = sorted(t for r in small.collect() for t in r.noisy_tgt.split(" "))
    assert targets == sorted(f"t{i}" for i in range(3000))
    assert small.agg(F.max("n_lines")).first()[0] > 5


def test_paraphrase_choice(spark):
    rows = [(i, c) for i, c in enumerate([None, [], ["he walked"], [""], ["he ran"]] + [["first one", "second one"]] * 3000)]
    df = spark.createDataFrame(rows, "k long, candidates array<string>").select(
        F.col("k").cast("string").alias("row_key"), "candidates", F.split(F.lit("He ran."), " ").alias("tokens")
    )
    out = {r.row_key: r for r in df.transform(noise.paraphrase_noise(1)).collect()}
    assert [out[str(i)].n_para for i in range(5)] == [0, 0, 1, 0, 0]
    assert out["2"].tokens == ["He", "walked."]
    first = sum(r.tokens[0] == "First" for k, r in out.items() if int(k) >= 5)
    assert abs(first / 3000 - 0.3 / 1.3) < 0.03


def test_recipe_checks():
    with pytest.raises(ValueError):
        recipe("x", ["spelling"], [0.1])
    with pytest.raises(ValueError):
        recipe("x", ["typo"], [0.1, 0.2])
    with pytest.raises(ValueError):
        recipe("x", ["runon_comb"], [1])
    with pytest.raises(ValueError):
        recipe("x", ["typo", "typo"], [0.1, 0.2])


def test_report_of_nothing_is_null(spark):
    out = batched(prepared(spark)).transform(noise.apply_recipe(RECIPES["typo"], ["doc", "batch"], ["pos"]))
    empty = reports.noise_report(out.filter("doc < 0"), [])
    row = empty.first()
    assert row.lines_before == 0 and row.typos_per_line is None


def test_changed_rate(spark):
    df = spark.createDataFrame([("a b", "a  b"), ("a", "a"), ("a", "b"), ("c", "c ")], "x string, y string")
    row = reports.changed_rate(df, "x", "y", []).first()
    assert (row.n_changed, row.n_lines, row.pct_changed) == (1, 4, 25.0)


def test_snapshots_are_cumulative(spark):
    out = batched(prepared(spark)).transform(noise.apply_recipe(RECIPES["both"], ["doc", "batch"], ["pos"], 8, 1))
    steps = reports.progress_snapshots(out, "doc", 4).orderBy("snapshot").collect()
    final = reports.noise_report(out, []).first()
    assert [r.lines_after for r in steps] == [80, 160, 240]
    for counter in reports.COUNTERS:
        assert steps[-1][counter] == final[counter]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_cut_into_tokens_once(spark):
    df = spark.createDataFrame([(1, "a b. c", "x"), (2, " \t", "x"), (3, "a", "\n "), (4, None, "x"), (5, "a", None)], "k int, src string, tgt string")
    out = df.transform(noise.prepare(["k"]))
    assert [(r["k"], r["tokens"]) for r in out.collect()] == [(1, ["a", "b", ".", "c"])]
    assert plan(out.select("tokens")).count("$1 .") == 1


def test_proper_nouns_against_plain_walk(spark):
    lines = ["Ann met Bob. Bob saw bob! Cy", " x\t\tThe. A. B c", "a b.\u2028 Bob Bob? d", "...", "a ... Dot 'Dot'", "", None, "É Éa (Éa) éa Éa", "end.\x85 Zed Zed", "end.\u2028 Yo yo Wu\u2029 Wu", "\x0bQ q\x0cQ"]
    seen = Counter()
    for line in lines:
        toks = re.findall(r"[^ \t\n\x0b\f\r]+", line or "")
        for before, t in zip(toks, toks[1:]):
            word = re.sub(r"[!-/:-@\[-`{-~]", "", t)
            if word and not re.search(r"[.?!][\x85\u2028\u2029]?\Z", before):
                seen[word.lower(), 0] += 1
                seen[word.lower(), 1] += word[0] != word[0].lower()
    want = {(w, n, seen[w, 1]) for (w, k), n in seen.items() if k == 0 and 2 * seen[w, 1] > n}
    mined = lexicon.mine_proper_nouns(spark.createDataFrame([(x,) for x in lines], "src string"))
    assert {tuple(r) for r in mined.collect()} == want
    assert "lambda" not in plan(mined)


@pytest.mark.parametrize("inline", [0, 100])
def test_clause_openings_against_plain_walk(spark, inline):
    lines = [["A", ".", "B", "."], [".", "A"], [".", ".", "B"], ["x", ".", ".", ".", "A"], ["a.", "B", "."], ["."], []]
    df = spark.createDataFrame(list(enumerate(lines)), "k int, tokens array<string>")
    names = spark.createDataFrame([("a",), ("b",), ("",)], "word string")
    got = lexicon.mark_proper_nouns(df, names, ["k"], inline)
    want = []
    for toks in lines:
        opens = toks[:1] + [toks[i + 1] for i, t in enumerate(toks[:-1]) if t == "."]
        want.append([j for j, t in enumerate(opens) if t.lower().strip(".") in ("a", "b", "")])
    assert [r["proper_at"] for r in got.orderBy("k").collect()] == want
    assert inline == 0 or "namedlambdavariable() = ." not in plan(got)


def test_rewrites_of_a_line_do_not_travel(spark):
    rows = [(1, 0, "a. b. c"), (1, 0, "a. b. c"), (2, 0, "d. e"), (2, 0, "f. g. h"), (3, 0, "one"), (4, 0, ""), (None, 0, "a. b"), (None, 0, "a. b")]
    df = spark.createDataFrame(rows, "doc_id int, pos int, src string")
    old = df.transform(noise.attach_candidates(rotated_candidates(df), ["doc_id", "pos"]))
    new = df.transform(noise.attach_rewrites(rotations, ["doc_id", "pos"]))
    assert new.columns == old.columns[:2] + ["src", "candidates"]

    def found(out):
        return Counter((r["doc_id"], r["src"], tuple(r["candidates"] or ())) for r in out.collect())

    assert found(new) == found(old)
    assert "Join" not in plan(new) and "Generate" not in plan(new)


def test_only_what_is_asked_for_goes_through_the_batches(spark):
    df = batched(prepared(spark))
    whole = df.transform(noise.apply_recipe(RECIPES["both"], ["doc", "batch"], ["pos"], 8, 4))
    few = df.transform(noise.apply_recipe(RECIPES["both"], ["doc", "batch"], ["pos"], 8, 4, ["row_key"]))
    columns = ["row_key", "n_append", "n_runon", "n_sub", "n_swap", "noisy_src", "noisy_tgt"]
    assert Counter(map(tuple, few.select(*columns).collect())) == Counter(map(tuple, whole.select(*columns).collect()))
    assert not {"src", "tokens_before", "non_alpha"} & set(few.columns)


def test_plain_appended_lines_stay_in_their_row(spark):
    df = batched(prepared(spark))
    out = df.transform(noise.apply_recipe(recipe("r", ["runon_line", "runon_comb"], [0.9, 0.5], compound=False), ["doc", "batch"], ["pos"], 8, 2))
    assert plan(out).count("Aggregate") == 1 and "posexplode" not in plan(out)
    clean = {r["row_key"]: (r["tgt"], r["doc"], r["batch"]) for r in df.collect()}
    for r in out.collect():
        tgts = r["noisy_tgt"].split(" ")
        others = {t for t, *where in clean.values() if where == [r["doc"], r["batch"]]} - {clean[r["row_key"]][0]}
        assert tgts[0] == clean[r["row_key"]][0] and len(set(tgts)) == len(tgts) == 1 + r["n_append"] and set(tgts[1:]) <= others


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_typo_is_that_of_edit_word(spark):
    """One draw a line: Arrow batches make of the drawn word what the column expression makes of it."""
    odd = ["Été-élève naïveté bus do", "one two\u0085 threes\u0085 four", "it's don't-stop's 123456 abcdefg!", "ßßßßßß ﬁﬁﬁﬁﬁﬁ a b", "a b c d"]
    df = spark.createDataFrame([(f"{n}:{line[:2]}", line.split(" ")) for n in range(40) for line in odd], "k string, t array<string>")
    h = draw_hash(5, "typo", F.col("k"), 1)
    at = weighted_index(running_weights(typos.word_weights(F.col("t"))), lane(h, 0))
    e = typos.edit_word(F.get("t", F.col("at")), h)
    hit = F.exists(typos.word_weights(F.col("t")), lambda w: w > 0)
    made = df.withColumn("at", at).withColumn("hit", hit).select(
        typos.typo_sentence(F.col("t"), F.col("k"), 0.15, 5).alias("got"),
        F.struct(
            F.when(F.col("hit"), F.transform("t", lambda w, i: F.when(i == F.col("at"), e["word"]).otherwise(w))).otherwise(F.col("t")).alias("tokens"),
            F.when(F.col("hit"), e["sub"]).otherwise(0).alias("sub"),
            F.when(F.col("hit"), e["swap"]).otherwise(0).alias("swap"),
        ).alias("expected"),
    )
    rows = made.collect()
    assert all(r.got == r.expected for r in rows)
    assert sum(r.got.sub + r.got.swap for r in rows) > 100  # a word without ASCII letters can only be swapped
    assert "ArrowEvalPython" in executed(made)


def test_lines_travel_as_strings_and_once(spark):
    """Appended lines get no row of their own, and no array of tokens is shuffled."""
    out = batched(prepared(spark)).transform(noise.apply_recipe(RECIPES["both"], ["doc", "batch"], ["pos"], 8, 1))
    plan = executed(out)
    assert "posexplode_outer" not in plan and plan.count("ObjectHashAggregate") == 2
    assert "tokens:string" in out._jdf.queryExecution().analyzed().toString()
    rows = out.select("tokens", "noised", "noisy_src", "n_append").collect()
    assert any(r.n_append for r in rows)
    assert all(" " not in t and t for r in rows for t in (*r.tokens, *r.noised))
    assert all(r.noisy_src == " ".join(r.noised) for r in rows if not r.n_append)


@pytest.fixture
def documents(spark, tmp_path):
    texts = ["First one ends. Second one follows.\nAnother longer sentence. It goes on.", None, "\n \nAlone stands this.", "x. y. z."]
    rows = [(n, texts[n % 4], "en", "web", 60) for n in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_all_recipes_share_the_lines_they_change(spark, documents):
    got = registered.QUERIES["c11_named_recipes"](spark, documents)
    assert executed(got).count("FileScan parquet") == 1
    counts = {(r.recipe, r.split): (r.n_lines, r.n_changed) for r in got.collect()}
    assert len(counts) == 12 and all(counts[r, "train"][1] > 0 for r in RECIPES)
    assert {sum(n for (r, _), (n, _) in counts.items() if r == name) for name in RECIPES} == {200}


def test_snapshots_noise_the_lines_once(spark, documents):
    got = registered.QUERIES["e2_progress_snapshots"](spark, documents)
    assert "FileScan parquet" not in executed(got)
    assert [(r.snapshot, r.lines_before, r.lines_after) for r in got.collect()] == [(0, 300, 200)]


def test_documents_are_numbered_overall_too(spark):
    rows = [(8, "a\nb"), (18, None), (28, ""), (38, "\n\n"), (9, "x"), (7, None), (1, "c\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.first_line, r.first_of_all) for r in number_documents(docs, overall=True).collect()}
    assert got == {1: (0, 0), 7: (2, 2), 8: (0, 2), 9: (0, 4), 18: (2, 5), 28: (2, 5), 38: (3, 6)}


def test_partners_carry_no_text_that_is_not_asked_for(spark, documents):
    plan = executed(registered.QUERIES["d4_batch_partners"](spark, documents))
    batch = next(line for line in plan.splitlines() if "collect_list(struct" in line)
    assert "noised, noised#" in batch and "src, src#" not in batch and "non_alpha" not in batch
