import pandas as pd
import pytest
from pyspark.sql import functions as F

from noisemix.operators import noise
from noisemix.operators.lexicon import no_proper_nouns
from noisemix.operators import paraphrase
from noisemix.operators.paraphrase import candidates_from
from noisemix.plans.recipes import RECIPES
from noisemix.sources import bitext, blocks, checkpoints, corpora, sinks
from noisemix.streaming import incremental


def test_lines_are_numbered_across_files_and_splits(spark, tmp_path):
    lines = [f"line {i} {'x' * (i % 40)}" for i in range(5000)]
    for n, start in enumerate(range(0, 5000, 1250)):
        (tmp_path / f"part-{n}.txt").write_text("\n".join(lines[start : start + 1250]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")  # several splits per file
    try:
        read = bitext.read_lines(spark, str(tmp_path))
        assert read.rdd.getNumPartitions() > 4
        got = [r.line for r in read.orderBy("sent_id").collect()]
        ids = sorted(r.sent_id for r in read.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == lines and ids == list(range(5000))


def test_bitext_is_cut_at_the_shorter_side(spark, tmp_path):
    (tmp_path / "a.en").write_text("one\ntwo\n\nfour\n")
    (tmp_path / "a.es").write_text("uno\ndos\ntres\n")
    rows = bitext.read_bitext(spark, str(tmp_path / "a.en"), str(tmp_path / "a.es")).orderBy("sent_id").collect()
    assert [tuple(r) for r in rows] == [(0, "one", "uno"), (1, "two", "dos"), (2, "", "tres")]


def test_generation_log(spark):
    rows = ["S-0\tcamisa", "T-0\tuna camisa", "H-0\t-0.1\tuna T-shirt", "D-0\t-0.1\tuna T-shirt", "P-0\t-0.1", "T-1\tsolo", "noise T-2\tx"]
    out = bitext.parse_generation_log(spark.createDataFrame([(r,) for r in rows], "value string")).collect()
    assert [tuple(r) for r in out] == [(0, "una T-shirt", "una camisa")]


def test_shard_numbers(spark, tmp_path):
    for n in (3, 12):
        (tmp_path / f"train.clean.{n}").write_text(f"shard {n}\n")
    rows = bitext.read_shards(spark, str(tmp_path / "train.clean.*")).collect()
    assert sorted((r.shard, r.line) for r in rows) == [(3, "shard 3"), (12, "shard 12")]


def test_rewriting_a_partition_doubles_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "train"), (2, "dev"), (3, "dev")], "k long, split string")
    sinks.write_pairs(df, path)
    sinks.write_pairs(df.filter("split = 'dev'"), path)
    assert sorted(r.k for r in sinks.read_pairs(spark, path).collect()) == [1, 2, 3]


def test_write_once_keeps_the_first(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.write_once(spark.range(3), path).count() == 3
    assert sinks.write_once(spark.range(9), path).count() == 3


def test_reuse_makes_only_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(4)

    for _ in range(2):
        assert sinks.reuse(spark, str(tmp_path / "t"), make).count() == 4
    assert len(made) == 1


def test_remaining(spark):
    rest = sinks.remaining(spark.range(5), spark.range(3), ["id"])
    assert sorted(r.id for r in rest.collect()) == [3, 4]


def test_dry_run_counts(spark):
    assert sinks.dry_run(spark.range(7), "n", F.count(F.lit(1)).alias("rows")) == {"rows": 7}


def test_paraphraser_hook(spark):
    lines = spark.createDataFrame([(1, "a b"), (2, "c")], "sent_id long, src string")
    out = candidates_from(lines, lambda batch: [[s.upper(), s + "!"] if " " in s else [] for s in batch], ["sent_id"])
    assert sorted(map(tuple, out.collect())) == [(1, 0, "A B"), (1, 1, "a b!")]


def test_a_shared_folder_is_needed(spark):
    folder = checkpoints.shared_folder(spark)
    assert folder and checkpoints.shared_folder(spark) == folder

    class Context:
        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = type("Conf", (), {"get": staticmethod(lambda name, default: default)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoints.shared_folder(Session())


@pytest.mark.parametrize("files", [1, 3])
def test_stream_equals_batch_and_restarts(spark, tmp_path, files):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for n in range(files):
        docs.filter(F.col("doc_id") % files == n).coalesce(1).write.parquet(str(tmp_path / f"stage{n}"))
    arrived, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    arrived.mkdir()
    for n in range(files):  # each run sees one file more
        part = next((tmp_path / f"stage{n}").glob("*.parquet"))
        (arrived / f"documents-{n}.parquet").write_bytes(part.read_bytes())
        stream = incremental.stream_documents(spark, str(arrived))
        incremental.write_incrementally(
            incremental.noised_lines(stream, RECIPES["both"], 3), out, state
        ).awaitTermination()
    batch = (
        corpora.lines_of(docs)
        .withColumn("tgt", F.col("src"))
        .transform(noise.prepare(["doc_id", "pos"]))
        .transform(no_proper_nouns)
        .transform(noise.compound_noise(RECIPES["both"], 3))
        .select("doc_id", "pos", F.array_join("noised", " ").alias("noisy"), "n_sub", "n_swap", "n_runon")
    )
    got = spark.read.parquet(out).select(*batch.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.collect()))


def _numbered(spark, sizes):
    rows = [(split, i, f"{split} {i}") for split, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "split string, split_line long, src string")


def test_work_resumes_at_the_first_block_that_is_not_done(spark, tmp_path):
    root, out = str(tmp_path / "blocks"), str(tmp_path / "out")
    lines = _numbered(spark, {"train": 95, "dev": 12, "test": 10})
    blocks.write_blocks(lines, root, 10)
    assert blocks.offsets(spark, out) == {}
    seen = []

    def work(rows):
        seen.append({(r.split, r.block) for r in rows.select("split", "block").collect()})
        return rows.select("split", "split_line", F.upper("src").alias("src"))

    assert blocks.advance(spark, root, out, work, 4)
    assert blocks.offsets(spark, out) == {"train": 4, "dev": 2, "test": 1}
    # a run that claimed its blocks and was killed: it is repeated under its claim, whatever is asked for now
    assert blocks.advance(spark, root, out, work, 3)
    (tmp_path / "out" / "made" / "version-000000000001" / "_SUCCESS").unlink()
    assert blocks.offsets(spark, out)["train"] == 4
    assert blocks.advance(spark, root, out, work, 1)
    assert seen[1] == seen[2] == {("train", b) for b in (4, 5, 6)}
    assert blocks.advance(spark, root, out, work)
    assert seen[3] == {("train", b) for b in (7, 8, 9)}
    assert not blocks.advance(spark, root, out, work)
    got = [tuple(r) for r in blocks.made(spark, out).collect()]
    assert sorted(got) == sorted((r.split, r.split_line, r.src.upper()) for r in lines.collect())


def test_blocks_that_are_done_are_not_read(spark, tmp_path):
    root = str(tmp_path / "blocks")
    blocks.write_blocks(_numbered(spark, {"train": 95, "dev": 12}), root, 10)
    rest = blocks.claimed_lines(spark, root, [("train", 7, 10), ("dev", 1, 2)])
    assert rest.count() == 25 + 2
    assert len(rest.inputFiles()) == 10 + 2  # the folder; the scan takes what its partition filters leave
    plan = rest._jdf.queryExecution().executedPlan()
    assert "PartitionFilters: [(((split" in plan.toString() and "Exchange" not in plan.toString()
    scanned = rest.select(F.input_file_name()).distinct().count()
    assert scanned == 3 + 1


def test_an_empty_table_has_no_blocks(spark, tmp_path):
    root = str(tmp_path / "blocks")
    blocks.write_blocks(_numbered(spark, {"train": 1}).limit(0), root, 10)
    assert not blocks.advance(spark, root, str(tmp_path / "out"), lambda rows: rows)


def test_shards_keep_the_order_of_their_lines(spark, tmp_path):
    """Shard 0 holds most lines and is written by several tasks; blank lines and repeated lines stay."""
    rows = [(0 if i % 10 else i % 3, i, "" if i % 7 == 0 else f"line {i % 50}\r of it") for i in range(4000)]
    lines = spark.createDataFrame(rows, "n int, at long, src string").repartition(7)
    path = str(tmp_path / "out")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sinks.write_shards(lines, path, "n", ["at"], "src")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "out" / "shard=0").glob("part-*"))) > 1
    got = {}
    for r in bitext.read_shard_lines(spark, path).orderBy("shard", "line_no").collect():
        got.setdefault(r.shard, []).append(r.line)
    expected = {}
    for n, _, src in rows:
        expected.setdefault(n, []).append(src)
    assert got == expected


def test_the_writer_of_shards_does_not_sort_again(spark, tmp_path):
    """A second sort, on the shard alone, could change the order of its lines."""
    lines = spark.range(100).select((F.col("id") % 3).alias("n"), "id", F.col("id").cast("string").alias("src"))
    sinks.write_shards(lines, str(tmp_path / "out"), "n", ["id"], "src")
    store = spark._jsparkSession.sharedState().statusStore()
    plans = [store.executionsList().apply(i).physicalPlanDescription() for i in range(store.executionsList().size())]
    written = [p for p in plans if str(tmp_path / "out") in p][-1]
    tree = written[: written.index("\n\n\n")] if "\n\n\n" in written else written
    final = tree[: tree.index("Initial Plan")] if "Initial Plan" in tree else tree
    assert final.count("Sort (") == 1


def test_rewrites_of_long_lines_leave_in_pieces(monkeypatch):
    """No frame holds all rewrites of a batch, and none is lost."""
    monkeypatch.setattr(paraphrase, "CALL_CHARACTERS", 40)
    monkeypatch.setattr(paraphrase, "OUT_CHARACTERS", 100)
    batch = pd.DataFrame({"k": range(30), "src": ["x" * (n % 13) for n in range(29)] + ["y" * 90]})
    parts = list(paraphrase._parts(batch, "src"))
    assert pd.concat(parts).equals(batch)
    assert all(len(p) == 1 or p.src.str.len().sum() <= 40 for p in parts)
    out = [rows for p in parts for rows in paraphrase._rows(p[["k"]], [[s] * (len(s) % 5) for s in p.src])]
    assert max(rows.phrase.str.len().sum() for rows in out) < 200
    got = [(r.k, r["rank"], r.phrase) for rows in out for _, r in rows.iterrows()]
    assert got == [(k, i, s) for k, s in zip(batch.k, batch.src) for i in range(len(s) % 5)]


def test_pairs_are_written_compactly(spark, tmp_path):
    """Rewriting a partition leaves the other as it was; alike lines take a fraction of their text."""
    line = "a sentence that comes again and again with one other word in it, namely {} "
    rows = [(n, "dev" if n % 10 == 0 else "train", line.format(n % 977) * 4) for n in range(4000)]
    df = spark.createDataFrame(rows, "id long, split string, src string").coalesce(1)
    sinks.write_pairs(df, str(tmp_path / "pairs"))
    sinks.write_pairs(df.filter("split = 'dev'"), str(tmp_path / "pairs"))
    got = sinks.read_pairs(spark, str(tmp_path / "pairs"))
    assert sorted((r.id, r.split, r.src) for r in got.collect()) == rows
    df.write.partitionBy("split").option("compression", "snappy").parquet(str(tmp_path / "plain"))
    compact, plain = (sum(f.stat().st_size for f in (tmp_path / name).rglob("*.parquet")) for name in ("pairs", "plain"))
    assert compact * 2 < plain
