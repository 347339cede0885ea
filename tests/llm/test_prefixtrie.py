"""The prefix trie against plain Python, in one shard and in many."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from noisemix.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string, path string, sizes string, depth long, skeleton long"


def plain(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns[conv].append((turn is not None, turn or 0, tie, (role, text)))
    own = {c: [x[-1] for x in sorted(t)] for c, t in turns.items()}
    nodes = defaultdict(list)
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = abs(c) // 5 * 5 * (1 if c >= 0 else -1)
        rebuilt = own.get(base, [])[:h] + seq[h:]
        for d in range(len(rebuilt) + 1):
            nodes[tuple(rebuilt[:d])].append((c, len(rebuilt)))
    below = Counter(k[:-1] for k in nodes if k)
    leaves, saved = Counter(), Counter()
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not below[k]
            saved[k[:d]] += (len(members) - 1) * len(k[-1][1].encode()) if k else 0
    out = []
    for k, members in nodes.items():
        ends = ",".join(str(c) for c, n in sorted(members) if n == len(k))
        parent = min(nodes[k[:-1]])[0] if k else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(members)[0], len(k), parent, len(members), below[k], leaves[k], saved[k], digest))
    return Counter(out)


def conversations(seed, n, most=7, words="abc"):
    rng = random.Random(seed)
    ids = rng.sample(range(-3 * n, 9 * n), n)
    rows = []
    for c in ids:
        for turn in range(rng.randint(0, most)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(words) * rng.randint(1, 3)))
    for c in range(20 * n, 20 * n + n):  # many copies of one conversation, and one turn that many begin with
        rows += [(c, t, "user", "hot é") for t in range(9 + 5)]
        rows.append((c + 10 * n, 0, "user", "hot é"))
    return rows


ODD = [
    (None, 0, "user", "x"),
    (1, None, None, None),
    (1, 0, "user", "a"),
    (1, 0, "user", "a"),
    (1, 0, "assistant", "b"),
    (5, 3, "", ""),
    (6, 3, None, ""),
    (7, 1, "use", "rx"),
    (8, 1, "user", "x"),
    (-3, 2, "user", "y"),
    (-5, 2, "user", "z"),
]


def rows_of(spark, rows):
    df = spark.createDataFrame([(*r, None, None, None, None) for r in rows], SCHEMA)
    return Counter(tuple(r) for r in prefixtrie.conversation_trie(df).collect())


@pytest.fixture
def many_shards(spark):
    """Keeps Spark from joining small partitions, so that nodes lie across shards."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def test_odd_rows_and_empty_table(spark):
    assert rows_of(spark, ODD) == plain(ODD)
    assert rows_of(spark, [r for r in ODD if r[0] is None]) == Counter()


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_in_many_shards(spark, many_shards, monkeypatch, seed):
    monkeypatch.setattr(prefixtrie, "ENDS_OUT", 3)
    rows = conversations(seed, 60)
    assert rows_of(spark, rows) == plain(rows)


def test_shards_agree_whatever_the_cuts():
    """Any cut of the sorted paths gives the nodes that one shard gives."""
    rng = random.Random(4)
    steps = [c * prefixtrie.STEP for c in "abc"]
    paths = sorted(("".join(rng.choices(steps, k=rng.randint(0, 6))), i) for i in range(80))
    for cuts in ([], [40], [0, 1, 2, 3], sorted(rng.sample(range(80), 12)), range(1, 80)):
        bounds = [0, *cuts, 80]
        parts = [p for p in (paths[a:b] for a, b in zip(bounds, bounds[1:])) if p]
        crossing = [a[-1][0][: prefixtrie.STEP * prefixtrie._common(a[-1][0], b[0][0])] for a, b in zip(parts, parts[1:])]
        skeleton = prefixtrie.Skeleton(sorted(set(crossing)))
        rows = []
        for part in parts:
            shard = prefixtrie.Shard(skeleton)
            for path, conv in part:
                shard.add(conv, path, [len(path) % 7] * (len(path) // prefixtrie.STEP))
            while shard.stack:
                shard.close()
            rows += shard.rows
        partial = {}
        for r in (r for r in rows if r[0] == prefixtrie.PARTIAL):
            old = partial.get(r[1], (r[3], 0, 0, 0, 0, 0))
            partial[r[1]] = (min(old[0], r[3]), *(x + y for x, y in zip(old[1:5], r[6:10])), r[2])
        whole = Counter((r[1], r[2], r[4], r[5], r[6]) for r in skeleton.reduced(partial))
        whole += Counter((r[3], r[4], r[6], r[7], r[8]) for r in rows if r[0] in (prefixtrie.DONE, prefixtrie.BELOW))
        if not cuts:
            expected = whole
        assert whole == expected
