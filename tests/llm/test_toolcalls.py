"""Linked tool calls against plain Python."""

import json
from collections import defaultdict

import duckdb
import pytest

from noisemix.llm import sql, toolcalls

SCHEMA = {
    "type": "object",
    "properties": {
        "n": {"type": "integer", "minimum": 0, "maximum": 9},
        "mode": {"type": "string", "enum": ["a", "b"]},
        "tags": {"type": "array", "items": {"type": "string", "maxLength": 2}},
        "x": {"type": "number"},
        "on": {"type": "boolean"},
    },
    "required": ["n"],
    "additionalProperties": False,
}


@pytest.mark.parametrize(
    ("value", "found"),
    [
        ({"n": 3, "mode": "a", "tags": ["x", "yy"], "x": 1.5, "on": True}, []),
        ({"n": 3.0}, []),
        ({}, ["$.n: missing"]),
        ({"n": True}, ["$.n: not of type integer"]),
        ({"n": 10, "mode": "c", "z": 1}, ["$.z: unexpected", "$.mode: not in enum", "$.n: above maximum"]),
        ({"n": -1, "tags": ["abc", 1]}, ["$.n: below minimum", "$.tags[0]: too long", "$.tags[1]: not of type string"]),
        ([], ["$: not of type object"]),
        (None, ["$: not of type object"]),
    ],
)
def test_validation(value, found):
    assert toolcalls.problems(value, SCHEMA) == found


def test_canonical_json():
    assert toolcalls.canonical({"b": [1, "é\n"], "a": {"z": None, "y": True}}) == '{"a":{"y":true,"z":null},"b":[1,"é\\n"]}'


CALLS = [
    (1, 1, "a", None, "t", '{"n": 1}'),
    (1, 2, "b", "a", "t", '{"mode":"a","n":2}'),
    (1, 3, "c", "b", "t", "{"),
    (1, 4, "d", "missing", "u", "{}"),
    (2, 1, "e", "f", "t", '{"n":1}'),
    (2, 2, "f", "e", "t", '{"n":1}'),
    (2, 3, "g", "f", "t", '{"n":1}'),
    (2, 4, "h", None, None, None),
    (2, 5, "i", None, "t", None),
    (None, None, "j", "a", "t", '{"n":99}'),
    (3, 1, None, "a", "t", '{"n":1}'),
    (1, 9, "a", "e", "t", '{"n":5}'),
    (1, 1, "a", None, "t", '{"n": 1}'),
]
RESULTS = [("a", 5, "late"), ("a", 2, "first"), ("b", 3, None), ("nobody", 1, "x"), (None, 1, "y")]


def test_links(spark):
    calls = spark.createDataFrame(CALLS, "conv_id long, turn int, call_id string, after string, name string, arguments string")
    results = spark.createDataFrame(RESULTS, "call_id string, turn int, content string")
    rows = {r["call_id"]: r for r in toolcalls.link(calls, results, {"t": SCHEMA}).collect()}
    assert {k: (r["level"], r["status"]) for k, r in rows.items()} == {
        "a": (0, "ok"),
        "b": (1, "ok"),
        "c": (2, "bad JSON"),
        "d": (0, "unknown tool"),
        "e": (None, "circular"),
        "f": (None, "circular"),
        "g": (None, "circular"),
        "h": (0, "unknown tool"),
        "i": (0, "$: not of type object"),
        "j": (1, "$.n: above maximum"),
    }
    assert rows["a"]["line"] == '{"after":null,"arguments":{"n":1},"id":"a","name":"t","result":"first"}'
    assert rows["b"]["line"] == '{"after":"a","arguments":{"mode":"a","n":2},"id":"b","name":"t","result":null}'


def test_long_chain_and_empty_tables(spark):
    chain = [(7, i, f"k{i:04}", f"k{i - 1:04}" if i else None, "t", '{"n":1}') for i in range(300)]
    schema = "conv_id long, turn int, call_id string, after string, name string, arguments string"
    none = spark.createDataFrame([], "call_id string, turn int, content string")
    out = toolcalls.link(spark.createDataFrame(chain, schema), none, {"t": SCHEMA}).collect()
    assert {r["turn"]: r["level"] for r in out} == {i: i for i in range(300)}
    assert {r["status"] for r in out} == {"no result"}
    assert toolcalls.link(spark.createDataFrame([], schema), none, {}).count() == 0


def test_conversations(spark):
    rows = [
        (1, 0, "user", "hé\n\"q\"", 1),
        (1, 1, "assistant", "yes", 1),
        (1, 2, "user", "", 1),
        (1, 3, "user", "z" * 500, 1),
        (1, 4, "assistant", None, 1),
        (1, 4, "assistant", None, 1),
        (1, 7, "user", None, 1),
        (2, 5, "user", "solo", 1),
        (2, 5, "user", "again", 1),
        (2, 6, "system", "no", 1),
        (None, 0, "user", "x", 1),
        (3, None, "user", "x", 1),
        (3, 1, None, "x", 1),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, call_id int")
    out = toolcalls.format_conversations(table).collect()
    by = defaultdict(dict)
    for r in out:
        by[r["conv_id"]][r["turn"]] = (r["level"], r["status"], json.loads(r["line"])["result"])
    assert by == {
        1: {
            0: (0, "ok", "yes"),
            2: (1, "$.n_chars: below minimum", None),
            3: (2, "$.text: too long", ""),
            7: (3, "$.n_chars: below minimum", None),
        },
        2: {5: (0, "no result", None)},
    }
    assert json.loads(next(r["line"] for r in out if r["conv_id"] == 2))["arguments"]["text"] == "again"
    assert toolcalls.format_conversations(table.where("false")).count() == 0


def test_no_row_of_a_conversation_is_lost(spark):
    rows = [
        (1, 0, "system", "be kind"),
        (1, 1, "user", "b"),
        (1, 1, "user", "a"),
        (1, 2, "assistant", "y"),
        (1, 2, "assistant", "x"),
        (1, 2, "assistant", "z"),
        (1, 3, "assistant", None),
        (1, 6, "user", None),
        (1, 8, "assistant", "after a gap"),
        (2, 1, "assistant", "first"),
        (2, 2, "tool", "é\n"),
        (2**60 + 1, 1, "user", "solo"),
        (None, 0, "user", "x"),
        (3, None, "user", None),
        (3, 1, None, "x"),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = toolcalls.format_every_row(table).collect()
    calls = {r["call_id"]: (r["level"], r["status"], json.loads(r["line"])) for r in out if r["call_id"] is not None}
    assert {k: (level, status, x["arguments"]["text"], x["result"], x["after"]) for k, (level, status, x) in calls.items()} == {
        "1:1": (0, "ok", "a", "x", None),
        "1:1#2": (1, "ok", "b", "y", "1:1"),
        "1:6": (2, "$.n_chars: below minimum", "", None, "1:1#2"),
        f"{2**60 + 1}:1": (0, "no result", "solo", None, None),
    }
    others = [(r["conv_id"], r["turn"], r["level"], r["status"], r["line"]) for r in out if r["call_id"] is None]
    plain = lambda role, text: toolcalls.canonical({"role": role, "text": text})
    assert sorted(others, key=str) == sorted(
        [
            (1, 0, None, "plain", plain("system", "be kind")),
            (1, 2, None, "no call", plain("assistant", "z")),
            (1, 3, None, "no call", plain("assistant", None)),
            (1, 8, None, "no call", plain("assistant", "after a gap")),
            (2, 1, None, "no call", plain("assistant", "first")),
            (2, 2, None, "plain", plain("tool", "é\n")),
            (None, 0, None, "plain", plain("user", "x")),
            (3, None, None, "plain", plain("user", None)),
            (3, 1, None, "plain", plain(None, "x")),
        ],
        key=str,
    )
    assert len(out) + sum(x["result"] is not None for *_, x in calls.values()) == len(rows)
    conversations = table.toArrow()  # noqa: F841
    twin = duckdb.sql(f"with conversations as (from conversations) {sql.TOOL_CALLS.strip().replace('WITH ', ', ', 1)}").fetchall()
    assert sorted(twin, key=str) == sorted(map(tuple, out), key=str)
    assert toolcalls.format_every_row(table.where("false")).count() == 0
