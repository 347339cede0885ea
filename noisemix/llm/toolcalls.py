"""Chat formatting with linked tool calls.

Calls and results are joined by identifier, calls are put in topological order of what they follow,
their arguments are validated against the tool's schema, and each call with its result becomes
one line of canonical JSON (sorted keys, no spaces, characters as they are).

A call follows at most one other call, as in a tree of messages, so levels come from pointer
doubling: as many rounds as the logarithm of the longest chain, and no conversation is collected.

``format_every_row`` has a line for every row of the conversations, a result sharing its call's line.
``format_conversations`` gives the calls alone: rows of other roles, results without a call and all
but one of the rows that repeat a turn have no line there.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from noisemix.sources.checkpoints import cut

Schema = dict
#: The tool of the registered query.
ANSWER = {
    "type": "object",
    "properties": {
        "n_chars": {"type": "integer", "minimum": 1},
        "text": {"type": "string", "minLength": 1, "maxLength": 400},
    },
    "required": ["n_chars", "text"],
    "additionalProperties": False,
}
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def problems(value: object, schema: Schema, at: str = "$") -> list[str]:
    """What in ``value`` fails the schema: type, enum, properties, items and bounds."""
    out = []
    kind = schema.get("type")
    number = isinstance(value, int | float) and not isinstance(value, bool)
    if kind == "integer":
        fits = number and float(value).is_integer()
    elif kind == "number":
        fits = number
    else:
        fits = kind is None or isinstance(value, _TYPES[kind])
    if not fits:
        return [f"{at}: not of type {kind}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if number:
        if value < schema.get("minimum", value):
            out.append(f"{at}: below minimum")
        if value > schema.get("maximum", value):
            out.append(f"{at}: above maximum")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{at}: too short")
        if len(value) > schema.get("maxLength", len(value)):
            out.append(f"{at}: too long")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in sorted(schema.get("required", ())) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{at}.{k}: unexpected" for k in sorted(value) if k not in known]
        for k in sorted(set(value) & set(known)):
            out += problems(value[k], known[k], f"{at}.{k}")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += problems(x, schema["items"], f"{at}[{i}]")
    return out


def _levels(calls: DataFrame) -> DataFrame:
    """``call_id, level``: how many calls a call comes after; null in or behind a circle.

    Each round doubles the distance to which a call looks ahead.  What ``after`` names but isn't
    there counts as nothing.
    """
    known = calls.select(F.col("call_id").alias("after"))
    now = calls.select("call_id", "after").join(known, "after", "left_semi")
    now = cut(
        calls.select("call_id").join(now, "call_id", "left").select(
            "call_id", F.col("after").alias("up"), F.when(F.col("after").isNotNull(), 1).otherwise(0).alias("level")
        )
    )
    reach, rows = 1, now.count()
    while reach <= rows and not now.where("up is not null").isEmpty():
        above = now.select(F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("level").alias("more"))
        now = cut(
            now.join(above, "up", "left").select(
                "call_id", F.col("next").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")
            )
        )
        reach *= 2
    return now.select("call_id", F.when(F.col("up").isNull(), F.col("level")).alias("level"))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, Schema]) -> DataFrame:
    """One row for each call id: ``conv_id, turn, call_id, level, status, line``.

    ``calls``: ``conv_id, turn, call_id, after, name, arguments`` (JSON); ``results``: ``call_id, turn,
    content``.  Of calls or results that repeat an id the one with the smallest turn counts, ties
    going to the smaller text.  Calls with a null id are left out: nothing can refer to them.
    ``status`` is ``ok``, ``no result``, ``circular``, ``unknown tool``, ``bad JSON`` or the first problem.
    Ordered by ``conv_id, level, turn, call_id`` the lines of a conversation follow one another.
    """
    first = F.min(F.struct("turn", "conv_id", "after", "name", "arguments")).alias("c")
    calls = cut(calls.where("call_id is not null").groupBy("call_id").agg(first).select("call_id", "c.*"))
    answer = F.min(F.struct("turn", "content")).alias("r")
    answers = results.where("call_id is not null").groupBy("call_id").agg(answer)
    answers = answers.select("call_id", F.col("r.content").alias("content"), F.lit(True).alias("answered"))
    linked = calls.join(answers, "call_id", "left").join(_levels(calls), "call_id")

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [_line(*row, schemas) for row in zip(*(batch[c] for c in _INPUT), strict=True)]
            status, text = zip(*made, strict=True) if made else ((), ())
            yield batch[["conv_id", "turn", "call_id"]].assign(level=batch["level"].astype("Int32"), status=status, line=text)

    kinds = dict(linked.dtypes)
    kept = ", ".join(f"{c} {kinds[c]}" for c in ("conv_id", "turn", "call_id"))
    return linked.select("conv_id", "turn", *_INPUT).mapInPandas(lines, f"{kept}, level int, status string, line string")


_INPUT = ["call_id", "after", "name", "arguments", "content", "answered", "level"]


def _line(call_id, after, name, arguments, content, answered, level, schemas: dict[str, Schema]) -> tuple[str, str]:
    answered = answered is True
    record = {"after": after, "arguments": arguments, "id": call_id, "name": name, "result": content if answered else None}
    try:
        record["arguments"] = json.loads(arguments) if arguments is not None else None
    except ValueError:
        return "bad JSON", canonical(record)
    if name not in schemas:
        return "unknown tool", canonical(record)
    if pd.isna(level):
        return "circular", canonical(record)
    wrong = problems(record["arguments"], schemas[name])
    if wrong:
        return wrong[0], canonical(record)
    return "ok" if answered else "no result", canonical(record)


def calls_of_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that a chat stands for: a user's turn calls ``answer``, what the assistant
    says in the next turn is the result, and a call comes after the conversation's call before it.

    Conversations with a null id and rows with a null turn or role give neither.  The window
    streams over one conversation in order.
    """
    by = Window.partitionBy("conv_id").orderBy("turn")
    rows = conversations.where("conv_id is not null and turn is not null and role is not null")
    text = F.coalesce("text", F.lit(""))
    name = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    asked = rows.where("role = 'user'").groupBy("conv_id", "turn").agg(F.min(text).alias("text"))
    arguments = F.to_json(F.struct(F.col("text"), F.length("text").alias("n_chars")))
    calls = asked.select(
        "conv_id", "turn", name.alias("call_id"), F.lag(name).over(by).alias("after"), F.lit("answer").alias("name"), arguments.alias("arguments")
    )
    said = rows.where("role = 'assistant'")
    before = F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string"))
    return calls, said.select(before.alias("call_id"), "turn", text.alias("content"))


@F.pandas_udf(StringType())
def _plain_line(role: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([canonical({"role": r, "text": t}) for r, t in zip(role, text, strict=True)], dtype=object)


def format_every_row(conversations: DataFrame) -> DataFrame:
    """As ``format_conversations``, and no row of ``conversations`` is left out.

    Each user's row is a call.  Of rows that repeat conversation, turn and role the k-th, by text, has
    ``#k`` behind its id from the second on; the k-th assistant's row of the next turn is its result.
    A result without a call is a line of its own with status ``no call``; so is, with status ``plain``,
    a row of any other role or with a null conversation, turn or role.  Both have no id and no level.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    linkable = F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False)) & F.expr("conv_id is not null and turn is not null")
    text = F.coalesce("text", F.lit(""))
    same = Window.partitionBy("conv_id", "turn", "role").orderBy(text, "text")
    rows_of_calls = cut(rows.where(linkable).withColumn("k", F.row_number().over(same)))

    def name(turn: Column) -> Column:
        repeat = F.when(F.col("k") > 1, F.concat(F.lit("#"), F.col("k").cast("string"))).otherwise("")
        return F.concat(F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string")), repeat)

    by = Window.partitionBy("conv_id").orderBy("turn", "k")
    asked = rows_of_calls.where("role = 'user'").withColumn("text", text).withColumn("call_id", name(F.col("turn")))
    arguments = F.to_json(F.struct(F.col("text"), F.length("text").alias("n_chars")))
    calls = asked.select(
        "conv_id", "turn", "call_id", F.lag("call_id").over(by).alias("after"), F.lit("answer").alias("name"), arguments.alias("arguments")
    )
    said = rows_of_calls.where("role = 'assistant'").withColumn("call_id", name(F.col("turn") - 1))
    linked = link(calls, said.select("call_id", "turn", text.alias("content")), {"answer": ANSWER})
    alone = said.join(asked.select("call_id"), "call_id", "left_anti").select(*rows.columns, F.lit("no call").alias("status"))
    others = alone.unionByName(rows.where(~linkable).withColumn("status", F.lit("plain")))
    return linked.unionByName(
        others.select(
            "conv_id", "turn", F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("int").alias("level"), "status",
            _plain_line("role", "text").alias("line"),
        )
    )


def format_conversations(conversations: DataFrame) -> DataFrame:
    """The lines of the calls of ``calls_of_conversations`` alone, one for each conversation and user's turn.

    Null conversations, turns and roles give no line, a null text counts as empty, texts of any length
    stay whole, of repeated rows the smallest text counts, and an empty table has no lines.  Other
    columns of the table, whatever their names, aren't read.
    """
    calls, results = calls_of_conversations(conversations)
    return link(calls, results, {"answer": ANSWER})
