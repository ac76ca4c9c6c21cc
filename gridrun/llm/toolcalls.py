"""Chat formatting: tool calls linked with their results.

Calls and results are hash-joined by conversation and identifier, calls are put in topological order by the level of
the call they need (pointer doubling, so a chain of n calls takes log2 n rounds), arguments are checked against
schemas and every linked call is written as canonical JSON: sorted keys, no blanks, UTF-8.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridrun.llm.common import slices, stored

#: Argument names of each tool: JSON type and whether it is required.
SCHEMAS: dict[str, dict[str, tuple[str, bool]]] = {
    "respond": {"text": ("string", True), "turn": ("integer", True)},
    "configure": {"text": ("string", True), "turn": ("integer", True)},
}
TYPES = {
    "string": lambda v: isinstance(v, str),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "boolean": lambda v: isinstance(v, bool),
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
}
MESSAGE = "kind string, conv_id bigint, call_id string, turn bigint, place int, name string, arguments string, needs string, content string"
NAMES = [c.split()[0] for c in MESSAGE.split(", ")]


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _parsed(text: str | None) -> dict:
    """The object that a message's text holds, or nothing."""
    if not text or text[:1] != "{":
        return {}
    try:
        value = json.loads(text)
    except ValueError:
        return {}
    return value if isinstance(value, dict) else {}


def message_rows(conv: int | None, turn: int | None, role: str | None, text: str | None) -> list[tuple]:
    """Calls and results in one message.

    ``{"tool_calls": [{"id", "name", "arguments", "needs"}]}`` holds calls, ``{"tool_call_id", "content"}`` a result. In
    plain chat a user or system turn is a call of ``respond`` or ``configure`` with the turn as identifier, and the
    assistant turn after a user turn is its result; a user turn needs the call one turn (system) or two turns (user)
    before, whichever there is.
    """
    value = _parsed(text)
    if isinstance(value.get("tool_calls"), list):
        out = []
        for i, call in enumerate(value["tool_calls"]):
            if isinstance(call, dict) and call.get("id") is not None:
                arguments, needs = call.get("arguments"), call.get("needs")
                written = arguments if isinstance(arguments, str) else None if arguments is None else canonical(arguments)
                out.append(("call", conv, str(call["id"]), turn, i, None if call.get("name") is None else str(call["name"]), written, None if needs is None else str(needs), None))
        return out
    if value.get("tool_call_id") is not None:
        content = value.get("content")
        return [("result", conv, str(value["tool_call_id"]), turn, 0, None, None, None, content if isinstance(content, str) or content is None else canonical(content))]
    if turn is None:
        return []
    if role in ("user", "system"):
        name = "respond" if role == "user" else "configure"
        return [("call", conv, str(turn), turn, 0, name, canonical({"text": text, "turn": turn}), f"plain:{turn}" if role == "user" else None, None)]
    if role == "assistant":
        return [("result", conv, str(turn - 1), turn, 0, None, None, None, text)]
    return []


def extract(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of ``conv_id, turn, role, text`` rows; calls with their needs resolved for plain chat."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
        for part, texts in slices(batches):
            cols = [part.column(c).to_pylist() for c in ("conv_id", "turn", "role")]
            rows = [r for conv, turn, role, text in zip(*cols, texts, strict=True) for r in message_rows(conv, turn, role, text)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=NAMES)

    rows = stored(messages.select("conv_id", "turn", "role", "text").mapInArrow(scan, MESSAGE))
    calls = rows.where("kind = 'call'").select("conv_id", "call_id", "turn", "place", "name", "arguments", "needs")
    results = rows.where("kind = 'result'").select("conv_id", "call_id", "turn", "content")
    # a plain user turn looks for the turn before and the one before that
    ids = calls.select("conv_id", F.col("call_id").alias("seen")).distinct()
    plain = calls.where(F.col("needs").startswith("plain:"))
    wanted = plain.select("conv_id", "call_id", F.explode(F.array(F.col("turn") - 1, F.col("turn") - 2)).alias("before"))
    near = wanted.alias("w").join(ids.alias("i"), same("w", "i") & (F.col("w.before").cast("string") == F.col("i.seen"))).groupBy("w.conv_id", "w.call_id").agg(F.max("w.before").cast("string").alias("before"))
    joined = calls.alias("c").join(near.alias("n"), same("c", "n") & (F.col("c.call_id") == F.col("n.call_id")), "left")
    needs = F.when(F.col("c.needs").startswith("plain:"), F.col("n.before")).otherwise(F.col("c.needs"))
    return joined.select("c.conv_id", "c.call_id", "c.turn", "c.place", "c.name", "c.arguments", needs.alias("needs")), results


def same(a: str, b: str) -> Column:
    return F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id"))


def levels(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, level, problem``: steps to a call that needs none; a cycle, or what leads into one, has level -1."""
    known = calls.select("conv_id", "call_id")
    start = calls.alias("c").join(known.alias("k"), same("c", "k") & (F.col("c.needs") == F.col("k.call_id")), "left")
    now = stored(start.select("c.conv_id", "c.call_id", F.col("k.call_id").alias("up"), F.when(F.col("k.call_id").isNotNull(), 1).otherwise(0).cast("long").alias("level"), F.when(F.col("c.needs").isNotNull() & F.col("k.call_id").isNull(), "unknown need").alias("problem")))
    waiting = now.where("up IS NOT NULL").count()
    while waiting:
        step = now.alias("a").join(now.alias("b"), same("a", "b") & (F.col("a.up") == F.col("b.call_id")), "left")
        now = stored(step.select("a.conv_id", "a.call_id", F.col("b.up").alias("up"), (F.col("a.level") + F.coalesce("b.level", F.lit(0))).alias("level"), "a.problem"))
        left = now.where("up IS NOT NULL").count()
        if left == waiting:  # every round ends some chain, but for cycles
            break
        waiting = left
    cycle = F.col("up").isNotNull()
    return now.select("conv_id", "call_id", F.when(cycle, -1).otherwise(F.col("level")).cast("long").alias("level"), F.when(cycle, "cycle").otherwise(F.col("problem")).alias("problem"))


def checked(name: str | None, arguments: str | None, schemas: Mapping[str, Mapping[str, tuple[str, bool]]]) -> tuple[object, list[str]]:
    """The arguments as a value, and what is wrong with them."""
    try:
        value = {} if arguments is None else json.loads(arguments)
    except ValueError:
        return arguments, ["not JSON"]
    if name not in schemas:
        return value, ["unknown tool"]
    if not isinstance(value, dict):
        return value, ["not an object"]
    schema, wrong = schemas[name], []
    for key, (kind, required) in sorted(schema.items()):
        if value.get(key) is None:
            wrong += [f"missing {key}"] * required
        elif not TYPES[kind](value[key]):
            wrong.append(f"{key} is no {kind}")
    return value, wrong + [f"unknown {key}" for key in sorted(value) if key not in schema]


def link(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping[str, tuple[str, bool]]] = SCHEMAS) -> DataFrame:
    """One row per call: ``conv_id, call_id, turn, level, name, n_results, valid, problems, json``.

    Order within a conversation: level, turn, place in the message. Of calls with one identifier the first in that
    order counts, of results the first by turn; ``n_results`` counts them all. A null conversation is one of its own.
    Results without a call are left out. No call is gathered with its conversation, so a conversation may be of any size.
    """
    first = calls.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "place", "name", "arguments", "needs")).alias("best"))
    first = stored(first.select("conv_id", "call_id", *[F.col(f"best.{x}").alias(x) for x in ("turn", "place", "name", "arguments", "needs")]))
    answer = results.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results"))
    keys = lambda a, b: same(a, b) & (F.col(f"{a}.call_id") == F.col(f"{b}.call_id"))
    joined = first.alias("c").join(answer.alias("r"), keys("c", "r"), "left").join(levels(first).alias("l"), keys("c", "l"))
    rows = joined.select("c.conv_id", "c.call_id", "c.turn", "c.place", "l.level", "c.name", F.coalesce("r.n_results", F.lit(0)).cast("long").alias("n_results"), "c.arguments", "c.needs", F.col("r.r.content").alias("text"), "l.problem")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, contents in slices(batches):
            cols = [part.column(c).to_pylist() for c in ("call_id", "name", "arguments", "needs", "n_results", "problem")]
            valid, problems, written = [], [], []
            for call_id, name, arguments, needs, n, problem, content in zip(*cols, contents, strict=True):
                value, wrong = checked(name, arguments, schemas)
                wrong = [problem] * (problem is not None) + wrong
                valid.append(not wrong)
                problems.append("; ".join(wrong))
                call = {"arguments": value, "id": call_id, "name": name}
                written.append(canonical(call | ({"needs": needs} if needs is not None else {}) | ({"result": content} if n else {})))
            keep = ["conv_id", "call_id", "turn", "place", "level", "name", "n_results"]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(valid, pa.bool_()), pa.array(problems, pa.string()), pa.array(written, pa.string())], names=[*keep, "valid", "problems", "json"])

    return rows.mapInArrow(write, "conv_id bigint, call_id string, turn bigint, place int, level bigint, name string, n_results bigint, valid boolean, problems string, json string")


def format_conversations(messages: DataFrame, schemas: Mapping[str, Mapping[str, tuple[str, bool]]] = SCHEMAS) -> DataFrame:
    """``link`` over the calls and results found in ``conv_id, turn, role, text`` messages; messages of other kinds give no row."""
    return link(*extract(messages), schemas)


ORACLE = r"""
WITH m AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
c AS (SELECT conv_id, turn, min(struct_pack(role := CASE role WHEN 'system' THEN 'configure' ELSE 'respond' END, text := text)) AS v FROM m WHERE role IN ('user', 'system') GROUP BY conv_id, turn),
r AS (SELECT conv_id, turn - 1 AS turn, count(*) AS n, min(text) AS content FROM conversations WHERE role = 'assistant' GROUP BY conv_id, turn),
p AS (SELECT c.conv_id, c.turn, c.v.role AS name, c.v.text AS text,
             CASE WHEN c.v.role = 'respond' THEN coalesce(a.turn, b.turn) END AS need
      FROM c LEFT JOIN c a ON a.conv_id = c.conv_id AND a.turn = c.turn - 1 LEFT JOIN c b ON b.conv_id = c.conv_id AND b.turn = c.turn - 2),
up AS (
  WITH RECURSIVE w AS (
    SELECT conv_id, turn, 0 AS level FROM p WHERE need IS NULL
    UNION ALL SELECT p.conv_id, p.turn, w.level + 1 FROM p JOIN w ON p.conv_id = w.conv_id AND p.need = w.turn)
  SELECT * FROM w)
SELECT p.conv_id, CAST(p.turn AS VARCHAR) AS call_id, p.turn, CAST(0 AS INTEGER) AS place, CAST(up.level AS BIGINT) AS level, p.name,
       CAST(coalesce(r.n, 0) AS BIGINT) AS n_results, p.text IS NOT NULL AS valid, CASE WHEN p.text IS NULL THEN 'missing text' ELSE '' END AS problems,
       '{"arguments":{"text":' || coalesce(CAST(to_json(p.text) AS VARCHAR), 'null') || ',"turn":' || p.turn || '},"id":"' || p.turn || '","name":"' || p.name || '"'
         || CASE WHEN need IS NULL THEN '' ELSE ',"needs":"' || need || '"' END
         || CASE WHEN r.n IS NULL THEN '' ELSE ',"result":' || coalesce(CAST(to_json(r.content) AS VARCHAR), 'null') END || '}' AS json
FROM p JOIN up ON p.conv_id = up.conv_id AND p.turn = up.turn LEFT JOIN r ON r.conv_id = p.conv_id AND r.turn = p.turn
"""
