"""Chat formatting: tool calls linked with their results.

Messages are rows (conv_id, turn, role, text). A text that is a JSON object may hold calls,
``{"tool_calls": [{"id", "name", "arguments"}]}``, or a result, ``{"tool_call_id", "content"}``. Calls
and results meet in a hash join by conversation and identifier. Arguments may refer to another call of the
conversation by ``{"$ref": "<id>"}``; calls are ordered topologically, level by level. Arguments are
checked against their tool's schema, and everything is serialised as canonical JSON: sorted keys, no
blanks, no escapes of characters beyond ASCII, numbers as written (1 stays 1 and 1.0 stays 1.0), the
last of repeated keys.

What is no strict JSON is a plain message: NaN and Infinity, numbers beyond a double, lone surrogates, and
texts nested deeper than ``MAX_DEPTH``. Nothing a text holds makes a task fail.

Identifiers are counted before the join (partial aggregates), so the join's right side has one row an
identifier and neither a hot conversation nor a repeated identifier multiplies rows. Plain messages pass it by.
"""

from __future__ import annotations

import json
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import dropped, left_join, written

#: Tools by name, in a subset of JSON Schema: properties' types, required, additionalProperties, items, enum.
SCHEMAS = {"reply": {"type": "object", "properties": {"text": {"type": "string"}, "about": {}}, "required": ["text"], "additionalProperties": False}}
_TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}
#: Deepest nesting that counts as a call or result.
MAX_DEPTH = 100
#: Rounds of the topological order in one job.
ROUNDS = 4
_KEY = ["c", "cn", "call_id"]  # conversation (0 for null), whether it is null, identifier


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _finite(digits: str) -> float:
    if math.isinf(value := float(digits)):
        raise ValueError(digits)
    return value


def _refused(name: str):
    raise ValueError(name)


def parsed(text: str):
    """The value of a strict JSON text, or ValueError."""
    try:
        value = json.loads(text, parse_float=_finite, parse_constant=_refused)
    except RecursionError:
        raise ValueError("too deep") from None
    level = [value]
    for _ in range(MAX_DEPTH):
        level = [v for x in level if isinstance(x, (dict, list)) for v in (x.values() if isinstance(x, dict) else x)]
    if level:
        raise ValueError("too deep")
    canonical(value).encode()  # lone surrogates are a ValueError too
    return value


def _is(value, kind: str) -> bool:
    if kind in ("number", "integer"):
        return isinstance(value, int if kind == "integer" else (int, float)) and not isinstance(value, bool)
    return isinstance(value, _TYPES[kind])


def problems(value, schema: dict) -> list[str]:
    """What is wrong with a value; a reference to another call fits any type."""
    if isinstance(value, dict) and set(value) == {"$ref"}:
        return []
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"not {'/'.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append("not in enum")
    if isinstance(value, dict):
        own = schema.get("properties", {})
        out += [f"{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in own:
                out += [f"{k}: {x}" for x in problems(v, own[k])]
            elif schema.get("additionalProperties") is False:
                out.append(f"{k}: unexpected")
    if isinstance(value, list) and "items" in schema:
        out += [f"{i}: {x}" for i, v in enumerate(value) for x in problems(v, schema["items"])]
    return out


def references(value) -> list[str]:
    if isinstance(value, dict):
        if set(value) == {"$ref"} and isinstance(value["$ref"], str):
            return [value["$ref"]]
        return [r for v in value.values() for r in references(v)]
    return [r for v in value for r in references(v)] if isinstance(value, list) else []


_EVENTS = "conv_id long, turn long, role string, place int, kind string, call_id string, name string, problem string, refs array<string>, json string"


def _event(place: int, kind: str, json_: str, call_id=None, name=None, problem=None, refs=None) -> dict:
    return {"place": place, "kind": kind, "call_id": call_id, "name": name, "problem": problem, "refs": refs or [], "json": json_}


def message_events(role: str | None, text: str | None, schemas: dict) -> list[dict]:
    """The calls, the result, or the plain message that a text is."""
    value = None
    if text and text.lstrip().startswith("{"):
        try:
            value = parsed(text)
        except ValueError:
            pass
    if isinstance(value, dict) and isinstance(value.get("tool_calls"), list) and value["tool_calls"]:
        out = []
        for k, call in enumerate(value["tool_calls"]):
            call = call if isinstance(call, dict) else {}
            arguments, name = call.get("arguments"), call.get("name")
            if isinstance(arguments, str):  # some producers quote them
                try:
                    arguments = parsed(arguments)
                except ValueError:
                    pass
            wrong = problems(arguments, schemas[name]) if isinstance(name, str) and name in schemas else ["unknown tool"]
            call_id = call.get("id") if isinstance(call.get("id"), str) else None
            out.append(_event(k, "call", canonical({"arguments": arguments, "id": call_id, "name": name}), call_id, name if isinstance(name, str) else None, "; ".join(wrong) or None, references(arguments)))
        return out
    if isinstance(value, dict) and isinstance(value.get("tool_call_id"), str):
        return [_event(0, "result", canonical({"content": value.get("content"), "id": value["tool_call_id"]}), value["tool_call_id"])]
    return [_event(0, "message", canonical({"content": text, "role": role}))]


def events(messages: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """One row for every call, result or plain message."""

    def run(batches):
        for batch in batches:
            rows = []
            for c, t, r, x in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text"))):
                rows += [{"conv_id": c, "turn": t, "role": r} | e for e in message_events(r, x, schemas)]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("place", pa.int32()), ("kind", pa.string()), ("call_id", pa.string()), ("name", pa.string()), ("problem", pa.string()), ("refs", pa.list_(pa.string())), ("json", pa.string())]))

    own = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, _EVENTS)


def levels(calls: DataFrame) -> DataFrame:
    """c, cn, call_id, level: 0 without references, else one more than the highest call referred to.

    calls: c, cn, call_id, refs. Calls that share an identifier are one, with the references of all.
    A round settles all calls whose references are settled; ``ROUNDS`` rounds are one job. Calls in
    or behind a cycle, or with a reference to no call, have no level and no row.
    """
    every = calls.filter("call_id is not null")
    edges = written(every.select(*_KEY, F.explode("refs").alias("ref")).distinct(), "references")
    roots = every.select(*_KEY).distinct().join(edges.select(*_KEY).distinct(), _KEY, "left_anti").withColumn("level", F.lit(0))
    if edges.isEmpty():
        return roots
    roots = written(roots, "levels")
    done, n = roots, roots.count()
    while True:
        step = done
        for _ in range(ROUNDS):
            met = edges.join(step.select("c", "cn", F.col("call_id").alias("ref"), F.col("level").alias("of")), ["c", "cn", "ref"], "left")
            new = met.groupBy(*_KEY).agg(F.max("of").alias("of"), F.count(F.when(F.col("of").isNull(), 1)).alias("unmet")).filter("unmet = 0")
            step = roots.unionByName(new.select(*_KEY, (F.col("of") + 1).alias("level")))
        step = written(step, "levels")
        if done is not roots:
            dropped(done)
        done, before = step, n
        n = done.count()
        if n == before:
            return done


def linked(messages: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """Every event with its link: n_calls and n_results of its identifier, status, level and canonical JSON.

    status: ``linked`` (one call, one result or more), ``no result``, ``orphan`` (a result
    without call), ``ambiguous`` (several calls bear the identifier), ``no id``, or ``message``. Order within
    a conversation is (level, turn, place), plain messages and results taking the level 0 or of
    their call; calls without identifier have none. Null conversations are one conversation; empty texts are
    plain messages; repeated rows are events of their own; empty tables give no rows.
    """
    rows = written(events(messages, schemas).withColumns({"c": F.coalesce("conv_id", F.lit(0)), "cn": F.col("conv_id").isNull()}), "events")
    named = rows.filter("call_id is not null")
    ids = named.groupBy(*_KEY).agg(F.count(F.when(F.col("kind") == "call", 1)).alias("n_calls"), F.count(F.when(F.col("kind") == "result", 1)).alias("n_results"))
    ids = written(ids.join(levels(named.filter("kind = 'call'").select(*_KEY, "refs")), _KEY, "left"), "identifiers")
    status = F.when(F.col("n_calls") == 0, "orphan").when(F.col("n_calls") > 1, "ambiguous").when(F.col("n_results") == 0, "no result").otherwise("linked")
    met = left_join(named, ids, _KEY).withColumns({"status": status, "level": F.when(F.col("n_calls") == 0, 0).otherwise(F.col("level"))})
    message = F.col("kind") == "message"
    rest = rows.filter("call_id is null").withColumns({"n_calls": F.lit(0).cast("long"), "n_results": F.lit(0).cast("long"), "status": F.when(message, "message").otherwise("no id"), "level": F.when(message, 0)})
    valid = (F.col("kind") == "call") & F.col("problem").isNull()
    return met.unionByName(rest).select("conv_id", "turn", "role", "place", "kind", "call_id", "n_calls", "n_results", "status", valid.alias("valid"), "problem", "level", "json")


def exchanges(messages: DataFrame) -> DataFrame:
    """Plain conversations in the form of calls: a user's turn calls a tool, the assistant's turn holds a result.

    What calls and results look like follows from the turn alone, so no window over a conversation is
    needed: references to earlier calls, chains, cycles and references to calls that don't exist; identifiers
    used twice; arguments of a wrong type, missing or unexpected; unknown tools; results that come late.
    """
    text, t = F.col("text").cast("string"), F.col("turn").cast("long")

    def said(c: Column) -> Column:
        return c.cast("string")

    quoted = F.to_json(F.struct(text.alias("t")))
    quoted = F.substring(quoted, F.lit(6), F.length(quoted) - 6)
    about = F.when((t < 2) | (t % 16).isin(9, 10), None).when(t % 8 == 6, t + 2).when(t % 8 == 4, t - 4).otherwise(t - 2)
    fields = F.array_compact(F.array(
        F.concat(F.lit('"about":{"$ref":"'), said(about), F.lit('"}')),
        F.concat(F.lit('"text":'), F.when(t % 6 == 4, said(t)).when(t % 6 == 5, None).otherwise(quoted)),
        F.when(t % 7 == 3, F.lit('"tone":"plain"')),
    ))
    call = F.concat(F.lit('{"tool_calls":[{"id":"'), said(F.when(t % 8 == 4, t - 2).otherwise(t)), F.lit('","name":"'), F.when(t % 7 == 6, "lookup").otherwise("reply"), F.lit('","arguments":{'), F.array_join(fields, ","), F.lit("}}]}"))
    result = F.concat(F.lit('{"tool_call_id":"'), said(t - F.when(t % 6 == 3, 3).otherwise(1)), F.lit('","content":'), quoted, F.lit("}"))
    known = text.isNotNull() & t.isNotNull()
    return messages.select("conv_id", "turn", "role", F.when((F.col("role") == "user") & known, call).when((F.col("role") == "assistant") & known, result).otherwise(text).alias("text"))


ORACLE = """
WITH RECURSIVE m AS (SELECT *, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
    CASE role WHEN 'user' THEN CASE WHEN turn % 8 = 4 THEN turn - 2 ELSE turn END WHEN 'assistant' THEN turn - CASE WHEN turn % 6 = 3 THEN 3 ELSE 1 END END AS k,
    CASE WHEN role = 'user' THEN CASE WHEN turn < 2 OR turn % 16 IN (9, 10) THEN NULL WHEN turn % 8 = 6 THEN turn + 2 WHEN turn % 8 = 4 THEN turn - 4 ELSE turn - 2 END END AS ref,
    CASE WHEN turn % 7 = 6 THEN 'lookup' ELSE 'reply' END AS tool FROM conversations),
i AS (SELECT conv_id, k, COUNT(*) FILTER (kind = 'call') AS n_calls, COUNT(*) FILTER (kind = 'result') AS n_results FROM m WHERE k IS NOT NULL GROUP BY ALL),
nodes AS (SELECT DISTINCT conv_id, k FROM m WHERE kind = 'call'),
edges AS (SELECT DISTINCT conv_id, k, ref FROM m WHERE kind = 'call' AND ref IS NOT NULL),
walk AS (SELECT conv_id, k, k AS here, 0 AS depth, [k] AS path, false AS lost FROM nodes
  UNION ALL SELECT w.conv_id, w.k, e.ref, depth + 1, list_append(path, e.ref), list_contains(path, e.ref) OR n.k IS NULL
    FROM walk w JOIN edges e ON e.conv_id = w.conv_id AND e.k = w.here LEFT JOIN nodes n ON n.conv_id = e.conv_id AND n.k = e.ref WHERE NOT lost),
l AS (SELECT conv_id, k, CASE WHEN NOT bool_or(lost) THEN MAX(depth) END AS level FROM walk GROUP BY 1, 2),
p AS (SELECT m.*, CASE WHEN kind <> 'call' THEN NULL WHEN tool = 'lookup' THEN 'unknown tool'
    ELSE nullif(concat_ws('; ', CASE WHEN turn % 6 = 5 THEN 'text: missing' WHEN turn % 6 = 4 THEN 'text: not string' END, CASE WHEN turn % 7 = 3 THEN 'tone: unexpected' END), '') END AS problem FROM m)
SELECT p.conv_id, p.turn, p.role, 0 AS place, p.kind, p.k::VARCHAR AS call_id, COALESCE(n_calls, 0) AS n_calls, COALESCE(n_results, 0) AS n_results,
  CASE WHEN p.kind = 'message' THEN 'message' WHEN n_calls = 0 THEN 'orphan' WHEN n_calls > 1 THEN 'ambiguous' WHEN n_results = 0 THEN 'no result' ELSE 'linked' END AS status,
  p.kind = 'call' AND problem IS NULL AS valid, problem, CASE WHEN p.kind = 'message' OR n_calls = 0 THEN 0 ELSE l.level END AS level,
  CASE p.kind WHEN 'call' THEN '{"arguments":{' || concat_ws(',', '"about":{"$ref":"' || ref || '"}', '"text":' || CASE WHEN turn % 6 = 4 THEN turn::VARCHAR WHEN turn % 6 = 5 THEN NULL ELSE to_json(text)::VARCHAR END, CASE WHEN turn % 7 = 3 THEN '"tone":"plain"' END) || '},"id":"' || p.k || '","name":"' || tool || '"}'
    WHEN 'result' THEN '{"content":' || to_json(text) || ',"id":"' || p.k || '"}'
    ELSE '{"content":' || to_json(text) || ',"role":' || to_json(role) || '}' END AS json
FROM p LEFT JOIN i ON p.conv_id = i.conv_id AND p.k = i.k LEFT JOIN l ON p.conv_id = l.conv_id AND p.k = l.k
"""
