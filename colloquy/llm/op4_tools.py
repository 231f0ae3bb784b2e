"""Tool-call linking: join calls and results by identifier, order calls, check arguments, write canonical JSON.

    calls    conv_id, call_id, seq, name, arguments (JSON text), needs (identifiers of earlier calls)
    results  conv_id, call_id, seq, content

Linking is a hash join on (conv_id, call_id) of one row each: where an identifier is repeated, its first
call meets its first result and all others are `duplicate`. A call's level is the longest chain of linked
calls that it needs: conversations up to WHOLE edges are levelled in packed groups (Kahn), larger ones by
joins that contract chains by pointer doubling, so a conversation of any size is never one task's. Calls
in a cycle, or behind one, have no level. Arguments are checked against the tool's JSON schema. JSON is
canonical: sorted keys, no spaces, characters as they are.

Null conv_id or call_id: never linked. Null, broken or non-object arguments: invalid, written as null; so are
those with NaN, infinite numbers or lone surrogates, which JSON in UTF-8 can't hold, and those nested beyond what
the parser takes (tens of thousands of levels).
Null text: the empty string. Needs that name no call, or the call itself: not counted. Repeated rows: a row
each. Empty tables: empty results. Other columns are not read. Texts are whole.
"""

from __future__ import annotations

import json
import re
from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from colloquy.llm.common import Staging, read_table, slices, tune

#: Edges of a task's group; edges from which a conversation is levelled by joins; a need that waits for nothing.
GROUP, WHOLE, TOP = 50_000, 500_000, "\x00"
_TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}


def canonical(value) -> str:
    """Raises ValueError for what JSON can't hold."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _never(constant: str):
    raise ValueError(f"{constant} is not JSON")


def _is(value, kind: str) -> bool:
    if kind in ("integer", "number"):
        return not isinstance(value, bool) and (isinstance(value, int) or isinstance(value, float) and (kind == "number" or value.is_integer()))
    return isinstance(value, _TYPES[kind])


def problems(value, schema: dict, at: str = "") -> list[str]:
    """Where a value breaks a JSON schema: type, enum, const, required, properties, additionalProperties,
    items, minItems, maxItems, minLength, maxLength, pattern, minimum, maximum."""
    kinds = schema.get("type")
    if kinds and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at or '.'}: type"]
    out = []
    if "enum" in schema and value not in schema["enum"] or "const" in schema and value != schema["const"]:
        out.append(f"{at or '.'}: enum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: required" for k in schema.get("required", []) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{at}.{k}: unknown" for k in sorted(value) if k not in known]
        for k in sorted(value):
            if k in known:
                out += problems(value[k], known[k], f"{at}.{k}")
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
            out.append(f"{at or '.'}: items")
        for i, v in enumerate(value):
            out += problems(v, schema.get("items", {}), f"{at}[{i}]")
    if isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
            out.append(f"{at or '.'}: length")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{at or '.'}: pattern")
    if _is(value, "number") and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        out.append(f"{at or '.'}: range")
    return out


def link(calls: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls with `status` (linked, open, duplicate, unnamed), results with `status` (linked, orphan, duplicate, unnamed)."""
    def firsts(df: DataFrame, name: str) -> DataFrame:
        named = df.where("conv_id IS NOT NULL AND call_id IS NOT NULL")
        return named.groupBy("conv_id", "call_id").agg(F.min("seq").alias(name))

    pairs = firsts(calls, "called").join(firsts(results, "answered"), ["conv_id", "call_id"], "full")

    def marked(df: DataFrame, own: str, other: str, alone: str) -> DataFrame:
        # the row's own place is part of the key: an identifier with very many rows is dealt out
        key = pairs.where(F.col(own).isNotNull()).select("conv_id", "call_id", F.col(own).alias("seq"), F.when(F.col(other).isNull(), alone).otherwise("linked").alias("status"))
        named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
        return df.join(key, ["conv_id", "call_id", "seq"], "left").withColumn("status", F.coalesce("status", F.when(named, "duplicate").otherwise("unnamed")))

    return marked(calls, "called", "answered", "open"), marked(results, "answered", "called", "orphan")


def _kahn(pdf: pd.DataFrame) -> pd.DataFrame:
    """Levels of whole conversations: conv_id, need (null: the call stands for itself) and call_id."""
    out = []
    for conv, own in pdf.groupby("conv_id", sort=False):
        codes, names = pd.factorize(np.concatenate((own["call_id"].to_numpy(), own["need"].to_numpy())))
        call, need = codes[: len(own)], codes[len(own) :]
        edge = need >= 0
        pairs = np.unique(np.stack((need[edge], call[edge])), axis=1)
        ends = np.searchsorted(pairs[0], np.arange(len(names) + 1)).tolist()
        after, waits = pairs[1].tolist(), np.bincount(pairs[1], minlength=len(names)).tolist()
        level = [0] * len(names)
        ready = deque(i for i, n in enumerate(waits) if not n)
        while ready:
            a = ready.popleft()
            for b in after[ends[a] : ends[a + 1]]:
                waits[b] -= 1
                level[b] = max(level[b], level[a] + 1)
                if not waits[b]:
                    ready.append(b)
        done = np.flatnonzero(np.array(waits) == 0)
        out.append(pd.DataFrame({"conv_id": conv, "call_id": names[done], "level": np.array(level, np.int32)[done]}))
    return pd.concat(out)


def _contracted(edges: DataFrame, staging: Staging) -> DataFrame:
    """Levels of the calls with a need, by contraction: a call that waits for one other only hangs on it, chains
    of such calls are followed by pointer doubling (rounds: the logarithm of a chain's length), and the calls
    that wait for several keep the longest way to each of what is left. Rounds of this follow how
    often chains branch and meet one after another. What stays at the end waits for a cycle."""
    key, top = ["conv_id", "call_id"], F.lit(TOP)
    waiting = edges.select("conv_id", F.col("call_id").alias("need"), F.lit(True).alias("waits")).distinct()
    start = edges.join(waiting, ["conv_id", "need"], "left")
    state = staging.write(start.select("conv_id", F.when(F.col("waits"), F.col("need")).otherwise(top).alias("need"), "call_id", F.lit(1).cast("long").alias("w")).groupBy("conv_id", "need", "call_id").agg(F.max("w").alias("w")), "ways-0")
    turn, hung = 0, []
    while True:
        many = state.groupBy(*key).agg(F.count("*").alias("k"))
        single = state.join(many.where("k = 1").select(*key), key, "left_semi")
        at = staging.write(single.select("conv_id", "call_id", F.col("need").alias("to"), F.col("w").alias("d")), f"hang-{turn}-0")
        if at.isEmpty():
            break
        # after that many doublings a pointer that still moves goes round a cycle
        for double in range(1, at.count().bit_length() + 2):
            on = at.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("d").alias("more"))
            moved = at.select("conv_id", "call_id", "to", "d").join(on, ["conv_id", "to"], "left")
            at = staging.write(moved.select("conv_id", "call_id", F.coalesce("next", "to").alias("to"), (F.col("d") + F.coalesce("more", F.lit(0))).alias("d"), F.col("next").isNotNull().alias("moved")), f"hang-{turn}-{double}")
            staging.drop(f"hang-{turn}-{double - 1}")
            if at.where("moved").isEmpty():
                break
        at = at.where("NOT moved").drop("moved")
        hung.append(at)
        ends = at.select("conv_id", F.col("call_id").alias("need"), "to", "d")
        rest = state.join(many.where("k > 1").select(*key), key, "left_semi").join(ends, ["conv_id", "need"], "left")
        ways = rest.select("conv_id", F.coalesce("to", "need").alias("need"), "call_id", (F.col("w") + F.coalesce("d", F.lit(0))).alias("w"))
        turn += 1
        state = staging.write(ways.groupBy("conv_id", "need", "call_id").agg(F.max("w").alias("w")), f"ways-{turn}")
        staging.drop(f"ways-{turn - 1}")
    out = None
    for i, at in reversed([*enumerate(hung)]):
        own = at.where(F.col("to") == top).select("conv_id", "call_id", F.col("d").cast("int").alias("level"))
        if out is not None:
            above = out.withColumnsRenamed({"call_id": "to", "level": "up"})
            own = own.unionByName(at.join(above, ["conv_id", "to"]).select("conv_id", "call_id", (F.col("d") + F.col("up")).cast("int").alias("level"))).unionByName(out)
        out = staging.write(own, f"levels-{i}")
    return out if out is not None else edges.select("conv_id", "call_id", F.lit(0).alias("level")).limit(0)


def levels(calls: DataFrame, staging: Staging) -> DataFrame:
    """conv_id, call_id and level of each identifier (of its linked or open rows; rows that tie share the
    needs of all); none for calls in or behind a cycle."""
    nodes = staging.write(calls.where("status IN ('linked', 'open')").groupBy("conv_id", "call_id").agg(F.flatten(F.collect_set("needs")).alias("needs")), "nodes")
    keys = nodes.select("conv_id", F.col("call_id").alias("need")).distinct()
    edges = nodes.select("conv_id", "call_id", F.explode("needs").alias("need")).where("need <> call_id").distinct().join(keys, ["conv_id", "need"])
    edges = staging.write(edges.select("conv_id", "need", "call_id"), "edges")
    size = edges.groupBy("conv_id").agg(F.count("*").alias("n"))
    big = staging.write(size.where(F.col("n") > WHOLE).select("conv_id"), "big")
    groups = 1 + edges.count() // max(1, GROUP)
    small = edges.join(big, "conv_id", "left_anti").withColumn("group", F.pmod(F.xxhash64("conv_id"), F.lit(groups)))
    schema = "conv_id long, call_id string, level int"
    done = small.groupBy("group").applyInPandas(lambda pdf: _kahn(pdf), schema)
    free = nodes.join(edges.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti").select("conv_id", "call_id", F.lit(0).alias("level"))
    out = done.where("level > 0").unionByName(free)
    return out if big.isEmpty() else out.unionByName(_contracted(edges.join(big, "conv_id", "left_semi"), staging))


def checked(calls: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Calls with `valid`, `faults` and `arguments_json` (canonical, null where the text isn't an object)."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, "arguments"):
                valid, faults, text = [], [], []
                for name, said in zip(part.column("name").to_pylist(), part.column("arguments").to_pylist()):
                    written = None
                    try:
                        value = json.loads(said or "", parse_constant=_never)
                        if isinstance(value, dict):
                            found = problems(value, schemas[name]) if name in schemas else [".: no such tool"]
                            written = canonical(value)
                            written.encode()
                        else:
                            found = [".: not an object"]
                    except (ValueError, RecursionError):
                        found, written = [".: not an object"], None
                    valid.append(not found)
                    faults.append("; ".join(found))
                    text.append(written)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(valid, pa.bool_()), pa.array(faults, pa.string()), pa.array(text, pa.string())], [*part.schema.names, "valid", "faults", "arguments_json"])

    more = [T.StructField("valid", T.BooleanType()), T.StructField("faults", T.StringType()), T.StructField("arguments_json", T.StringType())]
    return calls.mapInArrow(run, T.StructType([*calls.schema.fields, *more]))


#: A user turn of `conversations` is a call of this tool; the assistant turn right after it is its result.
REPLY = {
    "type": "object",
    "required": ["prompt", "turn"],
    "properties": {"prompt": {"type": "string", "minLength": 1, "pattern": r"\S"}, "turn": {"type": "integer", "minimum": 0}},
    "additionalProperties": False,
}


def messages(turns: DataFrame, staging: Staging) -> DataFrame:
    """One row a turn: conv_id, turn, role, status, level, valid and its canonical JSON.

    A user turn calls `reply` with its text; an assistant turn answers the turn before it, and any other
    turn is a plain message. A call needs the call two turns before, whose answer it continues.
    """
    rows = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    name = lambda t: F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), t.cast("string"))
    users, answers = rows.where("role = 'user'"), rows.where("role = 'assistant'")
    calls = users.select("conv_id", name(F.col("turn")).alias("call_id"), F.col("turn").alias("seq"), "text", F.lit("reply").alias("name"), F.to_json(F.struct(F.col("text").alias("prompt"), "turn")).alias("arguments"), F.array(name(F.col("turn") - 2)).alias("needs"))
    results = answers.select("conv_id", name(F.col("turn") - 1).alias("call_id"), F.col("turn").alias("seq"), F.col("text").alias("content"))
    calls, results = link(calls, results)
    ranked = levels(calls, staging)
    first = F.col("status").isin("linked", "open")
    calls = checked(calls.join(ranked, ["conv_id", "call_id"], "left").withColumn("level", F.when(first, F.col("level"))), {"reply": REPLY})
    said = calls.select("conv_id", F.col("seq").alias("turn"), F.lit("user").alias("role"), "status", "level", "valid", "call_id", "arguments_json", F.col("text").alias("content"))
    said = said.unionByName(results.select("conv_id", F.col("seq").alias("turn"), F.lit("assistant").alias("role"), "status", F.lit(None).cast("int").alias("level"), F.lit(None).cast("boolean").alias("valid"), "call_id", F.lit(None).cast("string").alias("arguments_json"), "content"))
    others = rows.where("role IS NULL OR role NOT IN ('user', 'assistant')")
    said = said.unionByName(others.select("conv_id", "turn", "role", F.lit("message").alias("status"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("boolean").alias("valid"), F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("string").alias("arguments_json"), F.col("text").alias("content")))

    def write(batches):
        for batch in batches:
            for part in slices(batch, "content"):
                out = []
                for r in part.to_pylist():
                    if r["role"] == "user":
                        body = {"role": "assistant", "tool_calls": [{"id": r["call_id"], "name": "reply", "arguments": None if r["arguments_json"] is None else json.loads(r["arguments_json"])}]}
                    elif r["role"] == "assistant":
                        body = {"role": "tool", "tool_call_id": r["call_id"], "content": r["content"]}
                    else:
                        body = {"role": r["role"], "content": r["content"]}
                    out.append(canonical(body))
                kept = [part.column(n) for n in ("conv_id", "turn", "role", "status", "level", "valid")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.string())], ["conv_id", "turn", "role", "status", "level", "valid", "json"])

    return said.mapInArrow(write, "conv_id long, turn long, role string, status string, level int, valid boolean, json string")


def op4_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return messages(read_table(spark, sf_dir, "conversations"), Staging(spark, "tools"))


#: The same rows by windows; levels are places in runs of user turns two apart.
OP4_SQL = r"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
u AS (SELECT conv_id, turn, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island FROM t WHERE role = 'user'),
lv AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn % 2, island ORDER BY turn) - 1 AS level FROM u)
SELECT t.conv_id, t.turn, t.role,
       CASE WHEN t.role = 'user' THEN CASE WHEN a.turn IS NULL THEN 'open' ELSE 'linked' END
            WHEN t.role = 'assistant' THEN CASE WHEN p.turn IS NULL THEN 'orphan' ELSE 'linked' END ELSE 'message' END AS status,
       lv.level::INTEGER AS level,
       CASE WHEN t.role = 'user' THEN regexp_matches(t.text, '\S') END AS valid,
       CASE WHEN t.role = 'user' THEN '{"role":"assistant","tool_calls":[{"arguments":{"prompt":' || to_json(t.text)::VARCHAR || ',"turn":' || t.turn || '},"id":"call_' || t.conv_id || '_' || t.turn || '","name":"reply"}]}'
            WHEN t.role = 'assistant' THEN '{"content":' || to_json(t.text)::VARCHAR || ',"role":"tool","tool_call_id":"call_' || t.conv_id || '_' || (t.turn - 1) || '"}'
            ELSE '{"content":' || to_json(t.text)::VARCHAR || ',"role":' || to_json(t.role)::VARCHAR || '}' END AS json
FROM t LEFT JOIN t a ON a.conv_id = t.conv_id AND a.turn = t.turn + 1 AND a.role = 'assistant'
LEFT JOIN t p ON p.conv_id = t.conv_id AND p.turn = t.turn - 1 AND p.role = 'user'
LEFT JOIN lv ON lv.conv_id = t.conv_id AND lv.turn = t.turn AND t.role = 'user'
"""
