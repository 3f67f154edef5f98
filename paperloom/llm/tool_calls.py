"""Chat formatting: tool calls linked with their results.

Calls and results meet in a hash join on (conversation, identifier). Calls are
put in an order that respects their dependencies, arguments are validated
against the tools' schemas, and each call becomes one line of canonical JSON
(sorted keys, no spaces, UTF-8). Rows are calls, so a conversation of any length
is spread over tasks; calls with forward references are ordered by peeling those
without open dependencies, a block of turns in each task, until none is left.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import checkpointed

#: Turns of a conversation whose calls one task orders at a time: in the first round, how many times more in each round after it, and at most.
BLOCK_TURNS, GROWTH, WIDEST = 4096, 16, 1 << 18

TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}
LONE = re.compile("[\ud800-\udfff]")


def canonical(value) -> str:
    """JSON with sorted keys and no spaces; lone surrogates, which UTF-8 lacks, as escapes."""
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def _number(text: str) -> float:
    value = float(text)
    if value - value != 0:
        raise ValueError("out of range")
    return value


def parsed(text: str):
    """The value of a JSON text; ValueError for what is no JSON (also NaN, Infinity, and numbers beyond doubles) or nested too deeply to read."""

    def refuse(name):
        raise ValueError(name)

    try:
        return json.loads(text, parse_constant=refuse, parse_float=_number)
    except RecursionError as deep:
        raise ValueError("nested too deeply") from deep


def same(a, b) -> bool:
    """Whether two JSON values are equal; true is not 1."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    return a == b


def problems(value, schema: dict, where: str = "$") -> list[str]:
    """What of a value breaks a JSON schema (type, required, properties, additionalProperties, items, enum, minLength, minimum, maximum)."""
    found = []
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(isinstance(value, TYPES[k]) and not (isinstance(value, bool) and k in ("integer", "number")) for k in kinds):
        return [f"{where}: not {' or '.join(kinds)}"]
    if "enum" in schema and not any(same(value, v) for v in schema["enum"]):
        found.append(f"{where}: not in enum")
    if isinstance(value, str) and len(value) < schema.get("minLength", 0):
        found.append(f"{where}: too short")
    if isinstance(value, (int, float)) and not isinstance(value, bool) and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        found.append(f"{where}: out of range")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{where}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                found += problems(value[k], known[k], f"{where}.{k}")
            elif schema.get("additionalProperties") is False:
                found.append(f"{where}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        found += [p for n, v in enumerate(value) for p in problems(v, schema["items"], f"{where}[{n}]")]
    return found


def extract_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of messages (conv_id, turn, role, text) whose text is JSON.

    A call is an element of an assistant's `{"tool_calls": [{"id", "name",
    "arguments", "depends_on"}]}`; a result is `{"tool_call_id", "content"}`.
    Other texts are plain messages and give nothing.
    """
    body = messages.filter(F.ltrim("text").startswith("{"))
    shape = "struct<tool_calls:array<struct<id:string,name:string,arguments:string,depends_on:array<string>>>,tool_call_id:string,content:string>"
    parsed = body.select("conv_id", "turn", "role", F.from_json("text", shape).alias("m"))
    calls = parsed.filter("role = 'assistant'").select("conv_id", "turn", F.posexplode("m.tool_calls").alias("k", "c"))
    calls = calls.filter("c.id is not null").select("conv_id", F.col("c.id").alias("call_id"), F.struct("turn", "k").alias("position"), "c.name", "c.arguments", F.coalesce("c.depends_on", F.array().cast("array<string>")).alias("depends_on"))
    results = parsed.filter("m.tool_call_id is not null").select("conv_id", F.col("m.tool_call_id").alias("call_id"), F.struct("turn", F.lit(0).alias("k")).alias("position"), F.col("m.content").alias("content"))
    return calls, results


def calls_of_turns(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain conversations as calls: each user turn asks for a reply, the next turn, if an assistant's, is its result.

    Of a user turn and the one two turns on, the shorter waits for the longer: a
    call depends on the next user turn if that is longer, else that one on it.
    So about half of the references point forwards. A null text has no length;
    of repeated turns the longest text counts.
    """
    known = messages.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    name = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    position = F.struct("turn", F.lit(0).alias("k")).alias("position")
    users = known.filter("role = 'user'")
    turns = users.groupBy("conv_id", "turn").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("n"))
    pairs = turns.join(turns.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("n").alias("next")), ["conv_id", "turn"])
    waits = F.col("n") < F.col("next")
    needs = pairs.select("conv_id", F.when(waits, F.col("turn")).otherwise(F.col("turn") + 2).alias("turn"), name(F.when(waits, F.col("turn") + 2).otherwise(F.col("turn"))).alias("dep"))
    needs = needs.groupBy("conv_id", "turn").agg(F.collect_set("dep").alias("depends_on"))
    calls = users.join(needs, ["conv_id", "turn"], "left").select("conv_id", name(F.col("turn")).alias("call_id"), position, F.lit("reply").alias("name"), F.to_json(F.struct("text", "turn"), {"ignoreNullFields": "false"}).alias("arguments"), F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"))
    results = known.filter("role = 'assistant'").select("conv_id", name(F.col("turn") - 1).alias("call_id"), position, F.col("text").alias("content"))
    return calls, results


#: Schemas of the tools in plain conversations.
REPLY_SCHEMAS = {"reply": {"type": "object", "required": ["text", "turn"], "additionalProperties": False, "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}}}


def peeled(block: list[dict]) -> list[dict]:
    """The open calls of one block after peeling: a call's key is settled when none of its dependencies is open.

    Columns: conv_id, block, call_id, turn, k, best (the greatest key that a
    settled dependency asks for), deps (open ones), done.
    """
    rows = {r["call_id"]: r for r in block}
    low = -(1 << 63)
    waiting, dependents = {}, {}
    for name, r in rows.items():
        r["best"] = max(((r["turn"] if r["turn"] is not None else low, r["k"] or 0), 0), tuple_of(r["best"]))
        r["deps"] = set(r["deps"])
        waiting[name] = len(r["deps"])
        for d in r["deps"]:
            dependents.setdefault(d, []).append(name)
    ready = [name for name, n in waiting.items() if not n]
    while ready:
        name = ready.pop()
        (after, hop), rows[name]["done"] = rows[name]["best"], True
        for other in dependents.get(name, ()):
            rows[other]["best"] = max(rows[other]["best"], (after, hop + 1))
            rows[other]["deps"].discard(name)
            waiting[other] -= 1
            if not waiting[other]:
                ready.append(other)
    out = []
    for r in rows.values():
        (turn, k), hop = r["best"]
        out.append(r | {"best": {"turn": None if turn == low else turn, "k": k, "hop": hop}, "deps": sorted(r["deps"])})
    return out


def peel_blocks(open_calls: DataFrame, schema: str) -> DataFrame:
    """`peeled` over every (conv_id, block); a task holds one block at a time."""
    form = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches) -> Iterator[pa.RecordBatch]:
        block, key, out = [], None, []
        for batch in batches:
            for row in batch.to_pylist():
                if block and (row["conv_id"], row["block"]) != key:
                    out += peeled(block)
                    block = []
                key = row["conv_id"], row["block"]
                block.append(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=form)
                out = []
        if block:
            yield pa.RecordBatch.from_pylist(peeled(block), schema=form)

    return open_calls.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block").mapInArrow(run, schema)


def tuple_of(key: dict | None) -> tuple:
    """A key as ((turn, k), hop); null is before all others."""
    low = -(1 << 63)
    return ((low, 0), -1) if key is None else ((low if key["turn"] is None else key["turn"], key["k"]), key["hop"])


def ordered(calls: DataFrame) -> DataFrame:
    """`calls` with an order key (`after`, `hop`) and `cyclic`: within a conversation, sorting by it puts each call behind those it depends on.

    A call's key is its own position, or the key of a dependency that comes
    later, one hop on. Dependencies on unknown calls are passed over. Only
    conversations with a forward reference need more than their positions: there
    the calls without open dependencies are peeled off, block by block within
    tasks, and the settled keys go to other blocks between rounds, until nothing
    moves. What is left lies on a cycle or behind one: `cyclic`, with its own
    position as key. Blocks grow from round to round, as fewer calls are open,
    so a chain that goes to and fro soon lies within one block; only beyond the
    widest block are there as many rounds as a chain changes blocks.
    """
    keys = calls.groupBy("conv_id", "call_id").agg(F.min("position").alias("after"))
    edges = calls.select("conv_id", "call_id", F.explode("depends_on").alias("dep")).distinct()
    edges = edges.join(keys.select("conv_id", F.col("call_id").alias("dep"), F.col("after").alias("dep_after")), ["conv_id", "dep"]).join(keys, ["conv_id", "call_id"])
    forward = checkpointed(edges.filter("dep_after >= after").select("conv_id").distinct())
    own = keys.select("conv_id", "call_id", "after", F.lit(0).cast("bigint").alias("hop"), F.lit(False).alias("cyclic"))
    if forward.isEmpty():
        return calls.join(own, ["conv_id", "call_id"])
    plain = own.join(forward, "conv_id", "left_anti")
    needs = edges.join(forward, "conv_id", "left_semi").groupBy("conv_id", "call_id").agg(F.collect_set("dep").alias("deps"))
    rows = keys.join(forward, "conv_id", "left_semi").join(needs, ["conv_id", "call_id"], "left")
    key = "struct<turn:bigint,k:bigint,hop:bigint>"
    turn = F.col("after.turn").cast("bigint")
    left = rows.select(
        "conv_id", F.floor(turn / BLOCK_TURNS).alias("block"), "call_id", turn.alias("turn"), F.col("after.k").cast("bigint").alias("k"),
        F.lit(None).cast(key).alias("best"), F.coalesce("deps", F.array().cast("array<string>")).alias("deps"), F.lit(False).alias("done"),
    )
    schema = f"conv_id {left.schema['conv_id'].dataType.simpleString()}, block bigint, call_id string, turn bigint, k bigint, best {key}, deps array<string>, done boolean"
    settled, width = [], BLOCK_TURNS
    while True:
        peel = checkpointed(peel_blocks(left, schema))
        done, left = peel.filter("done"), peel.filter(~F.col("done"))
        settled.append(done)
        if done.isEmpty() or left.isEmpty():
            break
        # what was settled in this round, for those that wait for it in other blocks
        given = done.select("conv_id", F.col("call_id").alias("dep"), F.struct("best.turn", "best.k", (F.col("best.hop") + 1).alias("hop")).alias("given"))
        met = left.select("conv_id", "call_id", F.explode("deps").alias("dep")).join(given, ["conv_id", "dep"], "left")
        met = met.groupBy("conv_id", "call_id").agg(F.max("given").alias("given"), F.collect_set(F.when(F.col("given").isNull(), F.col("dep"))).alias("open"))
        width = max(width, min(width * GROWTH, WIDEST))
        left = left.join(met, ["conv_id", "call_id"]).select("conv_id", F.floor(F.col("turn") / width).alias("block"), "call_id", "turn", "k", F.greatest("best", "given").alias("best"), F.col("open").alias("deps"), "done")
    position = lambda turn, k: F.struct(F.col(turn).alias("turn"), F.col(k).alias("k")).alias("after")
    found = reduce(DataFrame.unionByName, settled).select("conv_id", "call_id", position("best.turn", "best.k"), F.col("best.hop").alias("hop"), F.lit(False).alias("cyclic"))
    rest = left.select("conv_id", "call_id", position("turn", "k"), F.lit(0).cast("bigint").alias("hop"), F.lit(True).alias("cyclic"))
    plain = plain.select("conv_id", "call_id", F.struct(F.col("after.turn").cast("bigint").alias("turn"), F.col("after.k").cast("bigint").alias("k")).alias("after"), "hop", "cyclic")
    return calls.join(plain.unionByName(found).unionByName(rest), ["conv_id", "call_id"])


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call, and one per result without a call.

    Columns: conv_id, call_id, status (linked, pending, orphan), after_turn,
    after_k, hop, cyclic, valid, problems, line (canonical JSON). Of results
    with one identifier the first by position and content counts; repeated
    calls give repeated rows with the same result. Calls without a schema,
    with arguments that are no JSON (NaN, numbers beyond doubles and nesting too
    deep to read included), or null are not valid; arguments that are no JSON
    stand in the line as a string, and null contents as null. Calls and results
    without conversation or identifier are passed over. `schemas` is a few
    tools' schemas, sent with the task. Texts of any length are taken whole;
    further columns are not read. Empty tables give no rows.
    """
    first = results.groupBy("conv_id", "call_id").agg(F.min(F.struct("position", "content")).alias("r"))
    known = calls.select("conv_id", "call_id").distinct()
    linked = ordered(calls).join(first, ["conv_id", "call_id"], "left")
    status = F.when(F.col("r").isNotNull(), "linked").otherwise("pending")
    rows = linked.select("conv_id", "call_id", status.alias("status"), F.col("after.turn").cast("bigint").alias("after_turn"), F.col("after.k").cast("bigint").alias("after_k"), F.col("hop").cast("bigint").alias("hop"), "cyclic", "name", "arguments", "r.content")
    orphans = first.join(known, ["conv_id", "call_id"], "left_anti")
    orphans = orphans.select("conv_id", "call_id", F.lit("orphan").alias("status"), F.col("r.position.turn").cast("bigint").alias("after_turn"), F.col("r.position.k").cast("bigint").alias("after_k"), F.lit(0).cast("bigint").alias("hop"), F.lit(False).alias("cyclic"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"), "r.content")
    both = rows.unionByName(orphans)
    names = both.columns

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(names, batch.columns, strict=True))
            valid, why, lines = [], [], []
            for row in zip(*(columns[c].to_pylist() for c in ("conv_id", "call_id", "status", "name", "arguments", "content")), strict=True):
                conv, call, status, name, arguments, content = row
                found, entry = [], {"conversation": conv, "id": call, "name": name, "result": content, "status": status}
                try:
                    value = parsed(arguments) if arguments is not None else None
                    found = ["no call"] if status == "orphan" else problems(value, schemas[name]) if name in schemas else ["no schema"]
                    line = canonical(entry | {"arguments": value, "valid": not found})
                except (ValueError, RecursionError):
                    found = ["$: not JSON"]
                    line = canonical(entry | {"arguments": arguments, "valid": False})
                valid.append(not found)
                why.append(LONE.sub("\ufffd", "; ".join(found)))
                lines.append(line)
            kept = [columns[c] for c in names[:7]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(valid, pa.bool_()), pa.array(why, pa.string()), pa.array(lines, pa.string())], names=[*names[:7], "valid", "problems", "line"])

    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in both.schema[:7])
    return both.mapInArrow(run, f"{head}, valid boolean, problems string, line string")
