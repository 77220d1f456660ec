"""Chat formatting with tool-call linking.

Messages are parsed into events: plain messages, tool calls (identifier, name, arguments) and tool results (identifier of
their call). Results meet their calls in a hash join on conversation and identifier. Events are put in topological order:
an event comes after every call or result that it names, otherwise by turn. Arguments are checked against schemas, and
each event becomes one line of canonical JSON (sorted keys, no spaces). A conversation is never gathered in one row or
task: its lines are numbered by counts per stretch of turns.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.session import stage

#: Turns whose events are ordered in one task, when they are not split further by their content.
STRETCH = 256
SPLITS = 16

EVENTS = "conv_id long, turn long, role string, part long, kind string, call_id string, name string, arguments string, content string, needs array<string>"


def clean(text: str) -> str:
    """Lone surrogates, which JSON escapes can spell and UTF-8 cannot, become question marks."""
    return text.encode("utf-8", "replace").decode("utf-8")


def canonical(value) -> str:
    """JSON with sorted keys and no spaces; ValueError for numbers that JSON does not have."""
    return clean(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _plain(value) -> str:
    """A string as it is, anything else as JSON, what JSON cannot say as null."""
    try:
        return clean(value) if isinstance(value, str) else canonical(value)
    except (ValueError, RecursionError):
        return "null"


def _loads(text: str):
    """JSON object of a text that looks like one, or None."""
    if not text.lstrip().startswith("{"):
        return None
    try:
        found = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def _references(value) -> list[str]:
    """Identifiers that arguments name as {"$ref": id}, without recursion."""
    out, stack = [], [value]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            if isinstance(x.get("$ref"), str):
                out.append(clean(x["$ref"]))
            stack.extend(x.values())
        elif isinstance(x, list):
            stack.extend(x)
    return sorted(set(out))


def events(role: str | None, text: str | None) -> list[tuple]:
    """(kind, call_id, name, arguments, content, needs) of one message.

    Identifiers, names and contents that are no strings are taken as JSON. Arguments with numbers that JSON does not have (NaN, infinity) are null, which no
    schema of an object accepts; such contents are null too.
    """
    text = text or ""
    found = _loads(text)
    if found and isinstance(found.get("tool_calls"), list):
        out = []
        if found.get("content"):
            out.append(("message", None, None, None, _plain(found["content"]), []))
        for call in found["tool_calls"]:
            call = call if isinstance(call, dict) else {}
            arguments = call.get("arguments")
            if isinstance(arguments, str):
                arguments = _loads(arguments)
            ident = call.get("id")
            try:
                line = canonical(arguments)
            except (ValueError, RecursionError):
                line = "null"
            needs = [] if line == "null" else _references(arguments)
            out.append(("call", None if ident is None else _plain(ident), _plain(call.get("name") or ""), line, None, needs))
        return out or [("message", None, None, None, "", [])]
    if found and "tool_call_id" in found:
        ident = _plain(found["tool_call_id"])
        return [("result", ident, None, None, _plain(found.get("content")), [ident])]
    return [("message", None, None, None, text, [])]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "turn", "role", "part", "kind", "call_id", "name", "arguments", "content", "needs"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), *[pa.string()] * 5, pa.list_(pa.string())]
    for batch in batches:
        rows = []
        for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows += [(conv, turn, role, i, *e) for i, e in enumerate(events(role, text))]
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def parse(messages: DataFrame) -> DataFrame:
    """Events of ``messages(conv_id, turn, role, text)``; null turns count as turn 0, null texts as empty messages."""
    rows = messages.select(F.col("conv_id").cast("long"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), "role", "text")
    return rows.mapInArrow(_parse, EVENTS)


def exchanges(messages: DataFrame) -> DataFrame:
    """The same for chats without tools: a user's turn is a call of ``reply`` named by its turn, the assistant's next
    turn is its result; other messages, and those that hold tool JSON, are parsed as usual."""
    parsed = parse(messages)
    plain = F.col("kind") == "message"
    asks, answers = plain & (F.col("role") == "user"), plain & (F.col("role") == "assistant")
    ident = F.when(asks, F.concat(F.lit("turn-"), F.col("turn"))).when(answers, F.concat(F.lit("turn-"), F.col("turn") - 1))
    return parsed.select(
        "conv_id", "turn", "role", "part",
        F.when(asks, "call").when(answers, "result").otherwise(F.col("kind")).alias("kind"),
        F.coalesce(ident, "call_id").alias("call_id"),
        F.when(asks, "reply").otherwise(F.col("name")).alias("name"),
        F.when(asks, F.to_json(F.struct(F.col("content").alias("text")))).otherwise(F.col("arguments")).alias("arguments"),
        F.when(~asks | asks.isNull(), F.col("content")).alias("content"),
        F.when(answers, F.array(ident)).otherwise(F.col("needs")).alias("needs"),
    )


def schema_faults(value, schema: dict, at: str = "$") -> list[str]:
    """Faults of a value under the subset type, enum, required, properties, additionalProperties, items."""
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "integer": int, "number": (int, float)}
    kind = schema.get("type")
    if kind and (not isinstance(value, kinds[kind]) or isinstance(value, bool) and kind in ("integer", "number")):
        return [f"{at}: not of type {kind}"]
    out = [f"{at}: not allowed"] if "enum" in schema and value not in schema["enum"] else []
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in known:
                out += schema_faults(v, known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
    elif isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += schema_faults(v, schema["items"], f"{at}[{i}]")
    return out


def _lines(batches: Iterator[pa.RecordBatch], schemas: dict) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        valid, lines = [], []
        for kind, role, ident, name, arguments, content, state in zip(*(batch.column(c).to_pylist() for c in ("kind", "role", "call_id", "name", "arguments", "content", "state")), strict=True):
            if kind == "call":
                value = json.loads(arguments)
                faults = schema_faults(value, schemas[name]) if name in schemas else [f"no schema for {name}"]
                line = {"arguments": value, "id": ident, "name": name, "role": role, "type": "tool_call"}
                if faults:
                    line["faults"] = sorted(faults)
                valid.append(not faults)
            elif kind == "result":
                line = {"content": content, "role": role, "tool_call_id": ident, "type": "tool_result"}
                valid.append(None)
            else:
                line = {"content": content, "role": role, "type": "message"}
                valid.append(None)
            if state != "ok":
                line["link"] = state
            lines.append(canonical(line))
        yield batch.append_column("valid", pa.array(valid, pa.bool_())).append_column("line", pa.array(lines, pa.string()))


def _levels(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """(conv_id, key, at, cyclic): the turn at which an event that names others can stand, by peeling.

    Each round settles the events whose needs are all settled; what no round settles is a cycle and keeps its turn.
    """
    open_, settled = needs, None
    while True:
        waiting = open_.select("conv_id", F.col("key").alias("need")).distinct()
        blocked = open_.join(waiting, ["conv_id", "need"], "left_semi").select("conv_id", "key").distinct()
        free = open_.join(blocked, ["conv_id", "key"], "left_anti")
        known = calls if settled is None else calls.join(settled.select("conv_id", F.col("key").alias("need"), "at"), ["conv_id", "need"], "left").select("conv_id", "need", F.coalesce("at", "need_turn").alias("need_turn"))
        ready = free.join(known, ["conv_id", "need"], "left").groupBy("conv_id", "key").agg(F.greatest(F.max("turn"), F.max("need_turn")).alias("at"))
        ready = stage(ready.withColumn("cyclic", F.lit(False)), "settled")
        if ready.isEmpty():
            rest = open_.groupBy("conv_id", "key").agg(F.max("turn").alias("at")).withColumn("cyclic", F.lit(True))
            return rest if settled is None else settled.union(rest)
        settled = ready if settled is None else settled.union(ready)
        open_ = stage(open_.join(ready.select("conv_id", "key"), ["conv_id", "key"], "left_anti"), "open")


def link(parsed: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per event: conv_id, turn, position, kind, call_id, state, valid, line.

    state is ok, orphan (a result without a call or identifier), unanswered (a call without a result), repeated (a call
    whose identifier an earlier call has) or cyclic (calls that wait for each other). position counts from 0 in each
    conversation; null conversation ids are one conversation. Equal events keep their number: none is dropped. valid is
    null but for calls. An empty table gives no rows.
    """
    parsed = stage(parsed.withColumn("_tie", F.xxhash64("kind", "call_id", "name", "arguments", "content", "role")), "events")
    conv = F.coalesce("conv_id", F.lit(-(2**63)))
    keyed = parsed.withColumn("_conv", conv)
    calls = keyed.filter("kind = 'call' and call_id is not null")
    first = calls.groupBy("_conv", "call_id").agg(F.min(F.struct("turn", "part", "_tie")).alias("first"))
    answered = keyed.filter("kind = 'result' and call_id is not null").groupBy("_conv", "call_id").agg(F.count("*").alias("n_results"))
    known = first.join(answered, ["_conv", "call_id"], "left")
    known = stage(known, "known_calls")
    met = keyed.join(known, ["_conv", "call_id"], "left")
    own = F.struct("turn", "part", "_tie")
    state = (
        F.when((F.col("kind") == "result") & F.col("first").isNull(), "orphan")
        .when((F.col("kind") == "call") & F.col("first").isNotNull() & (F.col("first") != own), "repeated")
        .when((F.col("kind") == "call") & F.col("n_results").isNull(), "unanswered")
        .otherwise("ok")
    )
    at = F.when(F.col("kind") == "result", F.greatest("turn", F.coalesce("first.turn", "turn"))).otherwise(F.col("turn"))
    met = met.withColumn("state", state).withColumn("_at", at)
    # calls that name other calls: few, settled in rounds
    needs = calls.filter("size(needs) > 0").select(F.col("_conv").alias("conv_id"), F.col("call_id").alias("key"), "turn", F.explode("needs").alias("need"))
    needs = stage(needs, "needs")
    if not needs.isEmpty():
        ends = known.select(F.col("_conv").alias("conv_id"), F.col("call_id").alias("need"), F.col("first.turn").alias("need_turn"))
        levels = _levels(ends, needs.distinct()).select(F.col("conv_id").alias("_conv"), F.col("key").alias("call_id"), F.col("at").alias("_level"), "cyclic")
        met = met.join(levels, ["_conv", "call_id"], "left")
        met = met.withColumn("_at", F.greatest("_at", F.coalesce("_level", "_at")))
        met = met.withColumn("state", F.when(F.coalesce("cyclic", F.lit(False)), "cyclic").otherwise(F.col("state")))
    rank = F.when(F.col("kind") == "result", 1).otherwise(0)
    placed = met.withColumn("_rank", rank)
    placed = stage(numbered(placed, ["_at", "turn", "_rank", "part", "_tie"]), "placed")
    columns = ["conv_id", "turn", "position", "kind", "role", "call_id", "name", "arguments", "content", "state"]
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.select(*columns).schema)
    lined = placed.select(*columns).mapInArrow(lambda b: _lines(b, schemas), f"{out}, valid boolean, line string")
    return lined.select("conv_id", "turn", "position", "kind", "call_id", "state", "valid", "line")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``position`` of each row in its ``_conv`` by ``order``, whose first column is a turn and last a hash.

    Turns are cut into stretches, and a turn's rows into slices of the hash where one turn repeats; a task orders one
    slice, and the rows before it are counted.
    """
    head, *_, tie = order
    stretch: Column = F.floor(F.col(head) / STRETCH)
    counts = rows.groupBy("_conv", F.col(head).alias("_turn")).count().filter(F.col("count") > STRETCH)
    crowded = stage(counts.select("_conv", F.col("_turn").alias(head), F.lit(True).alias("_crowded")), "crowded")
    marked = rows.join(crowded, ["_conv", head], "left").withColumn("_stretch", stretch)
    # a crowded turn is ordered on its own: before and after it in the stretch stand other keys
    middle = [c for c in order[1:-1]]
    slice_ = F.when(F.col("_crowded"), F.struct(F.col(head).alias("t"), *middle, F.shiftrightunsigned(F.col(tie), 60).alias("s")))
    plain = F.struct(F.col(head).alias("t"), *[F.lit(None).cast("long").alias(c) for c in middle], F.lit(None).cast("long").alias("s"))
    marked = marked.withColumn("_slice", F.coalesce(slice_, plain))
    marked = stage(marked.withColumn("_slice", marked["_slice"]), "slices")
    sizes = marked.groupBy("_conv", "_stretch", "_slice").agg(F.count("*").alias("n"))
    totals = sizes.groupBy("_conv", "_stretch").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("_conv").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_conv", "_stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_conv", "_stretch").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_conv", "_stretch", "_slice", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("_skip"))
    starts = sizes.join(totals, ["_conv", "_stretch"])
    own = Window.partitionBy("_conv", "_stretch", "_slice").orderBy(*order)
    ranked = marked.withColumn("_row", F.row_number().over(own))
    joined = ranked.join(starts, ["_conv", "_stretch", "_slice"])
    return joined.withColumn("position", (F.col("_base") + F.col("_skip") + F.col("_row") - 1).cast("long"))
