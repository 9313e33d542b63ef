"""Chat formatting: links tool calls to results and writes canonical JSON.

Calls and results are found in message texts that hold a JSON object with
`tool_calls` (each id, name, arguments, optional `after`: the id of a call it
needs, or a list of ids) or with `tool_call_id` and `content`. Turns in which
neither is found, other JSON and broken JSON among them, are linked as exchanges:
each user turn is a call of the tool `reply`, answered by the assistant turn that
follows it and needing the exchange before it. Calls and results are hash-joined
by conversation and identifier.

Order: a call's depth is the length of the longest chain of calls it needs. Calls
that need exactly one other form chains, which pointer doubling shortens to the
call at their end (rounds grow with the logarithm of the longest chain). Calls
that need several are then resolved in rounds, each as soon as all it needs are:
one round per such call on the longest path. A conversation is never gathered.
Calls on a cycle, or behind one, have no depth and say so. Ties in depth are
ordered by turn and identifier. Needs that name no call count as none.

Arguments are checked against JSON Schemas (tool -> schema of its arguments):
type (one or several), enum, const, properties, required, additionalProperties,
items, and the bounds of numbers, lengths and sizes; other keywords are ignored.
The canonical form is JSON with sorted keys and no spaces.

A text is no JSON here if it breaks the grammar, nests too deeply for the parser,
or holds numbers that JSON can't write (NaN, infinities). Lone surrogates stay
in their escaped form. Null texts and roles are turns without calls; null
conversations are one conversation; of repeated calls or results with the same
identifier in one conversation the first by turn and text counts, the others are
reported as repeated. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callweave.functions.staging import staged

#: tool -> JSON Schema of its arguments
SCHEMAS = {
    "reply": {
        "type": "object",
        "properties": {"prompt": {"type": "string"}, "words": {"type": "integer", "minimum": 0}, "language": {"type": "string"}},
        "required": ["prompt", "words"],
        "additionalProperties": False,
    }
}
_SURROGATE = re.compile("[\ud800-\udfff]")


def escaped(text: str) -> str:
    """text with lone surrogates, which UTF-8 can't hold, as their JSON escapes."""
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    return escaped(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def is_a(value, kind: str) -> bool:
    """Whether a JSON value is of a JSON Schema type."""
    if isinstance(value, bool) or value is None:
        return kind == ("null" if value is None else "boolean")
    if isinstance(value, (int, float)):
        return kind == "number" or (kind == "integer" and float(value).is_integer() if isinstance(value, float) else kind in ("number", "integer"))
    return kind == {str: "string", list: "array", dict: "object"}[type(value)]


def _same(a, b) -> bool:
    return canonical(a) == canonical(b)


def violations(value, schema: dict, at: str = "") -> list[str]:
    """What is wrong with a value, each as `place: what`; the recursion is as deep as the schema."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    say = lambda what: f"{at or 'arguments'}: {what}"
    if kinds and not any(is_a(value, k) for k in kinds):
        return [say("not " + " or ".join(kinds))]
    out = []
    if "enum" in schema and not any(_same(value, x) for x in schema["enum"]):
        out.append(say("not in enum"))
    if "const" in schema and not _same(value, schema["const"]):
        out.append(say("not the constant"))
    size = {str: "Length", list: "Items", dict: "Properties"}.get(type(value))
    if size and not schema.get(f"min{size}", 0) <= len(value) <= schema.get(f"max{size}", len(value)):
        out.append(say("size out of bounds"))
    if is_a(value, "number") and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        out.append(say("out of bounds"))
    if isinstance(value, list) and "items" in schema:
        for k, x in enumerate(value):
            out += violations(x, schema["items"], f"{at}[{k}]")
    if isinstance(value, dict):
        known, inside = schema.get("properties", {}), f"{at}." if at else ""
        out += [f"{inside}{f}: missing" for f in schema.get("required", ()) if f not in value]
        for f, x in value.items():
            if f in known:
                out += violations(x, known[f], inside + f)
            elif schema.get("additionalProperties") is False:
                out.append(escaped(f"{inside}{f}: unknown"))
            elif isinstance(schema.get("additionalProperties"), dict):
                out += violations(x, schema["additionalProperties"], inside + f)
    return out


def errors_of(name: str, arguments, schemas: dict) -> list[str]:
    """What is wrong with a call's arguments, sorted."""
    if name not in schemas:
        return ["unknown tool"]
    return sorted(map(escaped, violations(arguments, schemas[name])))


def _read(text: str):
    """The value of a JSON text whose canonical form can be written; ValueError if there is none."""
    try:
        value = json.loads(text)
        canonical(value)
    except RecursionError:
        raise ValueError("nested too deeply") from None
    return value


def parse(text: str | None) -> tuple[list[dict], list[dict]]:
    """(calls, results) that a message text states as JSON."""
    if not text or not text.lstrip(" \t\n\r").startswith("{"):
        return [], []
    try:
        held = _read(text)
    except ValueError:
        return [], []
    calls = held.get("tool_calls")
    calls = [c for c in calls if isinstance(c, dict) and c.get("id") is not None] if isinstance(calls, list) else []
    return calls, [held] if held.get("tool_call_id") is not None else []


def _name(value) -> str:
    """Identifiers and tool names as text; those that are no strings in canonical form."""
    return escaped(value) if isinstance(value, str) else canonical(value)


def _needs(after) -> list[str]:
    each = after if isinstance(after, list) else [after]
    return sorted({_name(x) for x in each if x is not None})


def events(turns: DataFrame) -> DataFrame:
    """conv_id, turn, kind (call or result), id, name, arguments, after, content, text (of an exchange's call), from both readings."""
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for conv, turn, role, text in zip(part["conv_id"], part["turn"], part["role"], part["text"], strict=True):
                calls, results = parse(text)
                if not calls and not results:
                    rows.append((conv, turn, None, None, None, None, None, None, role, text))
                for c in calls:
                    made = c.get("arguments", {})
                    try:
                        made = _read(made) if isinstance(made, str) else made
                    except ValueError:
                        pass
                    rows.append((conv, turn, "call", _name(c["id"]), _name(c.get("name")), canonical(made), _needs(c.get("after")), None, None, None))
                rows += [(conv, turn, "result", _name(r["tool_call_id"]), None, None, None, canonical(r.get("content")), None, None) for r in results]
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "kind", "id", "name", "arguments", "after", "content", "role", "text"])

    schema = "conv_id long, turn long, kind string, id string, name string, arguments string, after array<string>, content string, role string, text string"
    # Only objects are parsed: white space, as JSON knows it, and a brace. Those that state nothing are plain turns.
    braced = F.coalesce(F.col("text").rlike(r"\A[ \t\n\r]*\{"), F.lit(False))
    parsed = staged(turns.where(braced).mapInPandas(run, schema), "parsed")
    stated = parsed.where("kind is not null").drop("role", "text").withColumn("text", F.lit(None).cast("string"))
    # Turns are matched to the next by a join on the turn number, not by a window over the conversation.
    plain = turns.where(~braced).unionByName(parsed.where("kind is null").select("conv_id", "turn", "role", "text"))
    user = plain.where("role = 'user'")
    name = lambda t: F.concat(F.lit("turn-"), t)
    calls = user.alias("u").join(user.select("conv_id", (F.col("turn") + 2).alias("turn"), F.lit(True).alias("has")).distinct().alias("p"), F.expr("u.conv_id <=> p.conv_id and u.turn = p.turn"), "left")
    text = F.coalesce("u.text", F.lit(""))
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    made = F.to_json(F.struct(text.alias("prompt"), words.alias("words")))
    calls = calls.select("u.conv_id", "u.turn", F.lit("call").alias("kind"), name(F.col("u.turn")).alias("id"), F.lit("reply").alias("name"), made.alias("arguments"), F.when(F.col("has"), F.array(name(F.col("u.turn") - 2))).otherwise(F.array().cast("array<string>")).alias("after"), F.lit(None).cast("string").alias("content"), "u.text")
    answers = plain.where("role = 'assistant'").select("conv_id", "turn", F.lit("result").alias("kind"), name(F.col("turn") - 1).alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"), F.lit(None).cast("array<string>").alias("after"), F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text"))).alias("content"), F.lit(None).cast("string").alias("text"))
    return stated.unionByName(calls).unionByName(answers)


def _chains(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """conv_id, id, top, steps, ends: the call at the end of the chain that starts at id, how far it is, and whether there is one."""
    single = edges.groupBy("conv_id", "id").agg(F.count("*").alias("n"), F.min("need").alias("need")).where("n = 1")
    held = calls.select("conv_id", "id").alias("c").join(single.alias("s"), F.expr("c.conv_id <=> s.conv_id and c.id = s.id"), "left")
    now = staged(held.select("c.conv_id", "c.id", F.coalesce("s.need", "c.id").alias("top"), F.col("s.need").isNotNull().cast("long").alias("steps"), F.col("s.need").isNull().alias("ends")), "chains")
    longest = calls.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(longest.bit_length()):  # then no chain is left, only cycles
        if now.where("not ends").isEmpty():
            break
        above = now.select(F.col("conv_id").alias("conv"), F.col("id").alias("k"), F.col("top").alias("next"), F.col("steps").alias("more"), F.col("ends").alias("done"))
        open_ = now.where("not ends").alias("c").join(above.alias("k"), F.expr("c.conv_id <=> k.conv and c.top = k.k"))
        moved = open_.select("c.conv_id", "c.id", F.col("k.next").alias("top"), (F.col("c.steps") + F.col("k.more")).alias("steps"), F.col("k.done").alias("ends"))
        now = staged(now.where("ends").unionByName(moved), "chains")
    return now


def depths(calls: DataFrame) -> DataFrame:
    """conv_id, id, after -> with depth: 0 for calls that need none (or none that exists), null on and behind cycles."""
    known = calls.select("conv_id", F.col("id").alias("k"))
    wanted = calls.select("conv_id", "id", F.explode("after").alias("need")).alias("c")
    edges = staged(wanted.join(known.alias("k"), F.expr("c.conv_id <=> k.conv_id and c.need = k.k")).select("c.conv_id", "c.id", "c.need").distinct(), "needs")
    chains = _chains(calls, edges)
    counts = edges.groupBy("conv_id", "id").agg(F.count("*").alias("n"))
    tops = chains.where("steps = 0 and ends").alias("t").join(counts.alias("n"), F.expr("t.conv_id <=> n.conv_id and t.id = n.id"), "left")
    tops = staged(tops.select("t.conv_id", "t.id", F.coalesce("n.n", F.lit(0)).alias("n")), "tops")
    done = tops.where("n = 0").select("conv_id", "id", F.lit(0).cast("long").alias("depth"))
    # A call with several needs waits for the ends of their chains; a chain into a cycle has no end and is never met.
    waits = edges.alias("e").join(tops.where("n > 1").alias("t"), F.expr("e.conv_id <=> t.conv_id and e.id = t.id"), "left_semi").alias("e")
    waits = waits.join(chains.alias("c"), F.expr("e.conv_id <=> c.conv_id and e.need = c.id"))
    waits = staged(waits.select("e.conv_id", "e.id", F.when(F.col("c.ends"), F.col("c.top")).alias("top"), (F.col("c.steps") + 1).alias("depth"), F.lit(False).alias("met")), "waits")
    found = done
    while not waits.isEmpty():
        join = waits.alias("w").join(done.alias("d"), F.expr("not w.met and w.conv_id <=> d.conv_id and w.top = d.id"), "left")
        now = staged(join.select("w.conv_id", "w.id", "w.top", (F.col("w.depth") + F.coalesce("d.depth", F.lit(0))).alias("depth"), (F.col("w.met") | F.col("d.id").isNotNull()).alias("met")), "waits")
        done = now.groupBy("conv_id", "id").agg(F.min("met").alias("met"), F.max("depth").alias("depth")).where("met").select("conv_id", "id", "depth")
        done = staged(done, "resolved")
        if done.isEmpty():
            break
        found = found.unionByName(done)
        waits = staged(now.alias("w").join(done.alias("d"), F.expr("w.conv_id <=> d.conv_id and w.id = d.id"), "left_anti"), "waits")
    held = chains.alias("c").join(found.alias("f"), F.expr("c.ends and c.conv_id <=> f.conv_id and c.top = f.id"), "left")
    return held.select("c.conv_id", "c.id", (F.col("f.depth") + F.col("c.steps")).alias("depth"))


def linked(turns: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """conv_id, turn, id, depth, status, errors, json: a row per call, orphan result, or repetition."""
    found = events(turns)
    nth = F.row_number().over(Window.partitionBy("conv_id", "kind", "id").orderBy("turn", F.col("text").asc_nulls_last(), F.coalesce("arguments", "content"), "name", "after"))
    found = staged(found.withColumn("nth", nth).drop("text"), "chat_events")
    first = found.where("nth = 1")
    calls, results = first.where("kind = 'call'"), first.where("kind = 'result'").select("conv_id", "id", F.col("turn").alias("result_turn"), "content")
    order = staged(depths(calls), "order")
    joined = calls.drop("content").alias("c").join(results.alias("r"), F.expr("c.conv_id <=> r.conv_id and c.id = r.id"), "full")
    joined = joined.select(F.coalesce("c.conv_id", "r.conv_id").alias("conv_id"), F.coalesce("c.turn", "r.result_turn").alias("turn"), F.coalesce("c.id", "r.id").alias("id"), "name", "arguments", "after", "result_turn", "content", F.col("c.id").isNull().alias("orphan"))
    joined = joined.unionByName(found.where("nth > 1").select("conv_id", "turn", "id", "name", "arguments", "after", "content", F.lit(None).cast("long").alias("result_turn"), F.lit(None).cast("boolean").alias("orphan")))
    joined = joined.alias("c").join(order.alias("o"), F.expr("c.conv_id <=> o.conv_id and c.id = o.id and c.orphan = false"), "left").select("c.*", "o.depth")
    status = F.when(F.col("orphan").isNull(), "repeated").when(F.col("orphan"), "orphan result").when(F.col("depth").isNull(), "cycle").when(F.col("result_turn").isNull(), "unanswered").when(F.col("result_turn") < F.col("turn"), "answered early").otherwise("answered")
    joined = joined.withColumn("status", status)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        text = lambda x: x if isinstance(x, str) else None
        for part in parts:
            errors, made = [], []
            for r in part.itertuples():
                name, arguments = text(r.name), text(r.arguments)
                errors.append(errors_of(name, json.loads(arguments), schemas) if name is not None else [])
                after = [] if r.after is None else list(r.after)
                # Arguments and result are in canonical form already; they are set in as they are.
                shown = {"after": canonical(after), "arguments": arguments or "null", "id": canonical(r.id), "name": canonical(name), "result": text(r.content) or "null", "status": canonical(r.status)}
                made.append("{" + ",".join(f'"{k}":{v}' for k, v in shown.items()) + "}")
            yield part[["conv_id", "turn", "id", "depth", "status"]].assign(errors=errors, json=made)

    out = joined.select("conv_id", "turn", "id", "depth", "status", "name", "arguments", "after", "content")
    return out.mapInPandas(run, "conv_id long, turn long, id string, depth long, status string, errors array<string>, json string")
