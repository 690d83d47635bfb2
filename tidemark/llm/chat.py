"""Chat formatting: tool calls linked with their results, ordered, checked and serialised.

An assistant message holds calls as ``<tool_call>{"id", "name", "arguments"}</tool_call>``; a message
of role ``tool`` answers one as ``{"tool_call_id", "content"}``. An argument of the form
``{"$result": id}`` makes a call depend on another of its conversation. Schemas of tools come from
``<tools>`` lists in the system messages of the conversation, and from a registry for tools that it
doesn't declare. Calls meet results and schemas in hash joins on the conversation and the identifier
or name; each conversation's calls are ordered by Kahn's algorithm, those of conversations of more
than ``GROUP_ROWS`` dependencies by repeated joins, so that no task holds an unbounded group;
arguments are checked against the JSON schema of the tool; each message becomes one line of
canonical JSON (sorted keys, no spaces, shortest numbers). Messages without calls and results are
serialised by a native projection where they are read and never shuffled.

Defined results: a null text is the empty content and a null role the empty role; a null conv_id is
a conversation of its own; bytes that are no UTF-8 become U+FFFD. A call that isn't JSON, is nested
deeper than ``MAX_NEST``, or lacks a name or an id of whole characters, stays in the content and isn't
counted; lone surrogates elsewhere stay as escapes. Of calls with one identifier in a conversation the
first by turn and place counts; a result answers a call of an earlier turn, and of several the first
by turn counts. Calls in a cycle, or behind an unknown call, have level null, orders of any depth are
followed. A tool without a schema is ``unknown tool``, a schema that can't be applied ``bad schema``, a
pattern that is invalid or takes over a second fits nothing. Of repeated rows each is kept; long
messages are read whole; an empty table gives an empty result. Only the four named columns are read.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import batch_rows
from tidemark.session import discard, stage

CALL = re.compile(r"<tool_call>(.*?)</tool_call>", re.S)
DECLARED = re.compile(r"<tools>(.*?)</tools>", re.S)
#: Nesting of a call, a result or a schema that is still read.
MAX_NEST = 100
#: Dependencies of one conversation that one task orders.
GROUP_ROWS = 100_000
#: Schemas of the tools that conversations may use without declaring them.
TOOLS = {
    "search": {"type": "object", "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1}}, "required": ["query"]},
    "fetch": {"type": "object", "properties": {"url": {"type": "string", "pattern": "^https?://"}}, "required": ["url"], "additionalProperties": False},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string", "minLength": 1}}, "required": ["expression"]},
    "run_code": {"type": "object", "properties": {"language": {"type": "string"}, "code": {"type": "string"}}, "required": ["code"]},
}
_SURROGATE = re.compile("[\ud800-\udfff]")
_TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}


def canonical(value) -> str:
    """One line of JSON for equal values: sorted keys, no spaces, whole floats as integers."""

    def plain(v):
        if isinstance(v, float):
            return int(v) if v.is_integer() and abs(v) < 2**53 else (v if v == v and abs(v) != float("inf") else None)
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else v

    line = json.dumps(plain(value), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", line)


def _same(a, b) -> bool:
    """Equality of JSON values: numbers by value, true and 1 apart."""
    return canonical(a) == canonical(b)


def _matches(pattern: str, value: str) -> bool:
    import regex

    try:
        return bool(regex.search(pattern, value, timeout=1))
    except (regex.error, TimeoutError):
        return False


def faults(value, schema: dict | bool, at: str = "$") -> list[str]:
    """What in ``value`` breaks ``schema`` (type, enum, const, bounds, lengths, pattern, items,
    properties, required, additionalProperties, anyOf)."""
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: value"]
    out, kinds = [], schema.get("type")

    def fits(kind: str) -> bool:
        if kind in ("integer", "number"):
            whole = isinstance(value, int) or isinstance(value, float) and value.is_integer()
            return not isinstance(value, bool) and (whole if kind == "integer" else isinstance(value, int | float))
        return isinstance(value, _TYPES.get(kind, ()))

    if kinds and not any(fits(k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: type"]
    if "enum" in schema and not any(_same(value, x) for x in schema["enum"]) or "const" in schema and not _same(value, schema["const"]):
        out.append(f"{at}: value")
    if isinstance(value, int | float) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            out.append(f"{at}: bounds")
    if isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
            out.append(f"{at}: length")
        if "pattern" in schema and not _matches(schema["pattern"], value):
            out.append(f"{at}: pattern")
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
            out.append(f"{at}: length")
        for i, x in enumerate(value):
            out += faults(x, schema.get("items", {}), f"{at}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        for k, x in value.items():
            more = schema.get("additionalProperties", True)
            if k in known or isinstance(more, dict):
                out += faults(x, known.get(k, more), f"{at}.{k}")
            elif more is False:
                out.append(f"{at}.{k}: unknown")
    if "anyOf" in schema and all(faults(value, s, at) for s in schema["anyOf"]):
        out.append(f"{at}: anyOf")
    return out


def references(value) -> set[str]:
    """Identifiers of the calls whose results an argument value uses."""
    if isinstance(value, dict):
        if set(value) == {"$result"} and isinstance(value["$result"], str):
            return {value["$result"]}
        value = list(value.values())
    return set().union(*map(references, value)) if isinstance(value, list) else set()


def _loaded(raw):
    """The JSON value of a text, or None where it is none or nested too deeply."""
    try:
        found = json.loads(raw)
    except (ValueError, RecursionError, TypeError):
        return None
    level = [found]
    for _ in range(MAX_NEST):
        level = [x for v in level if isinstance(v, dict | list) for x in (v.values() if isinstance(v, dict) else v)]
        if not level:
            return found
    return None


def _named(value) -> bool:
    return isinstance(value, str) and not _SURROGATE.search(value)


def _is_call(value) -> bool:
    return isinstance(value, dict) and _named(value.get("id")) and _named(value.get("name"))


def calls_of(text: str) -> list[dict]:
    """The well-formed calls of an assistant message, arguments that are given as JSON text read as such."""
    found = [c for m in CALL.findall(text) if _is_call(c := _loaded(m))]
    for c in found:
        if isinstance(c.get("arguments"), str) and isinstance(inner := _loaded(c["arguments"]), dict):
            c["arguments"] = inner
    return found


def result_of(text: str) -> dict | None:
    """The answer in a tool message."""
    found = _loaded(text)
    return found if isinstance(found, dict) and _named(found.get("tool_call_id")) else None


def tools_of(text: str) -> dict[str, object]:
    """Schemas by tool name that a system message declares: JSON arrays, or an object on each line;
    ``{"name", "parameters"}``, alone or as the ``function`` of an object. The first of a name counts."""
    out: dict[str, object] = {}
    for block in DECLARED.findall(text):
        found = _loaded(block)
        found = [_loaded(x) for x in block.splitlines()] if found is None else found if isinstance(found, list) else [found]
        for tool in found:
            tool = tool.get("function", tool) if isinstance(tool, dict) else None
            if isinstance(tool, dict) and _named(tool.get("name")):
                out.setdefault(tool["name"], tool.get("parameters", {}))
    return out


def status_of(arguments, schema) -> str:
    """``valid`` or what is wrong; ``schema`` None is that of an unknown tool."""
    if schema is None:
        return "unknown tool"
    try:
        return "; ".join(faults(arguments, schema)) or "valid"
    except (TypeError, AttributeError, ValueError, RecursionError):
        return "bad schema"


def ordered(needs: list[tuple[str, str | None]]) -> dict[str, int]:
    """(call, call it uses or None) pairs of a conversation → level by call: 0 for calls that use no
    other, else one more than the highest they use; calls that no order reaches are left out."""
    open_uses, users, level = defaultdict(set), defaultdict(list), {}
    for call, use in needs:
        open_uses[call].update([] if use is None else [use])
    for call, uses in open_uses.items():
        for use in uses:
            users[use].append(call)
    queue = deque(c for c, uses in open_uses.items() if not uses)
    level = dict.fromkeys(queue, 0)
    while queue:
        done = queue.popleft()
        for call in users[done]:
            open_uses[call].discard(done)
            if not open_uses[call]:
                level[call] = level[done] + 1  # calls come off the queue by rising level
                queue.append(call)
    return level


_OUT = "conv_id bigint, turn bigint, role string, n_calls bigint, n_linked bigint, n_valid bigint, message string"
_PARTS = "row bigint, conv string, turn bigint, place int, call_id string, name string, arguments string, uses array<string>"


def json_string(text: Column) -> Column:
    """A JSON string of a text, as ``canonical`` writes it, by built-in functions."""
    out = text
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    rare = F.transform(F.split(out, ""), lambda c: F.when(c < F.lit(" "), F.concat(F.lit("\\u00"), F.lower(F.lpad(F.hex(F.ascii(c)), 2, "0")))).otherwise(c))
    return F.concat(F.lit('"'), F.when(out.rlike(r"[\x00-\x1f]"), F.array_join(rare, "")).otherwise(out), F.lit('"'))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tagged messages → their calls; an answer has place -1, a message with neither -2."""
    texts = ("conv", "call_id", "name", "arguments")
    schema = pa.schema([("row", pa.int64()), ("conv", pa.string()), ("turn", pa.int64()), ("place", pa.int32()), *((n, pa.string()) for n in texts[1:]), ("uses", pa.list_(pa.string()))])
    for b in batches:
        out = []
        for row in b.to_pylist():
            own = {k: row[k] for k in ("row", "conv", "turn")} | {"name": None, "arguments": None, "uses": []}
            calls = calls_of(row["text"]) if row["role"] == "assistant" else []
            answer = result_of(row["text"]) if row["role"] == "tool" else None
            for place, c in enumerate(calls):
                given = c.get("arguments", {})
                uses = sorted(_SURROGATE.sub("\ufffd", x) for x in references(given))
                out.append(own | {"place": place, "call_id": c["id"], "name": c["name"], "arguments": canonical(given), "uses": uses})
            if not calls:
                out.append(own | {"place": -1 if answer else -2, "call_id": answer and answer["tool_call_id"]})
        yield pa.RecordBatch.from_pylist(out, schema)


def _declared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv", pa.string()), ("turn", pa.int64()), ("name", pa.string()), ("schema", pa.string())])
    for b in batches:
        out = [{"conv": r["conv"], "turn": r["turn"], "name": n, "schema": canonical(s)} for r in b.to_pylist() for n, s in tools_of(r["text"]).items()]
        yield pa.RecordBatch.from_pylist(out, schema)


def _checked(registry: dict[str, dict]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            status = [
                status_of(json.loads(given), json.loads(own) if own is not None else registry.get(name))
                for name, given, own in zip(*(b.column(c).to_pylist() for c in ("name", "arguments", "schema")), strict=True)
            ]
            yield pa.RecordBatch.from_pydict({"row": b.column("row"), "place": b.column("place"), "status": status})

    return run


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Dependencies sorted by conversation → levels."""
    schema = pa.schema([("conv", pa.string()), ("call_id", pa.string()), ("level", pa.int32())])

    def closed(conv, needs):
        found = ordered(needs)
        return pa.RecordBatch.from_pydict({"conv": [conv] * len(found), "call_id": list(found), "level": list(found.values())}, schema=schema)

    conv, needs = None, []
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("conv", "call_id", "use")), strict=True):
            if needs and row[0] != conv:
                yield closed(conv, needs)
                needs = []
            conv = row[0]
            needs.append(row[1:])
    if needs:
        yield closed(conv, needs)


def _message(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, pa.string() if n in ("role", "message") else pa.int64()) for n in ("conv_id", "turn", "role", "n_calls", "n_linked", "n_valid", "message")])
    for b in batches:
        out = []
        for row in b.to_pylist():
            found = {c["place"]: c for c in row["calls"] if c["place"] >= 0}
            message: dict = {"role": row["role"] or "", "content": row["text"] or ""}
            if found:
                message["content"] = CALL.sub(lambda m: "" if _is_call(_loaded(m[1])) else m[0], row["text"])
                parsed = calls_of(row["text"])
                order = sorted(found, key=lambda p: (found[p]["level"] is None, found[p]["level"] or 0, parsed[p]["id"], p))
                message["tool_calls"] = [
                    {"id": parsed[p]["id"], "name": parsed[p]["name"], "arguments": parsed[p].get("arguments", {}), "level": found[p]["level"], "answered_at": found[p]["answered"], "status": found[p]["status"]}
                    for p in order
                ]
            elif row["role"] == "tool" and (answer := result_of(row["text"])):
                message |= {"tool_call_id": answer["tool_call_id"], "content": answer.get("content", ""), "linked": bool(row["calls"][0]["asked"])}
            out.append(
                {"conv_id": row["conv_id"], "turn": row["turn"], "role": row["role"], "n_calls": len(found)}
                | {"n_linked": sum(c["answered"] is not None for c in found.values()), "n_valid": sum(c["status"] == "valid" for c in found.values())}
                | {"message": canonical(message)}
            )
        yield pa.RecordBatch.from_pylist(out, schema)


def levels(calls: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(conv, call_id, uses) → (conv, call_id, level), as ``ordered`` gives them."""
    needs = stage(calls.select("conv", "call_id", F.explode_outer("uses").alias("use")).distinct(), "needs")
    large = stage(needs.groupBy("conv").agg(F.count("*").alias("n")).filter(F.col("n") > group_rows).select("conv"), "large")
    small = needs.join(large, "conv", "left_anti").repartition("conv").sortWithinPartitions("conv")
    done = [stage(small.mapInArrow(_levels, "conv string, call_id string, level int"), "levels")]
    if not large.isEmpty():
        done.append(_levels_by_joins(stage(needs.join(large, "conv", "left_semi"), "large-needs")))
    discard(needs, large)
    return done[0] if len(done) == 1 else done[0].unionAll(done[1])


def _levels_by_joins(needs: DataFrame) -> DataFrame:
    """Levels of dependencies (conv, call_id, use) of any number in one conversation: a round for each
    level, which joins the calls still open with those that have one."""
    done = stage(needs.filter("use IS NULL").select("conv", "call_id", F.lit(0).alias("level")), "levels")
    rest, depth = needs.filter("use IS NOT NULL"), 0
    while True:
        depth += 1
        known = done.select("conv", F.col("call_id").alias("use"), F.lit(1).alias("known"))
        open_calls = rest.join(done.select("conv", "call_id"), ["conv", "call_id"], "left_anti")
        ready = open_calls.join(known, ["conv", "use"], "left").groupBy("conv", "call_id").agg(F.min(F.coalesce("known", F.lit(0))).alias("all"))
        fresh = stage(ready.filter(F.col("all") == 1).select("conv", "call_id", F.lit(depth).alias("level")), "levels")
        if fresh.isEmpty():
            return done
        done = stage(done.unionAll(fresh), "levels") if depth % 16 == 0 else done.unionAll(fresh)


def link_tools(conversations: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) → one row per message with its canonical JSON.
    ``schemas`` are those of tools that a conversation doesn't declare itself."""
    spark = conversations.sparkSession
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), *(F.make_valid_utf8(F.col(c)).alias(c) for c in ("role", "text"))
    )
    tagged = F.expr("coalesce(role = 'tool' OR (role = 'assistant' AND contains(text, '<tool_call>')), false) AND text IS NOT NULL")
    zero = F.lit(0).cast("bigint")
    line = F.concat(F.lit('{"content":'), json_string(F.coalesce("text", F.lit(""))), F.lit(',"role":'), json_string(F.coalesce("role", F.lit(""))), F.lit("}"))
    plain = rows.filter(~tagged).select("conv_id", "turn", "role", *(zero.alias(n) for n in ("n_calls", "n_linked", "n_valid")), line.alias("message"))
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv")
    with batch_rows(spark, 500):
        with_calls = stage(rows.filter(tagged).select(F.monotonically_increasing_id().alias("row"), conv, "*"), "tool-messages")
        if with_calls.isEmpty():
            return plain
        parts = stage(with_calls.mapInArrow(_parts, _PARTS), "tool-parts")
        system = rows.filter("role = 'system' AND contains(text, '<tools>')").select(conv, "turn", "text")
        declared = system.mapInArrow(_declared, "conv string, turn bigint, name string, schema string")
        declared = stage(declared.groupBy("conv", "name").agg(F.min(F.struct("turn", "schema")).alias("d")).select("conv", "name", "d.schema"), "tool-schemas")
        calls = parts.filter("place >= 0")
        status = calls.join(declared, ["conv", "name"], "left").mapInArrow(_checked(schemas or {}), "row bigint, place int, status string")
        first = calls.groupBy("conv", "call_id").agg(F.min(F.struct("turn", "row", "place", "uses")).alias("f"))
        unique = stage(first.select("conv", "call_id", "f.turn", "f.row", "f.place", "f.uses"), "tool-calls")
        answers = parts.filter("place = -1")
        turns = answers.select("conv", "call_id", F.col("turn").alias("at")).distinct()
        asked_at = unique.select("conv", "call_id", F.col("turn").alias("asked_at"))
        answered = (
            unique.join(turns.hint("shuffle_hash"), ["conv", "call_id"]).filter("at > turn").groupBy("row", "place").agg(F.min("at").alias("answered"))
        )
        level = unique.join(levels(unique), ["conv", "call_id"]).select("row", "place", "level")
        of_calls = calls.select("row", "place").join(status, ["row", "place"]).join(answered, ["row", "place"], "left").join(level, ["row", "place"], "left")
        of_answers = parts.filter("place < 0").join(asked_at.hint("shuffle_hash"), ["conv", "call_id"], "left").select("row", "place", F.expr("coalesce(turn > asked_at, false)").alias("asked"))
        none = {"status": F.lit(None).cast("string"), "answered": F.lit(None).cast("bigint"), "level": F.lit(None).cast("int")}
        part = F.struct("place", "status", "answered", "level", "asked")
        both = of_calls.withColumn("asked", F.lit(True)).select("row", part.alias("c")).unionByName(of_answers.withColumns(none).select("row", part.alias("c")))
        whole = with_calls.join(both.groupBy("row").agg(F.array_sort(F.collect_list("c")).alias("calls")), "row")
        messages = stage(whole.drop("conv").mapInArrow(_message, _OUT), "tool-lines")
    discard(with_calls, parts, declared, unique)
    return plain.unionAll(messages)


def query(spark, sf_dir: str) -> DataFrame:
    return link_tools(spark.read.parquet(f"{sf_dir}/conversations.parquet"), TOOLS)
