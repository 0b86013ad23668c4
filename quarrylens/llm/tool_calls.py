"""Chat formatting with tool calls: link, order, validate, and serialise canonically.

Messages become parts: plain messages, calls and results.  Results are hash-joined with calls
by (conversation, identifier).  Parts are ordered so that a result follows its call and a call
follows the calls it refers to; arguments are checked against the tools' schemas; every part
is one line of canonical JSON.  A conversation is never gathered in one task: its order is a
sortable key on each part.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.operators.lineage import cut

# No chain of calls is as long; lengths around a cycle double and stay below.
LONGEST = 2**40

PARTS = (
    "conv_id bigint, turn bigint, part int, kind string, call_id string, name string, refs array<string>, "
    "errors array<string>, json string"
)


def canonical(value: Any) -> str:
    """JSON with members in UTF-16 order, no white space, shortest numbers and plain characters."""
    if isinstance(value, dict):
        members = sorted(value.items(), key=lambda x: x[0].encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{canonical(k)}:{canonical(v)}" for k, v in members) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float) and math.isfinite(value) and value.is_integer() and abs(value) < 1e21:
        return str(int(value))
    return json.dumps(value, ensure_ascii=False)


_KINDS: dict[str, Callable[[Any], bool]] = {
    "object": lambda x: isinstance(x, dict),
    "array": lambda x: isinstance(x, list),
    "string": lambda x: isinstance(x, str),
    "boolean": lambda x: isinstance(x, bool),
    "null": lambda x: x is None,
    "integer": lambda x: not isinstance(x, bool) and (isinstance(x, int) or isinstance(x, float) and x.is_integer()),
    "number": lambda x: not isinstance(x, bool) and isinstance(x, int | float),
}


def schema_errors(value: Any, schema: Mapping, at: str = "$") -> Iterator[str]:
    """What of ``value`` breaks the schema: type, enum, bounds, lengths, members and items."""
    kinds = schema.get("type")
    if kinds is not None:
        allowed = [kinds] if isinstance(kinds, str) else kinds
        if not any(_KINDS[k](value) for k in allowed):
            yield f"{at}: not of type {'|'.join(allowed)}"
            return
    if "enum" in schema and canonical(value) not in [canonical(x) for x in schema["enum"]]:
        yield f"{at}: not a listed value"
    if _KINDS["number"](value):
        if value < schema.get("minimum", value):
            yield f"{at}: below {schema['minimum']}"
        if value > schema.get("maximum", value):
            yield f"{at}: above {schema['maximum']}"
    if isinstance(value, str | list):
        low, high = ("minLength", "maxLength") if isinstance(value, str) else ("minItems", "maxItems")
        if len(value) < schema.get(low, 0):
            yield f"{at}: shorter than {schema[low]}"
        if len(value) > schema.get(high, len(value)):
            yield f"{at}: longer than {schema[high]}"
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            yield from schema_errors(x, schema["items"], f"{at}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for name in schema.get("required", ()):
            if name not in value:
                yield f"{at}: {name} is missing"
        for name in sorted(value):
            if name in known:
                yield from schema_errors(value[name], known[name], f"{at}.{name}")
            elif schema.get("additionalProperties", True) is False:
                yield f"{at}: {name} is unknown"


def references(value: Any) -> Iterator[str]:
    """Identifiers of the calls that arguments refer to: the strings of members named ``$ref``."""
    if isinstance(value, dict):
        for name, x in value.items():
            if name == "$ref":
                yield from (y for y in (x if isinstance(x, list) else [x]) if isinstance(y, str))
            else:
                yield from references(x)
    elif isinstance(value, list):
        for x in value:
            yield from references(x)


def _loads(text: str) -> Any:
    def no_constant(name: str) -> None:
        raise ValueError(f"{name} is not JSON")

    return json.loads(text, parse_constant=no_constant)


def _call(call: Any, schemas: Mapping[str, Mapping]) -> tuple:
    """(kind, id, name, refs, errors, JSON) of one entry of ``tool_calls``."""
    errors = []
    if not isinstance(call, dict):
        return "call", None, None, [], ["the call is no object"], canonical({"type": "call", "raw": call})
    inner = call.get("function") if isinstance(call.get("function"), dict) else call
    call_id, name, arguments = call.get("id"), inner.get("name"), inner.get("arguments")
    if isinstance(arguments, str):
        try:
            arguments = _loads(arguments)
        except ValueError:
            errors.append("the arguments are no JSON")
    if not isinstance(call_id, str):
        call_id = None
        errors.append("the call has no identifier")
    if not isinstance(name, str):
        name = None
    if name not in schemas:
        errors.append("the tool is unknown")
    elif not errors or errors[-1] != "the arguments are no JSON":
        errors.extend(schema_errors(arguments, schemas[name]))
    body = canonical({"type": "call", "id": call_id, "name": name, "arguments": arguments})
    return "call", call_id, name, sorted(set(references(arguments))), errors, body


def parts_of(role: str | None, text: str | None, schemas: Mapping[str, Mapping]) -> Iterable[tuple]:
    """The parts of one message: (kind, id, name, refs, errors, JSON)."""
    value: Any = None
    if text and role in ("assistant", "tool") and text.lstrip()[:1] == "{":
        try:
            value = _loads(text)
        except (ValueError, RecursionError):
            value = None
    if role == "tool":
        call_id = value.get("tool_call_id") if isinstance(value, dict) else None
        known = isinstance(call_id, str)
        content = value.get("content") if isinstance(value, dict) else text
        errors = [] if known else ["the result has no identifier"]
        body = canonical({"type": "result", "tool_call_id": call_id if known else None, "content": content})
        yield "result", call_id if known else None, None, [], errors, body
        return
    calls = value.get("tool_calls") if isinstance(value, dict) and role == "assistant" else None
    if isinstance(calls, list) and calls:
        if value.get("content") is not None:
            yield "message", None, None, [], [], canonical({"type": "message", "role": role, "content": value["content"]})
        for call in calls:
            yield _call(call, schemas)
        return
    yield "message", None, None, [], [], canonical({"type": "message", "role": role, "content": text})


def message_parts(messages: DataFrame, schemas: Mapping[str, Mapping]) -> DataFrame:
    """The parts of every message; columns conv_id, turn, role and text are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "turn", "part", "kind", "call_id", "name", "refs", "errors", "json"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.string()] * 3, *[pa.list_(pa.string())] * 2, pa.string()]
        for batch in batches:
            rows = []
            for conv_id, turn, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for part, (kind, call_id, name, refs, errors, body) in enumerate(parts_of(role, text, schemas)):
                    rows.append((conv_id, turn, part, kind, call_id, name, refs, errors, body))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    rows = messages.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role").cast("string"), F.col("text").cast("string")
    )
    return rows.mapInArrow(run, PARTS)


def _place(turn: Column, part: Column, depth: Column) -> Column:
    """A sortable position; a null turn comes last."""
    return F.struct(
        F.coalesce(turn, F.lit(2**63 - 1)).alias("turn"), part.alias("part"), depth.cast("int").alias("depth")
    )


def call_order(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, place, settled) of (conv_id, call_id, place, refs): one row per call.

    A call that comes after all it refers to keeps its place in time.  The others take the latest
    place of what they refer to, directly or not, one step deeper for each call between.  A call is
    not settled when its place depends on a cycle of references.  Chains may have any length: single
    references are followed by doubling, in about log2 of the chain's length rounds.
    """
    edges = cut(
        calls.select("conv_id", "call_id", F.explode("refs").alias("ref"))
        .join(calls.select("conv_id", F.col("call_id").alias("ref")), ["conv_id", "ref"], "left_semi")
        .distinct()
    )
    if edges.isEmpty():
        return calls.select("conv_id", "call_id", "place", F.lit(True).alias("settled"))
    tops = _latest_reached(calls, edges)
    of_call = tops.select("conv_id", "call_id", F.col("top").alias("_top"))
    of_ref = tops.select("conv_id", F.col("call_id").alias("ref"), F.col("top").alias("_of_ref"))
    tight = edges.join(of_call, ["conv_id", "call_id"]).join(of_ref, ["conv_id", "ref"]).filter("_top = _of_ref")
    depths = _depths(cut(tight.select("conv_id", "call_id", "ref")))
    place = _place(F.col("top.turn"), F.col("top.part"), F.coalesce("depth", F.lit(0)))
    found = tops.join(depths, ["conv_id", "call_id"], "left")
    return found.select("conv_id", "call_id", place.alias("place"), F.coalesce("settled", F.lit(True)).alias("settled"))


def _latest_reached(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, top, at): the latest (turn, part) among a call and all it refers to, and whose it is.

    Values only rise and are places of calls, so that cycles come to rest as well.
    """
    top = F.struct(F.col("place.turn").alias("turn"), F.col("place.part").alias("part"))
    tops = cut(calls.select("conv_id", "call_id", top.alias("top"), F.col("call_id").alias("at")))
    while True:
        # The latest call found so far may itself refer further: asking it as well doubles the reach.
        asked = edges.unionByName(tops.filter("at <> call_id").select("conv_id", "call_id", F.col("at").alias("ref")))
        target = tops.select("conv_id", F.col("call_id").alias("ref"), F.struct("top", "at").alias("_found"))
        pushed = asked.join(target, ["conv_id", "ref"]).groupBy("conv_id", "call_id").agg(F.max("_found").alias("_found"))
        moved = cut(
            tops.select("conv_id", "call_id", "top")
            .join(pushed, ["conv_id", "call_id"])
            .filter(F.col("_found.top") > F.col("top"))
            .select("conv_id", "call_id", "_found")
        )
        if moved.isEmpty():
            return tops
        found = tops.join(moved, ["conv_id", "call_id"], "left")
        tops = cut(
            found.select(
                "conv_id", "call_id", F.coalesce("_found.top", "top").alias("top"), F.coalesce("_found.at", "at").alias("at")
            )
        )


def _depths(edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth, settled) of the calls with ``edges``: the most references in a chain below each.

    A row is a way down from a call, ending at ``ref``, or at the end of its chain where that is
    null.  In a round ways to a call that has one open way go on along it, and those to a call
    without any end.  If calls are left that reach no cycle, one of them ends in each round; so a
    round without any leaves those on a cycle and behind it.
    """
    key = ["conv_id", "call_id"]
    heads = edges.select("conv_id", F.col("call_id").alias("ref"), F.lit(True).alias("_goes_on")).distinct()
    ways = edges.join(heads, ["conv_id", "ref"], "left").select(
        *key, F.when(F.col("_goes_on"), F.col("ref")).alias("ref"), F.lit(1).cast("bigint").alias("length")
    )
    ways = cut(ways.groupBy(*key, "ref").agg(F.max("length").alias("length")))
    before = None
    while True:
        nodes = cut(
            ways.groupBy(*key).agg(
                F.count("ref").alias("n_open"),
                F.max("ref").alias("next"),
                F.max(F.when(F.col("ref").isNotNull(), F.col("length"))).alias("step"),
                F.max(F.when(F.col("ref").isNull(), F.col("length"))).alias("ended"),
            )
        )
        left = nodes.filter("n_open > 0").count()
        if left == 0 or left == before:
            return nodes.select(*key, F.coalesce("ended", F.lit(0)).alias("depth"), (F.col("n_open") == 0).alias("settled"))
        before = left
        single = nodes.filter("n_open <= 1").select(
            "conv_id",
            F.col("call_id").alias("ref"),
            F.filter(
                F.array(
                    F.when(F.col("ended").isNotNull(), F.struct(F.lit(None).cast("string").alias("ref"), F.col("ended").alias("length"))),
                    F.when(F.col("n_open") == 1, F.struct(F.col("next").alias("ref"), F.col("step").alias("length"))),
                ),
                lambda x: x.isNotNull(),
            ).alias("_on"),
        )
        stay = F.array(F.struct(F.col("ref").alias("ref"), F.lit(0).cast("bigint").alias("length")))
        gone = ways.join(single, ["conv_id", "ref"], "left").select(*key, "length", F.explode(F.coalesce("_on", stay)).alias("_way"))
        length = F.least(F.col("length") + F.col("_way.length"), F.lit(LONGEST))
        ways = cut(
            gone.select(*key, F.col("_way.ref").alias("ref"), length.alias("length"))
            .groupBy(*key, "ref")
            .agg(F.max("length").alias("length"))
        )


def link_tool_calls(messages: DataFrame, schemas: Mapping[str, Mapping], rounds: int | None = None) -> DataFrame:
    """A row for each part of each message: its order, its link and its canonical JSON.

    Columns: conv_id, turn, part, kind (message, call or result), call_id, name, linked (a call:
    it has a result; a result: it has a call; null for messages), valid (a call: known tool and
    fitting arguments; null otherwise), errors, order_turn, order_part, order_depth (sorted by
    them within a conversation, a call comes after the calls it refers to and before its results),
    and json.

    Calls carry the JSON object ``{"tool_calls": [{"id", "name", "arguments"}]}`` as an
    assistant's text, results ``{"tool_call_id", "content"}`` as a tool's.  Of calls with one
    identifier in a conversation the first counts, the others are reported; every result of
    an identifier is linked with it.  Nulls: a part without conversation or identifier links with
    nothing; a null turn sorts last; a null role or text is a message.  Text that is no such JSON is a
    plain message, an empty table gives no rows, repeated rows are repeated parts, and other
    columns of ``messages`` are not read.  ``rounds`` was a bound of the chains and has no effect.
    """
    parts = cut(message_parts(messages, schemas))
    own = _place(F.col("turn"), F.col("part"), F.lit(0))
    named = parts.filter(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
    calls = cut(
        named.filter("kind = 'call'")
        .groupBy("conv_id", "call_id")
        .agg(F.min_by("refs", own).alias("refs"), F.min(own).alias("place"))
    )
    order = cut(
        call_order(calls)
        .join(calls.select("conv_id", "call_id", F.col("place").alias("first")), ["conv_id", "call_id"])
        .join(
            named.filter("kind = 'result'").select("conv_id", "call_id").distinct().withColumn("answered", F.lit(True)),
            ["conv_id", "call_id"],
            "left",
        )
    )
    missing = (
        calls.select("conv_id", "call_id", F.explode("refs").alias("ref"))
        .join(calls.select("conv_id", F.col("call_id").alias("ref")), ["conv_id", "ref"], "left_anti")
        .groupBy("conv_id", "call_id")
        .agg(F.count(F.lit(1)).alias("missing"))
    )
    facts = cut(order.join(missing, ["conv_id", "call_id"], "left"))
    found = parts.join(facts, ["conv_id", "call_id"], "left")
    is_call, is_result, known = F.col("kind") == "call", F.col("kind") == "result", F.col("place").isNotNull()
    primary = known & is_call & (own == F.col("first"))
    behind = F.col("place").withField("depth", F.col("place.depth") + 1)
    at = F.when(primary, F.col("place")).when(known & is_result, F.greatest(own, behind)).otherwise(own)

    def error(when: Column, text: str) -> Column:
        return F.when(F.coalesce(when, F.lit(False)), F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))

    errors = F.concat(
        F.coalesce("errors", F.array().cast("array<string>")),
        error(is_call & known & ~primary, "the identifier is used before"),
        error(primary & (F.col("missing") > 0), "a referenced call is missing"),
        error(primary & ~F.col("settled"), "the call depends on itself"),
        error(is_result & F.col("call_id").isNotNull() & ~known, "the result has no call"),
    )
    linked = F.when(is_call, F.coalesce(primary & F.col("answered"), F.lit(False))).when(is_result, known)
    return found.select(
        "conv_id",
        "turn",
        "part",
        "kind",
        "call_id",
        "name",
        linked.alias("linked"),
        F.when(is_call, F.size("errors") == 0).alias("valid"),
        errors.alias("errors"),
        at["turn"].alias("order_turn"),
        at["part"].alias("order_part"),
        at["depth"].alias("order_depth"),
        "json",
    )


# The tools that ``as_tool_messages`` calls.
DIALOGUE_SCHEMAS = {
    "reply": {
        "type": "object",
        "required": ["text", "turn"],
        "additionalProperties": False,
        "properties": {
            "text": {"type": "string", "minLength": 1},
            "turn": {"type": "integer", "minimum": 0},
            "after": {"type": "object", "required": ["$ref"]},
        },
    }
}


def as_tool_messages(conversations: DataFrame) -> DataFrame:
    """A plain dialogue as a tool trace: a user's turn calls ``reply``, the answer is its result.

    The answer carries the identifier of the turn right before it, and a call refers to the
    call two turns before.  Turns of other roles stay messages, and so do turns that already
    hold a call or a result.
    """
    turn, text = F.col("turn").cast("bigint"), F.col("text")
    ready = F.coalesce((F.col("role") == "tool") | F.get_json_object(text, "$.tool_calls").isNotNull(), F.lit(False))

    def named(shift: int) -> Column:
        return F.concat(F.lit("t"), (turn - shift).cast("string"))

    after = F.when(turn >= 2, F.struct(named(2).alias("$ref")))
    arguments = F.struct(text.alias("text"), turn.alias("turn"), after.alias("after"))
    call = F.to_json(F.struct(F.array(F.struct(named(0).alias("id"), F.lit("reply").alias("name"), arguments.alias("arguments"))).alias("tool_calls")))
    result = F.to_json(F.struct(named(1).alias("tool_call_id"), text.alias("content")))
    asks = (F.col("role") == "user") & ~ready & turn.isNotNull()
    answers = (F.col("role") == "assistant") & ~ready & turn.isNotNull()
    return conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        turn.alias("turn"),
        F.when(asks, "assistant").when(answers, "tool").otherwise(F.col("role")).alias("role"),
        F.when(asks, call).when(answers, result).otherwise(text).alias("text"),
    )
