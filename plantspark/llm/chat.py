"""Chat formatting: tool calls and results are linked, put in order, validated and written as canonical JSON."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantspark.llm.common import columns, cut

#: The JSON types that a schema may name, and the Python types they are read as.
TYPES = {"string": (str,), "integer": (int,), "number": (int, float), "boolean": (bool,), "array": (list,), "object": (dict,), "null": (type(None),)}


def _sound(text: str) -> bool:
    """Whether a text can be written as UTF-8."""
    try:
        text.encode()
    except UnicodeEncodeError:
        return False
    return True


class _NoNumber:
    """What stands for NaN, the infinities and numbers beyond a double, which JSON cannot write."""


NO_NUMBER = _NoNumber()
LACKS, DEEP = "number that JSON lacks", "nested too deeply"


def canonical(value: object) -> str:
    """JSON with sorted keys, no blanks, and non-ASCII characters as they are; null for ``NO_NUMBER``."""

    def write(ascii_only: bool) -> str:
        return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only, allow_nan=False, default=lambda _: None)

    text = write(False)
    return text if _sound(text) else write(True)  # escapes half surrogates


def violations(value: object, schema: Mapping, at: str = "arguments") -> list[str]:
    """What in ``value`` breaks a JSON schema of type, enum, minimum, maximum, properties, required, additionalProperties and items."""
    kind = schema.get("type")
    if kind and (not isinstance(value, TYPES[kind]) or isinstance(value, bool) and kind in ("integer", "number")):
        return [f"{at} is no {kind}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at} is none of the values")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{at} is too small"] * ("minimum" in schema and value < schema["minimum"])
        out += [f"{at} is too large"] * ("maximum" in schema and value > schema["maximum"])
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k} is missing" for k in schema.get("required", ()) if k not in value]
        for k in sorted(value):
            if not _sound(k):
                out.append(f"{at} has a name that is no text")
            elif k in known:
                out += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k} is unknown")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += violations(v, schema["items"], f"{at}[{i}]")
    return out


def _read(text: str | None) -> tuple[object, list[str]]:
    """The JSON object that a text is, else None, and what is wrong with it."""
    lacking: list[str] = []

    def none(_: str) -> _NoNumber:
        lacking.append(LACKS)
        return NO_NUMBER

    def real(digits: str) -> object:
        x = float(digits)
        return x if math.isfinite(x) else none(digits)

    if not text or text.lstrip()[:1] != "{":
        return None, []
    try:
        return json.loads(text, parse_constant=none, parse_float=real), lacking[:1]
    except RecursionError:
        return None, [DEEP]
    except ValueError:
        return None, []


def _name(x: object) -> str | None:
    return x if isinstance(x, str) and _sound(x) else None


def events_of(role: str | None, text: str | None, schemas: Mapping[str, Mapping]) -> Iterator[tuple]:
    """``kind, call_id, after, body, problems`` of each event of a message.

    A message whose text is an object with a list ``tool_calls`` is a call for each (``id``, ``name``, ``arguments``
    as object or JSON text, ``after``: identifiers it needs), one with a ``tool_call_id`` is a result, any other a message.
    Numbers that JSON lacks are written as null, and are a problem of each event of their message; so is an object
    nested deeper than Python reads, which is no call then: as a message, its text stays whole.
    """
    said, wrong = _read(text)
    if isinstance(said, dict) and isinstance(said.get("tool_calls"), list):
        for call in said["tool_calls"]:
            problems = list(wrong)
            call = call if isinstance(call, dict) else {}
            arguments = call.get("arguments")
            if isinstance(arguments, str):
                arguments, inner = _read(arguments)
                problems += [x for x in inner if x not in problems]
            call_id, name = _name(call.get("id")), _name(call.get("name"))
            if call_id is None:
                problems.append("call without id")
            if name not in schemas:
                problems.append("unknown tool")
            else:
                problems += violations(arguments, {"type": "object", **schemas[name]})
            after = [x for x in call.get("after", ()) if _name(x)] if isinstance(call.get("after"), list) else []
            body = {"role": role, "tool_call": {"id": call_id, "name": name, "arguments": arguments}}
            try:
                written = canonical(body)
            except RecursionError:
                body["tool_call"]["arguments"] = None
                written, problems = canonical(body), [*problems, DEEP]
            yield "call", call_id, after, written, problems
    elif isinstance(said, dict) and "tool_call_id" in said:
        call_id = _name(said["tool_call_id"])
        problems = [*wrong, *([] if call_id else ["result without id"])]
        body = {"role": role, "tool_call_id": call_id, "content": said.get("content")}
        try:
            written = canonical(body)
        except RecursionError:
            written, problems = canonical(body | {"content": None}), [*problems, DEEP]
        yield "result", call_id, [], written, problems
    else:
        yield "message", None, [], canonical({"role": role, "content": text}), wrong if wrong == [DEEP] else []


def events(messages: DataFrame, schemas: Mapping[str, Mapping]) -> DataFrame:
    m = columns(messages, "conv_id", "turn", "role", "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (r, i, *event)
                for r, (role, text) in enumerate(zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True))
                for i, event in enumerate(events_of(role, text, schemas))
            ]
            at, seq, kind, call_id, after, body, problems = zip(*rows, strict=True) if rows else ((),) * 7
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id").take(at),
                    batch.column("turn").take(at),
                    pa.array(seq, pa.int64()),
                    *(pa.array(c, pa.string()) for c in (kind, call_id)),
                    pa.array(after, pa.list_(pa.string())),
                    pa.array(body, pa.string()),
                    pa.array(problems, pa.list_(pa.string())),
                ],
                names=["conv_id", "turn", "seq", "kind", "call_id", "after", "body", "problems"],
            )

    words = T.ArrayType(T.StringType())
    schema = T.StructType(
        [m.schema["conv_id"], m.schema["turn"], T.StructField("seq", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("kind", "call_id")), T.StructField("after", words), T.StructField("body", T.StringType()), T.StructField("problems", words)]
    )
    return m.mapInArrow(scan, schema)


def _same(a: str, b: str) -> Column:
    return F.expr(f"{a}.conv_id <=> {b}.conv_id AND {a}.call_id = {b}.call_id")


def _key(turn: str) -> Column:
    return F.struct(F.col(turn).cast("long").alias("turn"), F.lit(0).cast("long").alias("depth"))


def _later(key: Column) -> Column:
    return F.struct(key["turn"].alias("turn"), (key["depth"] + 1).alias("depth"))


def _circles(edges: DataFrame, calls: DataFrame) -> DataFrame:
    """``conv_id, call_id`` of the calls that need each other in a circle, or need one: what is left when calls that need none
    of the others are taken away again and again."""
    some = calls.select("conv_id", "call_id")
    left = edges.alias("e").join(some.alias("c"), _same("e", "c"), "left_semi")
    n = None
    while True:
        left = cut(left.alias("e").join(some.alias("c"), F.expr("e.conv_id <=> c.conv_id AND e.need = c.call_id"), "left_semi"))
        some = left.select("conv_id", "call_id").distinct()
        if (before := n) == (n := left.count()):
            return some


def link_tool_calls(messages: DataFrame, schemas: Mapping[str, Mapping]) -> DataFrame:
    """``conv_id, turn, seq, kind, call_id, order_turn, order_depth, linked, valid, problems, body``: a row for each event.

    Calls and results are hash-joined on conversation and identifier: the first call and the first result of an
    identifier belong together, further ones are problems, and so are a call without a result, a result without
    a call, arguments that break their schema, and needs that are unknown or go round in a circle.
    Reading a conversation by ``order_turn, order_depth, turn, seq`` is a topological order: turns as given, but a result
    follows its call and a call the results it needs. Rows, not conversations, are the unit of work, so a
    conversation may be of any size; rounds go with the longest chain of events that stand too early. What needs a circle
    may count as part of it.
    A null conversation is one, a null turn comes first, a null text is a message without content; rows
    alike are the same event twice. Further columns are ignored.
    """
    e = cut(events(messages, schemas).withColumn("event", F.xxhash64("conv_id", "turn", "seq", "kind", "call_id", "body")))
    named = e.where("call_id IS NOT NULL")
    place = F.struct(F.col("turn").cast("long").alias("turn"), "seq", "event")

    def first(kind: str) -> DataFrame:
        return named.where(F.col("kind") == kind).groupBy("conv_id", "call_id").agg(F.min(place).alias(f"first_{kind}"))

    calls, results = first("call").alias("c"), first("result").alias("r")
    pairs = calls.join(results, _same("c", "r"), "full").select(
        F.coalesce("c.conv_id", "r.conv_id").alias("conv_id"), F.coalesce("c.call_id", "r.call_id").alias("call_id"), "first_call", "first_result"
    )
    pairs = cut(pairs)
    # Whom a linked call waits for: the results it needs.
    wants = named.where("kind = 'call'").select("conv_id", "call_id", "event", F.explode(F.array_distinct("after")).alias("need"))
    wants = wants.alias("w").join(pairs.alias("p"), F.expr("w.conv_id <=> p.conv_id AND w.call_id = p.call_id AND w.event = p.first_call.event"))
    wants = wants.select("w.conv_id", "w.call_id", "w.need")
    known = pairs.where("first_call IS NOT NULL AND first_result IS NOT NULL").select("conv_id", F.col("call_id").alias("need"))
    needs = cut(
        wants.alias("w").join(known.withColumn("met", F.lit(True)).alias("k"), F.expr("w.conv_id <=> k.conv_id AND w.need = k.need"), "left").select("w.conv_id", "w.call_id", "w.need", F.coalesce("met", F.lit(False)).alias("met"))
    )
    edges = needs.where("met").select("conv_id", "call_id", "need")
    keys = pairs.select(
        "conv_id",
        "call_id",
        F.when(F.col("first_call").isNotNull(), _key("first_call.turn")).alias("ck"),
        F.when(F.col("first_result").isNotNull(), _key("first_result.turn")).alias("rk"),
    )
    start = F.when(F.col("rk").isNotNull() & F.col("ck").isNotNull(), F.greatest("rk", _later(F.col("ck")))).otherwise(F.col("rk"))
    keys = cut(keys.withColumn("rk", start).withColumns({"moved": F.lit(True), "active": F.lit(False), "circle": F.lit(False)}))
    rounds, limit = 0, 8
    while edges.take(1) and keys.where("moved").take(1):
        ahead = keys.where("moved").select("conv_id", F.col("call_id").alias("need"), "rk")
        least = edges.alias("e").join(ahead.alias("a"), F.expr("e.conv_id <=> a.conv_id AND e.need = a.need")).groupBy("e.conv_id", "e.call_id").agg(F.max(_later(F.col("rk"))).alias("least"))
        later = F.coalesce((F.col("least") > F.col("ck")) & ~F.col("circle"), F.lit(False))
        now = keys.alias("k").join(least.alias("l"), _same("k", "l"), "left").select(
            "k.conv_id", "k.call_id", F.when(later, F.col("least")).otherwise(F.col("ck")).alias("ck"), "rk", later.alias("moved"), (F.col("active") | later).alias("active"), "circle"
        )
        keys = cut(now.withColumn("rk", F.when(F.col("moved") & F.col("rk").isNotNull(), F.greatest("rk", _later(F.col("ck")))).otherwise(F.col("rk"))))
        rounds += 1
        if rounds == limit:  # what still moves is a long chain or a circle
            limit *= 2
            bad = _circles(edges, keys.where("active")).withColumn("bad", F.lit(True))
            marked = keys.alias("k").join(bad.alias("b"), _same("k", "b"), "left").withColumn("bad", F.coalesce("bad", F.lit(False)))
            keys = cut(marked.select("k.conv_id", "k.call_id", "ck", "rk", (F.col("moved") & ~F.col("bad")).alias("moved"), F.lit(False).alias("active"), (F.col("circle") | F.col("bad")).alias("circle")))
    unmet = needs.where("NOT met").groupBy("conv_id", "call_id").agg(F.count("*").alias("unmet"))
    facts = keys.alias("k").join(pairs.alias("p"), _same("k", "p")).join(unmet.alias("u"), F.expr("k.conv_id <=> u.conv_id AND k.call_id = u.call_id"), "left")
    facts = facts.select("k.conv_id", "k.call_id", "ck", "rk", "circle", "first_call", "first_result", "unmet").alias("f")
    x = e.alias("e").join(facts, _same("e", "f"), "left")
    call, result = F.col("kind") == "call", F.col("kind") == "result"
    first_call = call & (F.col("event") == F.col("first_call.event"))
    first_result = result & (F.col("event") == F.col("first_result.event"))
    both = F.col("first_call").isNotNull() & F.col("first_result").isNotNull()
    own = _key("e.turn")
    key = F.when(first_call, F.coalesce("ck", own)).when(first_result, F.coalesce("rk", own)).otherwise(own)
    found = F.filter(
        F.array(
            F.when(call & F.col("first_call").isNotNull() & ~first_call, F.lit("repeated call")),
            F.when(result & F.col("first_result").isNotNull() & ~first_result, F.lit("repeated result")),
            F.when(first_call & F.col("first_result").isNull(), F.lit("call without result")),
            F.when(first_result & F.col("first_call").isNull(), F.lit("result without call")),
            F.when(first_call & (F.col("unmet") > 0), F.lit("unknown need")),
            F.when(first_call & F.col("circle"), F.lit("needs in a circle")),
        ),
        lambda p: p.isNotNull(),
    )
    problems = F.concat("problems", found)
    return x.select(
        "e.conv_id",
        "e.turn",
        "seq",
        "kind",
        "e.call_id",
        key["turn"].alias("order_turn"),
        key["depth"].alias("order_depth"),
        F.coalesce((first_call | first_result) & both, F.lit(False)).alias("linked"),
        (F.size(problems) == 0).alias("valid"),
        problems.alias("problems"),
        "body",
    )
