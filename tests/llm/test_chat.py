import json

import pytest

from plantspark.llm import chat
from plantspark.llm.queries import QUERIES

SCHEMAS = {"add": {"properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": "number"}, "tags": {"type": "array", "items": {"type": "string"}}}, "required": ["a"], "additionalProperties": False}}


def call(*calls):
    return json.dumps({"tool_calls": list(calls)})


def one(i, after=(), **arguments):
    return {"id": i, "name": "add", "arguments": arguments or {"a": 1}, "after": list(after)}


def result(i, content="ok"):
    return json.dumps({"tool_call_id": i, "content": content})


def linked(spark, rows):
    return chat.link_tool_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), SCHEMAS)


def in_order(rows, conv):
    return sorted((r for r in rows if r.conv_id == conv), key=lambda r: (r.order_turn or 0, r.order_depth, r.turn or 0, r.seq))


def test_links_and_problems(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", call(one("x"), one("y", b=2))), (1, 2, "tool", result("x")), (1, 3, "tool", result("x")),
        (1, 4, "tool", result("zz")), (1, 5, "assistant", call(one("x"))), (2, 1, "assistant", call(one("x", ["gone"], a=-1, c=2))), (2, 2, "tool", result("x")),
    ]
    got = linked(spark, rows).collect()
    found = {(r.conv_id, r.turn, r.seq): (r.linked, sorted(r.problems)) for r in got}
    assert found == {
        (1, 0, 0): (False, []),
        (1, 1, 0): (True, []),
        (1, 1, 1): (False, ["arguments.a is missing", "call without result"]),
        (1, 2, 0): (True, []),
        (1, 3, 0): (False, ["repeated result"]),
        (1, 4, 0): (False, ["result without call"]),
        (1, 5, 0): (False, ["repeated call"]),
        (2, 1, 0): (True, ["arguments.a is too small", "arguments.c is unknown", "unknown need"]),
        (2, 2, 0): (True, []),
    }


def test_order_is_topological(spark):
    rows = [(1, 2 * k, "assistant", call(one(f"c{k}", [f"c{k + 1}"] if k < 4 else []))) for k in range(5)] + [(1, 2 * k + 1, "tool", result(f"c{k}")) for k in range(5)]
    rows += [(2, 0, "tool", result("late")), (2, 5, "assistant", call(one("late"))), (3, 0, "assistant", call(one("p", ["q"]), one("q", ["p"]))), (3, 1, "tool", result("p")), (3, 2, "tool", result("q"))]
    got = linked(spark, rows).collect()
    names = [(r.kind, r.call_id) for r in in_order(got, 1)]
    assert names == [(kind, f"c{k}") for k in (4, 3, 2, 1, 0) for kind in ("call", "result")]
    assert [r.kind for r in in_order(got, 2)] == ["call", "result"]
    assert all("needs in a circle" in r.problems for r in got if r.conv_id == 3 and r.kind == "call")
    assert not any("needs in a circle" in r.problems for r in got if r.conv_id != 3)


def test_canonical_json(spark):
    text = '{"tool_calls":[{"id":"i","name":"add","arguments":{"b":1.5,"a":2,"tags":["ä","b"]}}]}'
    r = linked(spark, [(1, 1, "assistant", text)]).first()
    assert r.body == '{"role":"assistant","tool_call":{"arguments":{"a":2,"b":1.5,"tags":["ä","b"]},"id":"i","name":"add"}}'


def test_edges(spark):
    rows = [
        (None, None, None, None), (None, 1, "a", ""), (1, 1, "a", "{not json"), (1, 2, "a", '{"tool_calls": [3, {}]}'), (1, 3, "a", '{"tool_call_id": 5}'),
        (1, 4, "a", '{"tool_calls": []}'), (1, 5, "a", "[" * 100_000), (1, 6, "a", '{"a":' * 100_000), (1, 7, "a", '{"tool_call_id": "\\ud800"}'),
        (None, 2, "a", call(one("n"))), (None, 3, "t", result("n")), (None, 3, "t", result("n")), (4, 1, "a", call(one("r"), one("r"))),
    ]
    got = linked(spark, rows).collect()
    assert len(got) == len(rows) - 1 + 1 + 1
    assert sum(r.linked for r in got) >= 2
    assert linked(spark, []).count() == 0


def test_validation():
    bad = {"a": True, "b": "x", "tags": ["t", 1]}
    assert chat.violations(bad, {"type": "object", **SCHEMAS["add"]}) == ["arguments.a is no integer", "arguments.b is no number", "arguments.tags[1] is no string"]
    assert chat.violations(5, {"enum": [1, 2]}) == ["arguments is none of the values"]


def test_query_keeps_every_turn(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["op4_chat_format"](spark, sf).collect()
    table = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    assert len(got) == len(table)
    turns = {(r.conv_id, r.turn): r.role for r in table}
    for r in got:
        call_turn = r.turn - (r.kind == "result")
        both = turns.get((r.conv_id, call_turn)) == "user" and turns.get((r.conv_id, call_turn + 1)) == "assistant"
        assert r.linked == (r.kind != "message" and both)
        json.loads(r.body)


def test_numbers_that_json_lacks_and_deep_nesting():
    call = '{"tool_calls": [{"id": "c", "name": "t", "arguments": {"a": NaN, "b": 1e999, "c": [-Infinity, 1.5]}}]}'
    kind, call_id, _, body, problems = next(chat.events_of("assistant", call, {"t": {"properties": {"a": {"type": "number"}}}}))
    said = json.loads(body, parse_constant=lambda x: pytest.fail(x))
    assert (kind, call_id) == ("call", "c") and said["tool_call"]["arguments"] == {"a": None, "b": None, "c": [None, 1.5]}
    assert problems == [chat.LACKS, "arguments.a is no number"]
    text = json.dumps({"tool_calls": [{"id": "c", "name": "t", "arguments": '{"x": Infinity}'}]})
    assert next(chat.events_of("assistant", text, {"t": {}}))[4] == [chat.LACKS]
    result = next(chat.events_of("tool", '{"tool_call_id": "c", "content": NaN}', {}))
    assert result[3:] == ('{"content":null,"role":"tool","tool_call_id":"c"}', [chat.LACKS])
    for depth in (500, 5_000, 200_000):
        deep = '{"tool_calls": [{"id": "c", "name": "t", "arguments": ' + '{"a":' * depth + "1" + "}" * depth + "}]}"
        kind, _, _, body, problems = next(chat.events_of("assistant", deep, {"t": {}}))
        assert json.loads(body)["role"] == "assistant" if kind == "message" or depth < 1000 else body
        assert (kind == "call" and (not problems or problems == [chat.DEEP])) or (kind == "message" and problems == [chat.DEEP])
    assert next(chat.events_of("user", '{"x": NaN}', {}))[0::4] == ("message", [])
