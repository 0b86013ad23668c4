"""Chat formatting with tool calls."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quarrylens.llm.tool_calls import DIALOGUE_SCHEMAS, as_tool_messages, canonical, link_tool_calls, schema_errors

SCHEMAS = {
    "add": {
        "type": "object",
        "required": ["a"],
        "additionalProperties": False,
        "properties": {"a": {"type": "integer", "minimum": 0, "maximum": 9}, "b": {"type": ["string", "null"], "maxLength": 3}, "in": {}},
    },
    "any": {},
}
MESSAGES = "conv_id bigint, turn bigint, role string, text string"


def call(*calls, content=None):
    return json.dumps({"content": content, "tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})


def result(call_id, content="ok"):
    return json.dumps({"tool_call_id": call_id, "content": content})


def test_canonical():
    assert canonical({"b": 1, "a": [1.0, 1.5, None, True], "é": "ü\n"}) == '{"a":[1,1.5,null,true],"b":1,"é":"ü\\n"}'
    assert canonical({"": 1, "\U0001f600": 2}) == '{"\U0001f600":2,"":1}'
    assert canonical(json.loads('{"b":{"y":2,"x":1e2}}')) == '{"b":{"x":100,"y":2}}'


@pytest.mark.parametrize(
    ("value", "errors"),
    [
        ({"a": 3}, 0),
        ({"a": 3, "b": None}, 0),
        ({"a": True}, 1),
        ({"a": 10}, 1),
        ({"b": "long"}, 2),
        ({"a": 1, "c": 2}, 1),
        ([], 1),
    ],
)
def test_schema(value, errors):
    assert len(list(schema_errors(value, SCHEMAS["add"]))) == errors


def linked(spark, rows):
    found = link_tool_calls(spark.createDataFrame(rows, MESSAGES).withColumn("kind", F.lit("x")), SCHEMAS, rounds=6)
    return sorted(found.collect(), key=lambda r: (r.conv_id or -1, r.order_turn, r.order_part, r.order_depth))


def test_links_orders_and_errors(spark):
    rows = [
        (1, 0, "user", "hello"),
        (1, 1, "assistant", call(("x", "add", {"a": 1}), ("y", "add", {"a": 1, "in": {"$ref": "z"}}), content="wait")),
        (1, 2, "tool", result("x")),
        (1, 3, "assistant", call(("z", "any", {"in": {"$ref": ["x", "gone"]}}))),
        (1, 4, "tool", result("y")),
        (1, 5, "tool", result("z")),
        (1, 6, "tool", result("none")),
        (1, 7, "assistant", call(("x", "add", {"a": 1}))),
        (2, 0, "tool", result("early")),
        (2, 1, "assistant", call(("early", "nothing", {}))),
        (2, 2, "assistant", call(("p", "any", {"$ref": "q"}), ("q", "any", {"$ref": "p"}))),
        (2, 3, "assistant", '{"tool_calls": "no list"}'),
        (2, 4, "assistant", "{broken"),
        (None, 0, "tool", result("x")),
        (3, None, None, None),
    ]
    got = linked(spark, rows)
    assert len(got) == 18
    one = [(r.kind, r.call_id) for r in got if r.conv_id == 1]
    place = {x: i for i, x in reversed(list(enumerate(one)))}
    assert place[("call", "z")] < place[("call", "y")] < place[("result", "y")]
    assert place[("call", "z")] < place[("result", "z")] and place[("call", "x")] < place[("result", "x")]
    by = {(r.conv_id, r.turn, r.kind, r.call_id): r for r in got}
    assert by[1, 1, "call", "x"].linked and by[1, 1, "call", "x"].valid
    assert by[1, 3, "call", "z"].errors == ["a referenced call is missing"]
    assert by[1, 6, "result", "none"].errors == ["the result has no call"] and not by[1, 6, "result", "none"].linked
    assert by[1, 7, "call", "x"].errors == ["the identifier is used before"] and not by[1, 7, "call", "x"].linked
    early, its_call = by[2, 0, "result", "early"], by[2, 1, "call", "early"]
    assert (early.order_turn, early.order_part, early.order_depth) > (its_call.order_turn, its_call.order_part, its_call.order_depth)
    assert its_call.errors == ["the tool is unknown"] and not its_call.valid
    assert by[2, 2, "call", "p"].errors == by[2, 2, "call", "q"].errors == ["the call depends on itself"]
    assert by[2, 4, "message", None].json == '{"content":"{broken","role":"assistant","type":"message"}'
    assert not by[None, 0, "result", "x"].linked
    for r in got:
        assert canonical(json.loads(r.json)) == r.json


def test_chains_of_forward_references(spark):
    n = 5
    rows = [(1, i, "assistant", call((f"c{i}", "any", {"$ref": f"c{i + 1}"}))) for i in range(n)]
    rows += [(2, i, "assistant", call((f"c{i}", "any", {"$ref": f"c{i - 1}"} if i else {}))) for i in range(n)]
    got = linked(spark, rows)
    assert [r.call_id for r in got if r.conv_id == 1] == [f"c{i}" for i in reversed(range(n))]
    assert [r.call_id for r in got if r.conv_id == 2] == [f"c{i}" for i in range(n)]
    assert [r.order_depth for r in got if r.conv_id == 2] == [0] * n


def test_dialogues(spark):
    rows = [(1, 0, "system", "be good"), (1, 1, "user", 'say "hé"\n'), (1, 2, "assistant", "yes"), (1, 3, "user", ""), (1, 3, "user", ""), (2, 0, "assistant", "hm"), (2, 1, "user", None)]
    frame = spark.createDataFrame(rows, MESSAGES)
    got = link_tool_calls(as_tool_messages(frame), DIALOGUE_SCHEMAS).collect()
    by = {(r.conv_id, r.turn): r for r in got}
    assert len(got) == len(rows)
    assert json.loads(by[1, 1].json)["arguments"] == {"text": 'say "hé"\n', "turn": 1}
    assert by[1, 2].linked and by[1, 1].linked and by[1, 1].valid
    assert json.loads(by[1, 3].json)["arguments"]["after"] == {"$ref": "t1"} and not by[1, 3].valid
    assert by[2, 0].errors == ["the result has no call"] and not by[2, 1].valid
    assert link_tool_calls(as_tool_messages(frame.limit(0)), DIALOGUE_SCHEMAS).count() == 0


def test_long_chains_beside_cycles(spark):
    rng = random.Random(3)
    refs = {}
    for i in range(60):
        refs[1, i] = [i + 1] if i < 59 else []
    for i in range(15):
        refs[2, i] = [i + 1] if i < 14 else []
    # On a cycle, behind it, referring back to it, and beside it.
    refs.update({(3, 0): [1], (3, 1): [2], (3, 2): [1, 3], (3, 3): [4], (3, 4): [], (3, 5): [2], (4, 0): [1], (4, 1): [2], (4, 2): [1], (4, 3): [2], (4, 4): [4]})
    for c in range(5, 11):
        for i in range(14):
            refs[c, i] = sorted({rng.randrange(14) for _ in range(rng.choice([0, 1, 1, 2]))} - ({i} if c < 9 else set()))
    want = {}
    for c, i in refs:
        place = {k: (k[1], 0) for k in refs if k[0] == c}
        for _ in range(300):
            place = {k: max([(k[1], 0)] + [(place[c, r][0], place[c, r][1] + 1) for r in refs[k]]) for k in place}
        want[c, i] = place[c, i] if place[c, i][1] < 200 else None
    rows = [(c, i, "assistant", call((f"c{i}", "any", {"$ref": [f"c{r}" for r in refs[c, i]]}))) for c, i in refs]
    found = link_tool_calls(spark.createDataFrame(rows, MESSAGES), SCHEMAS).collect()
    assert {(r.conv_id, r.turn) for r in found if "the call depends on itself" in r.errors} == {k for k, v in want.items() if v is None}
    assert {(r.conv_id, r.turn): (r.order_turn, r.order_depth) for r in found if not r.errors} == {k: v for k, v in want.items() if v}
    assert want[1, 0] == (59, 59) and want[3, 5] == (5, 0) and want[4, 0] is want[4, 1] is want[4, 4] is None and want[4, 3] == (3, 0)
