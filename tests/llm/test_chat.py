import json
import random

import pytest

from dispatchlens.llm import chat

EVENTS = "conv_id long, turn long, role string, text string, call_id string, tool string, arguments string, after array<string>, conv string, pos long"


@pytest.fixture
def run(spark):
    def make(rows, schemas=(("f", "x", "string", True), ("f", "y", "integer", False), ("f", "n", "number", False), ("f", "z", "array", None))):
        events = spark.createDataFrame([(*r, "c", 1) for r in rows], EVENTS)
        out = chat.format_chat(events, spark.createDataFrame(list(schemas), "tool string, param string, type string, required boolean"))
        return sorted(out.collect(), key=lambda r: (r.conv_id or -1, r.position))

    return make


def call(conv, turn, i, after=(), tool="f", args='{"x":"s"}'):
    return (conv, turn, "assistant", None, i, tool, args, list(after))


def result(conv, turn, i, text="r"):
    return (conv, turn, "tool", text, i, None, None, None)


def order(rows):
    return [(r.kind[0], r.call_id) for r in rows]


def test_order_keeps_turns_unless_something_must_come_first(run):
    rows = [call(1, 1, "a", ["b"]), result(1, 2, "a"), call(1, 3, "b"), result(1, 4, "b"), (1, 0, "user", "hi", None, None, None, None), (1, 5, "user", "end", None, None, None, None)]
    out = run(rows)
    assert order(out) == [("m", None), ("c", "b"), ("r", "b"), ("c", "a"), ("r", "a"), ("m", None)]
    assert [r.position for r in out] == list(range(6))
    assert {r.status for r in out} == {None, "linked"}


def test_random_dependencies_are_topological(run):
    rnd = random.Random(1)
    rows, needs = [], {}
    for conv in range(6):
        n = 9
        turns = rnd.sample(range(1000), 2 * n)
        for k in range(n):
            after = [f"k{j}" for j in range(k) if rnd.random() < 0.3]
            needs[conv, k] = after
            rows += [call(conv, turns[k], f"k{k}", after), result(conv, turns[n + k], f"k{k}")]
    rnd.shuffle(rows)
    out = run(rows)
    at = {(r.conv_id, r.kind, r.call_id): r.position for r in out}
    for (conv, k), after in needs.items():
        assert at[conv, "call", f"k{k}"] < at[conv, "result", f"k{k}"]
        assert all(at[conv, "result", a] < at[conv, "call", f"k{k}"] for a in after)
    assert all(sorted(r.position for r in out if r.conv_id == c) == list(range(18)) for c in range(6))


def test_statuses(run):
    rows = [call(1, 0, "a"), call(1, 1, "a"), result(1, 2, "a"), result(1, 3, "a"), result(1, 4, "q"), call(1, 5, "u"), call(1, 6, None), result(1, 7, None)]
    assert [r.status for r in run(rows)] == ["linked", "duplicate", "linked", "duplicate", "orphan", "unanswered", "unanswered", "orphan"]
    rows = [call(2, 0, "p", ["q"]), call(2, 1, "q", ["p"]), result(2, 2, "p"), call(2, 3, "s"), result(2, 4, "s")]
    out = run(rows)
    assert sorted((r.kind, r.call_id) for r in out if r.status == "cycle") == [("call", "p"), ("call", "q"), ("result", "p")]
    assert [r.position for r in out] == list(range(5))


@pytest.mark.parametrize(
    ("args", "wrong"),
    [
        ('{"x": "a", "y": 1, "n": 2, "z": [1]}', ""),
        ('{"x": "a", "y": 1.0, "n": 0.5}', ""),
        ('{"y": 1.5, "w": null}', "w: unknown; x: missing; y: not integer"),
        ('{"x": 5, "z": {}}', "x: not string; z: not array"),
        ("[1]", "arguments: not a JSON object"),
        ('{"x":', "arguments: not a JSON object"),
        (None, "arguments: not a JSON object"),
    ],
)
def test_arguments(run, args, wrong):
    assert run([call(1, 0, "a", args=args)])[0].errors == wrong


def test_unknown_tool_and_no_schemas(run):
    assert run([call(1, 0, "a", tool="g")])[0].errors == "g: unknown tool"


def test_json_is_canonical(run):
    (row,) = run([call(1, 0, "a", args='{ "y": 2, "x":"\\u00e9\\n\\"", "z":[{"q":1,"p":[true,null]}]}')])
    want = {"arguments": json.loads('{"y": 2, "x":"\\u00e9\\n\\"", "z":[{"q":1,"p":[true,null]}]}'), "call_id": "a", "role": "assistant", "tool": "f"}
    assert row.json == json.dumps(want, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_nulls_repeats_and_empty(run):
    same = (None, 0, "user", "same", None, None, None, None)
    out = run([same, same, (None, None, None, None, None, None, None, None), (3, 2**40, "user", "x" * 100_000, None, None, None, None)])
    assert [(r.conv_id, r.turn, r.position) for r in out] == [(None, None, 0), (None, 0, 1), (None, 0, 2), (3, 2**40, 0)]
    assert run([]) == []


def test_no_python_in_the_plan(spark, run):
    events = spark.createDataFrame([(*call(1, 0, "a"), "c", 1)], EVENTS)
    plan = chat.format_chat(events, spark.createDataFrame([], "tool string, param string, type string, required boolean"))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct"))
