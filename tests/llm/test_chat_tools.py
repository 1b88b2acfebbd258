import json
import random

import pytest

from cases import frame, same_as_sql
from waymark.llm import chat_tools, queries

CALLS = "conv_id long, call_id string, turn long, tool string, arguments string, needs array<string>, text string"
RESULTS = "conv_id long, call_id string, turn long, content string, kind string"
SCHEMAS = "tool string, name string, type string, required boolean"
TOOLS = [("add", "a", "BIGINT", True), ("add", "b", "BIGINT", True), ("add", "note", "STRING", False)]


def linked(spark, calls, results, tools=TOOLS):
    out = chat_tools.link_calls(frame(spark, calls, CALLS), frame(spark, results, RESULTS), frame(spark, tools, SCHEMAS))
    return {(r["conv_id"], r["call_id"], r["kind"], r["status"]): r for r in out.collect()}


def test_links_orders_and_validates(spark):
    calls = [
        (1, "x", 0, "add", '{"b": 2, "a": 1}', [], None),
        (1, "y", 2, "add", '{"a": 1}', ["x"], None),
        (1, "z", 4, "add", '{"a": "1", "b": 2, "c": 3}', ["y", "x", "gone"], None),
        (1, "w", 6, "else", '{"a": 1}', None, None),
        (1, "v", 7, "add", "[1]", None, None),
        (1, "u", 8, "add", "{broken", None, None),
        (1, "t", 9, "add", None, None, None),
        (1, "s", 9, "add", '{"a":1,"b":2,"note":null}', None, None),
    ]
    results = [(1, "x", 1, "3", "r"), (1, "q", 5, "lost", "r")]
    got = linked(spark, calls, results)
    assert got[1, "x", "call", "linked"]["level"] == 0
    assert got[1, "x", "result", "linked"]["json"] == '{"content":"3","id":"x","kind":"result"}'
    assert got[1, "x", "call", "linked"]["json"] == '{"arguments":{"a":1,"b":2},"id":"x","kind":"call","tool":"add"}'
    assert got[1, "y", "call", "unanswered"]["level"] == 1
    assert got[1, "y", "call", "unanswered"]["errors"] == ["missing b"]
    assert got[1, "z", "call", "unanswered"]["level"] == 2
    assert got[1, "z", "call", "unanswered"]["errors"] == ["type of a", "unexpected c"]
    assert got[1, "w", "call", "unanswered"]["errors"] == ["unknown tool"]
    for k in "vut":
        assert got[1, k, "call", "unanswered"]["errors"] == ["arguments are no object"]
    assert got[1, "s", "call", "unanswered"]["errors"] == []
    assert got[1, "q", "result", "orphan"]["level"] == 0
    assert len(got) == len(calls) + len(results)


def test_cycles_duplicates_and_nulls(spark):
    calls = [
        (1, "a", 0, "add", "{}", ["b"], None),
        (1, "b", 1, "add", "{}", ["a"], None),
        (1, "c", 2, "add", "{}", ["a"], None),
        (2, "a", 5, "add", "{}", [], None),
        (2, "a", 5, "add", "{}", [], None),
        (2, "a", 3, "add", "{}", [], None),
        (None, "a", 0, "add", "{}", [], None),
        (3, None, 0, "add", "{}", [], None),
    ]
    out = chat_tools.link_calls(frame(spark, calls, CALLS), frame(spark, [(2, "a", 6, None, "r")], RESULTS), frame(spark, TOOLS, SCHEMAS)).collect()
    by = sorted((r["conv_id"], r["call_id"], r["kind"], r["status"], r["turn"]) for r in out)
    assert by == [
        (1, "a", "call", "cyclic", 0),
        (1, "b", "call", "cyclic", 1),
        (1, "c", "call", "cyclic", 2),
        (2, "a", "call", "duplicate", 5),
        (2, "a", "call", "duplicate", 5),
        (2, "a", "call", "linked", 3),
        (2, "a", "result", "linked", 6),
    ]


def test_empty_tables(spark):
    assert linked(spark, [], []) == {}
    assert len(linked(spark, [], [(1, "a", 1, "x", "r")])) == 1


def test_deep_chain_is_ordered(spark):
    n = 12
    calls = [(7, f"k{i}", i, "add", "{}", [f"k{i - 1}"] if i else [], None) for i in range(n)]
    random.Random(1).shuffle(calls)
    got = linked(spark, calls, [])
    assert {int(k[1][1:]): r["level"] for k, r in got.items()} == {i: i for i in range(n)}


@pytest.mark.parametrize("text", ["plain", 'quote " and \\ and \n', "Ünïcode ☃", ""])
def test_json_is_canonical(spark, text):
    got = linked(spark, [(1, "x", 0, "add", json.dumps({"note": text, "b": 1, "a": {"z": [1, None], "y": True}}), [], None)], [])
    out = next(iter(got.values()))["json"]
    assert json.loads(out)["arguments"] == {"note": text, "b": 1, "a": {"z": [1, None], "y": True}}
    assert list(json.loads(out)["arguments"]) == ["a", "b", "note"]
    assert list(json.loads(out)["arguments"]["a"]) == ["y", "z"]


def test_query_matches_sql(spark):
    got, want = same_as_sql(spark, "op1_chat_tools")
    assert got == want
    assert queries.op1_chat_tools.__doc__


def levels(needs):
    """By brute force; None in a cycle or behind one."""
    out, changed = {}, True
    while changed:
        changed = False
        for k, want in needs.items():
            inner = [w for w in want if w in needs]
            if k not in out and all(w in out for w in inner):
                out[k], changed = max([out[w] + 1 for w in inner], default=0), True
    return {k: out.get(k) for k in needs}


@pytest.mark.parametrize("seed", range(3))
def test_random_needs(spark, seed):
    rng = random.Random(seed)
    needs = {f"k{i}": [f"k{rng.randrange(max(0, i - 6), i + (rng.random() < 0.03) * 3 + 1)}" if i and rng.random() < 0.9 else "gone" for _ in range(rng.choice([0, 1, 1, 1, 1, 2, 3]))] for i in range(120)}
    needs = {k: [w for w in v if w != k] for k, v in needs.items()}
    needs |= {f"c{i}": [f"c{i - 1}"] if i else [] for i in range(100)}
    df = spark.createDataFrame([(1, k, v) for k, v in needs.items()], "conv_id long, call_id string, needs array<string>")
    assert {r["call_id"]: r["level"] for r in chat_tools.topological_levels(df).collect()} == levels(needs)


def test_long_texts_and_null_turns(spark):
    long = json.dumps({"a": 1, "b": 2, "note": "x" * 2_000_000})
    got = linked(spark, [(1, "x", None, "add", long, [], None), (1, "y", None, None, "{}", ["x"], None)], [(1, "x", None, "y" * 2_000_000, "r"), (1, "y", None, None, "r")])
    assert len(got[1, "x", "call", "linked"]["json"]) > 2_000_000 and len(got[1, "x", "result", "linked"]["json"]) > 2_000_000
    assert got[1, "y", "call", "linked"]["level"] == 1 and json.loads(got[1, "y", "result", "linked"]["json"])["content"] is None


def test_other_columns_may_have_any_name(spark):
    calls = spark.createDataFrame([(1, "x", 0, "add", "{}", ["y"], 1, 2, 3), (1, "y", 0, "add", "{}", [], 1, 2, 3)], CALLS.replace("text string", "level int, floor int, r int"))
    out = chat_tools.link_calls(calls, frame(spark, [], RESULTS), frame(spark, TOOLS, SCHEMAS)).collect()
    assert {r["call_id"]: r["level"] for r in out} == {"x": 1, "y": 0}


def test_calls_are_not_dealt_by_tool(spark, monkeypatch):
    """A tool that most calls name is no task of its own, be the schemas few or many."""
    import re

    plan = lambda: queries.op1_chat_tools(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"BroadcastHashJoin \[tool#\d+\]", plan())
    monkeypatch.setattr(chat_tools, "SCHEMA_ROWS", 0)
    assert re.search(r"HashJoin \[tool#\d+, _share#\d+L?\]", plan()) and not re.search(r"Join \[tool#\d+\]", plan())
    got, want = same_as_sql(spark, "op1_chat_tools")
    assert got == want
