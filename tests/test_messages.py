from __future__ import annotations

import json

from answerloom.operators import messages as M

SCHEMA = f"conv_id long, turn long, role string, text string, name string, tool_calls {M.TOOL_CALLS}"


def call(choice):
    return ("id", "route", {"choice": choice})


def test_next_step_every_branch(spark):
    cases = {
        1: [("user", None, None)],
        2: [("user", None, None), ("assistant", "documents", None)],
        3: [("assistant", "documents", [])],
        4: [("assistant", "router", [call("tables")])],
        5: [("assistant", "router", [call("tables"), call("documents")])],
        6: [("assistant", "router", [call("nobody")])],
        7: [("assistant", "documents", [call("x")])],
        8: [("assistant", "documents", [call("x")]), ("tool", None, None)],
        9: [("assistant", "stranger", [call("x")]), ("tool", None, None)],
        10: [("assistant", "router", None), ("user", None, None)],
        11: [("assistant", None, None), ("user", None, None)],
        12: [("assistant", "documents", None), ("assistant", "router", [call("router")])],
        13: [("assistant", None, [call("x")])],
        14: [("assistant", "router", [("id", "route", {})])],
    }
    rows = [
        (conv, turn, role, "", name, calls)
        for conv, messages in cases.items()
        for turn, (role, name, calls) in enumerate(messages)
    ]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r.conv_id: (r.step, r.error) for r in M.next_step(df, ["documents", "tables"]).collect()}
    assert got == {
        1: ("router", None),
        2: ("END", None),
        3: ("END", None),
        4: ("tables", None),
        5: (None, "Too many tools"),
        6: (None, "Unknown choice nobody"),
        7: ("tools", None),
        8: ("documents", None),
        9: ("router", None),
        10: ("router", None),
        11: ("router", None),
        12: ("router", None),
        13: ("tools", None),
        14: (None, "Unknown choice NULL"),
    }


def test_filter_out_routes(spark):
    rows = [
        (1, 0, "assistant", "a", "router", [call("x")]),
        (1, 1, "assistant", "b", "router", []),
        (1, 2, "assistant", "c", "router", None),
        (1, 3, "assistant", "d", "documents", [call("x")]),
        (1, 4, "user", "e", None, None),
    ]
    kept = M.filter_out_routes(spark.createDataFrame(rows, SCHEMA)).orderBy("turn").collect()
    assert [r.text for r in kept] == ["c", "d", "e"]


def test_payload_shapes(spark):
    one = {"role": "user", "content": "hi"}
    payloads = [
        json.dumps({"messages": [one, {"role": "assistant", "content": "yo", "name": "n"}]}),
        json.dumps([one]),
        json.dumps(one),
        json.dumps([{"type": "human", "data": {"content": "hi"}}]),
        json.dumps({"messages": []}),
        json.dumps({"question": "hi"}),
        json.dumps({"role": "user"}),
        json.dumps("hi"),
        json.dumps([1, 2]),
        "42",
        "{broken",
        "",
        None,
    ]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, p string")
    got = {
        r.i: None if r.m is None else [(m.role, m.content, m.name) for m in r.m]
        for r in df.select("i", M.parse_payload("p").alias("m")).collect()
    }
    hi = [("user", "hi", None)]
    assert got[0] == [("user", "hi", None), ("assistant", "yo", "n")]
    assert got[1] == got[2] == got[3] == hi
    assert got[4] == []
    assert all(got[i] is None for i in range(5, 13)), got


def test_last_of_arrays(spark):
    df = spark.createDataFrame(
        [('[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]',), ("[]",)], "p string"
    ).select(M.parse_payload("p").alias("m"))
    got = df.select(
        M.last_of("m").alias("x")["content"], M.last_of("m", M.USER).alias("y")["content"]
    ).collect()
    assert [tuple(r) for r in got] == [("b", "a"), (None, None)]


def test_append_numbers_on_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(M, "TURN_BUCKET", 4)
    history = spark.createDataFrame([(1, 7, "user", "h")], "conv_id long, turn long, role string, text string")
    new = spark.createDataFrame(
        [(1, t, "assistant", f"n{t}") for t in (0, 2, 3, 9, 10, 30)] + [(2, 5, "user", "x")],
        history.schema,
    )
    got = M.append_messages(history, new).orderBy("conv_id", "turn").collect()
    assert [(r.conv_id, r.turn, r.text) for r in got] == [
        (1, 7, "h"), (1, 8, "n0"), (1, 9, "n2"), (1, 10, "n3"), (1, 11, "n9"), (1, 12, "n10"),
        (1, 13, "n30"), (2, 0, "x"),
    ]


def test_conversations_without_messages(spark):
    conversations = spark.createDataFrame([(1,), (2,)], "conv_id long")
    messages = spark.createDataFrame(
        [(1, 0, "user", "q")], "conv_id long, turn long, role string, text string"
    )
    latest = {r.conv_id: r.text for r in M.latest_content(conversations, messages).collect()}
    assert latest == {1: "q", 2: ""}
    first = {r.conv_id: (r.text, r.error) for r in M.first_message(conversations, messages).collect()}
    assert first == {1: ("q", None), 2: (None, "No messages found in payload")}


def test_payload_with_tool_calls_and_no_content(spark):
    call = {"id": "1", "name": "search", "args": "{}"}
    payloads = [
        json.dumps([{"role": "assistant", "content": None, "tool_calls": [call]}]),
        json.dumps([{"type": "ai", "data": {"content": "", "tool_calls": [call]}}]),
        json.dumps([{"role": "assistant", "content": None}]),
    ]
    df = spark.createDataFrame([(p,) for p in payloads], "p string")
    got = [r[0] for r in df.select(M.parse_payload("p")).collect()]
    assert [len(got[0][0].tool_calls), len(got[1][0].tool_calls), got[2]] == [1, 1, None]
