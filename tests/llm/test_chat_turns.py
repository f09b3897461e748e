"""Rows of one turn keep their own calls."""

import json

from squall.llm import chat_format

SCHEMA = "conv_id long, turn long, role string, text string"


def call(**fields):
    return f"<tool_call>{json.dumps(fields)}</tool_call>"


def formatted(spark, rows):
    got = chat_format.format_chat(spark, spark.createDataFrame(rows, SCHEMA)).collect()
    return sorted((r.conv_id or -1, r.turn if r.turn is not None else -1, r.role, r.n_calls, r.n_linked, r.top_level, tuple(c.get("id") for c in json.loads(r.message).get("tool_calls", []))) for r in got)


def test_rows_of_one_turn(spark):
    a, b = call(id="a", name="search", arguments={"query": "x"}), call(id="b", name="search", arguments={"query": {"$result": "a"}})
    rows = [
        (1, 4, "assistant", f"one {a}"), (1, 4, "user", "hi"), (1, 4, "assistant", f"two {b}"), (1, 4, "assistant", f"two {b}"), (1, 4, "assistant", f"both {b} {a}"),
        (1, 5, "tool", json.dumps({"tool_call_id": "a", "content": "done"})), (None, None, "assistant", a), (None, None, "user", "hi"), (1, None, "assistant", a),
    ]
    got = formatted(spark, rows)
    assert [x[3:] for x in got if x[:3] == (1, 4, "assistant")] == sorted([(1, 0, 1, ("b",)), (1, 0, 1, ("b",)), (1, 1, 0, ("a",)), (2, 1, 1, ("a", "b"))])
    assert [x[3] for x in got if x[2] == "user"] == [0, 0] and (-1, -1, "assistant", 1, 0, 0, ("a",)) in got and (1, -1, "assistant", 1, 1, 0, ("a",)) in got and len(got) == len(rows)
