"""Heterogeneous layouts: fingerprints of tables and of single rows."""

import json

import pytest

from parley.llm import chat_format

ROWS = [
    (1, {"messages": [{"role": "User", "content": "a"}, {"role": "assistant", "content": None}]}, [("user", "a"), ("assistant", "")]),
    (2, {"messages": [{"role": "user", "content": [{"type": "text", "text": "x"}, {"type": "image", "url": "u"}, {"type": "text", "text": "y"}]}]}, [("user", "xy")]),
    (3, {"messages": [{"role": "user", "content": "plain"}, {"role": "assistant", "content": [{"type": "text", "text": "parts"}]}]}, [("user", "plain"), ("assistant", "parts")]),
    (4, {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}], "id": 7, "meta": {"a": [1, {"b": None}]}}, [("user", "h"), ("assistant", "g")]),
    (5, {"prompt": "p", "response": "r"}, [("user", "p"), ("assistant", "r")]),
    (6, {"system": "s", "prompt": "p", "response": "r"}, [("system", "s"), ("user", "p"), ("assistant", "r")]),
    (7, {"instruction": "i", "input": "", "output": "o"}, [("user", "i"), ("assistant", "o")]),
    (8, {"instruction": "i", "input": "n", "output": "o", "a`b c": 1}, [("user", "i\n\nn"), ("assistant", "o")]),
    (9, {"instruction": "i", "output": "o"}, [("user", "i"), ("assistant", "o")]),
    (10, {"messages": []}, []),
    (11, {"who": "knows"}, []),
    (12, [1, 2], []),
    (5, {"prompt": "p", "response": "r"}, [("user", "p"), ("assistant", "r")]),
]


@pytest.mark.parametrize("variant", [False, True])
def test_rows_of_many_layouts_in_one_column(spark, variant):
    table = spark.createDataFrame([(i, json.dumps(v), "clash") for i, v, _ in ROWS] + [(20, "{oops", "clash"), (21, None, "clash")], "conv_id long, row string, _layout string")
    table = table.selectExpr("conv_id", "try_parse_json(row) as row", "_layout") if variant else table
    got = {}
    for r in chat_format.canonical_rows(table, "row").collect():
        got.setdefault(r._conv, []).append((r._turn, r._role, r._text))
    want = {}
    for i, _, turns in ROWS:
        for t, (role, text) in enumerate(turns):
            want.setdefault(i, []).append((t, role, text))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    layouts = {r._conv: r._layout for r in chat_format.shaped(table, "row").collect()}
    assert layouts[2] == "messages of parts" and layouts[4] == "from and value" and layouts[6].startswith("system")
    assert [layouts[i] for i in (11, 12, 20, 21)] == [None] * 4 and chat_format.canonical_rows(table.limit(0), "row").count() == 0


def test_paths_of_shapes():
    assert chat_format.shape_paths("OBJECT<messages: ARRAY<OBJECT<content: STRING, role: STRING>>, n: OBJECT<a: BIGINT, `b``c: d`: VOID>>") == ["messages[].content", "messages[].role", "n.a", "n.b`c: d"]
    assert chat_format.shape_paths("ARRAY<BIGINT>") == ["[]"] and chat_format.shape_paths("STRING") == [""]


def test_whole_path_sets_select(spark):
    """Each layout's own hash selects it; other fields are looked at only when the whole set is unknown."""
    for m in chat_format.LAYOUTS:
        assert chat_format.mapping_of(m.paths) is m and chat_format.mapping_of([*m.paths, "zz"]) is m
    assert chat_format.mapping_of(["x"]) is None
    parts = spark.createDataFrame([(1, [("user", [("text", "a"), ("text", None)])])], "conv_id long, messages array<struct<role:string,content:array<struct<type:string,text:string>>>>")
    assert [tuple(r) for r in chat_format.canonical(parts).collect()] == [(1, 0, "user", "a")]


def test_a_very_long_conversation_reads_back(spark):
    turns = spark.range(30_000).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('turn </s> ', id) as text")
    row = chat_format.digests(chat_format.format_chats(chat_format.canonical(turns))).first()
    assert row.n_turns == 30_000 and row.loss_chars == sum(len(f"turn </s> {i}") for i in range(1, 30_000, 2))
