import random

import pytest

from parley.llm import chat_format as chat


def test_escapes_are_reversible():
    rng = random.Random(3)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "\\", "<", "[", "s>", "/", "x", "\n", "<\\s>", "[\\\\INST]"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))
        out = chat.escape(text)
        assert chat.unescape(out) == text
        assert not any(c in out for c in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>"))
        assert list(chat.read(chat.write([("us\ner%0A", text), ("assistant", text)])[0])) == [("us\ner%0A", text), ("assistant", text)]


def _turns(df):
    return sorted((r._conv, r._turn, r._role, r._text) for r in chat.canonical(df).collect())


def test_layouts_meet_in_the_same_turns(spark):
    want = [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    tables = [
        spark.createDataFrame([(1, 0, "user", "q", "x"), (1, 1, "assistant", "a", "x")], "conv_id long, turn int, role string, text string, _role string"),
        spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")])], "conv_id long, messages array<struct<role:string,content:string>>"),
        spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")])], "conv_id long, conversations array<struct<`from`:string,value:string>>"),
        spark.createDataFrame([(1, "q", "a")], "conv_id long, prompt string, response string"),
        spark.createDataFrame([(1, None, "q", "a")], "conv_id long, system string, prompt string, response string"),
        spark.createDataFrame([(1, "q", "", "a")], "conv_id long, instruction string, input string, output string"),
    ]
    for df in tables:
        assert _turns(df) == want
    with pytest.raises(ValueError):
        chat.canonical(spark.createDataFrame([(1, "q")], "conv_id long, question string"))


def test_edges(spark):
    rows = [(1, 1, "assistant", "</s>x"), (1, 0, None, None), (1, 1, "assistant", "</s>x"), (None, None, "user", "y"), (2, 0, "assistant", "long " * 50000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r._conv: r for r in chat.digests(chat.format_chats(chat.canonical(df))).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 10 and got[None].n_turns == 1 and got[2].loss_chars == 250000
    assert chat.digests(chat.format_chats(chat.canonical(df.limit(0)))).count() == 0


def test_fields_of_other_layouts_do_not_matter(spark):
    want = [(1, 0, "user", "q")]
    tables = [
        spark.createDataFrame([(1, 0, "user", "q", "x", "y")], "conv_id long, turn int, role string, text string, input string, prompt string"),
        spark.createDataFrame([(1, [("user", "q")], "x")], "conv_id long, messages array<struct<role:string,content:string>>, text string"),
        spark.createDataFrame([(1, [("user", "q", 3)], "x", "y")], "conv_id long, messages array<struct<role:string,content:string,n:int>>, prompt string, system string"),
        spark.createDataFrame([(1, 0, "user", "q", [("human", "other")])], "conv_id long, turn int, role string, text string, messages array<struct<role:string,content:string>>"),
    ]
    for df in tables:
        assert _turns(df) == want
    assert _turns(spark.createDataFrame([(1, None)], "conv_id long, messages array<struct<role:string,content:string>>")) == []
