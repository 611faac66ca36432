"""Alignment by bits against the whole matrix, and its memory."""

import tracemalloc
from random import Random

from parley.operators import metrics
from parley.operators.metrics import _common, _edits


def matrix(a, b):
    rows = [list(range(len(b) + 1))]
    for i, w in enumerate(a, 1):
        rows.append([i])
        for j, v in enumerate(b, 1):
            rows[i].append(min(rows[i - 1][j - 1] + (w != v), rows[i][j - 1] + 1, rows[i - 1][j] + 1))
    s = ins = dele = 0
    i, j = len(a), len(b)
    while i or j:
        if i and j and rows[i][j] == rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            s += a[i - 1] != b[j - 1]
            i, j = i - 1, j - 1
        elif j and rows[i][j] == rows[i][j - 1] + 1:
            ins, j = ins + 1, j - 1
        else:
            dele, i = dele + 1, i - 1
    return s, ins, dele


def common(a, b):
    rows = [[0] * (len(b) + 1)]
    for i, w in enumerate(a):
        rows.append([0])
        for j, v in enumerate(b):
            rows[-1].append(rows[i][j] + 1 if w == v else max(rows[i][j + 1], rows[i + 1][j]))
    return rows[-1][-1]


def test_counts_and_ties_are_those_of_the_matrix():
    pick = Random(2)
    for _ in range(1500):
        a, b = ([pick.choice("abc"[: pick.choice((1, 2, 3))]) for _ in range(pick.randrange(0, 40))] for _ in range(2))
        assert _edits(a, b) == matrix(a, b) and _common(a, b) == common(a, b)
    assert _edits([], []) == (0, 0, 0) and _edits(["x"], []) == (0, 0, 1) and _edits([], ["x", "y"]) == (0, 2, 0)


def test_long_texts_in_little_memory():
    pick = Random(3)
    a = [f"w{pick.randrange(3000)}" for _ in range(100_000)]
    b = [w if pick.random() < 0.9 else f"v{i}" for i, w in enumerate(a) if pick.random() < 0.97]
    tracemalloc.start()
    s, ins, dele = _edits(a, b)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    assert len(a) - dele == len(b) - ins and 0.85 * 9700 < s < 1.15 * 9700


def test_characters_come_as_texts(spark, sf):
    from parley.plans import texts

    rows = [("ab🙂é", "a🙂ee"), ("", "xy"), ("e\u0301\n", ""), (None, "x"), ("", "")]
    out = metrics.char_errors(spark.createDataFrame(rows, "a string, b string"), "a", "b").collect()
    assert [(r.substitutions, r.insertions, r.deletions, r.n_words_reference) for r in out] == [(*matrix(a or "", b), a and len(a) or (0 if a == "" else None)) for a, b in rows]
    assert [r.wer for r in out] == [0.75, 1.0, 1.0, 1.0, 0.0]
    plan = texts.cer_turns(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "split(before" not in plan and "split(_w" not in plan and "char_edits" in plan
