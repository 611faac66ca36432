"""Greedy spacing and groups over pieces, against the fold."""

from random import Random

import pytest

from parley.operators import greedy, windows

KIND = "k long, seq long, a long, b long, extra string"


def fold(rows):
    """(key, seq) that begin a group, and each one's group."""
    out, now, g, end = {}, object(), -1, None
    for k, seq, a, b, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1])):
        g, end = (-1, None) if k != now else (g, end)
        begins = end is None or a >= end
        g, end, now = g + begins, b if begins else end, k
        out[k, seq] = begins, g
    return out


def odd_rows():
    pick, rows = Random(5), []
    for k, n, dense in ((1, 700, 5), (2, 90, 40), (3, 1, 1), (None, 60, 3), (4, 300, 1)):
        for seq in range(n):
            a = pick.randrange(n * dense)
            rows.append((k, seq, a, a + pick.choice((-3, 0, 1, 20, 20, 20, 200)), "x"))
    return rows


@pytest.mark.parametrize("bits", [1, 4, 12])
def test_groups_do_not_depend_on_pieces(spark, monkeypatch, bits):
    monkeypatch.setattr(greedy, "PIECE_BITS", bits)
    table = spark.createDataFrame(odd_rows(), KIND).repartition(6)
    got = {(r.k, r.seq): (r.begins, r.group) for r in greedy.began(table, "k", "a", "b", ("seq",)).collect()}
    assert got == fold(odd_rows())


def test_one_key_is_spread(spark, monkeypatch):
    """20,000 rows of one key, 16 in a piece: doubling, and no function longer than what can come in."""
    monkeypatch.setattr(greedy, "PIECE_BITS", 4)
    rows = [(0, i, i * 7 % 20_000, 0, "") for i in range(20_000)]
    kept = [r.a for r in windows.spaced(spark.createDataFrame(rows, KIND).repartition(8), 100, "k", "a").collect()]
    assert sorted(kept) == list(range(0, 20_000, 100))


def test_edges(spark):
    table = spark.createDataFrame([(1, None, 0), (1, 5, 0), (1, 5, 1), (None, 3, 0)], "k long, t long, seq long")
    assert sorted(map(str, windows.spaced(table, 1, "k", "t").collect())) == ["Row(k=1, t=5)", "Row(k=None, t=3)"]
    assert windows.spaced(table.limit(0), 1, "k", "t").count() == 0
    segs = spark.createDataFrame([(1, 0, None, None), (1, 1, 0, 10), (1, 2, 4, 5), (1, 3, 20, None), (1, 4, 20, 30), (1, 5, 25, 40)], "meeting long, seq long, start_ms long, end_ms long")
    assert sorted(map(tuple, windows.overlap_groups(segs).collect())) == [(1, 1, 2, 1), (1, 3, 2, 4)]
