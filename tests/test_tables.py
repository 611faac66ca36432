"""Stored keyed tables: what is read back, and which files a change leaves alone."""

import pytest
from pyspark.sql import functions as F

from parley.operators.tables import KeyedTable

KIND = "k long, name string, n long"


def files(table):
    out = {}
    for r in table._stored().select("_bucket", F.input_file_name().alias("f")).distinct().collect():
        out.setdefault(r[0], set()).add(r.f)
    return out


def rows(table):
    return sorted(map(tuple, table.read().collect()), key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable.create(spark.createDataFrame([(i, f"n{i}", i * i) for i in range(100)], KIND), str(tmp_path / "t"), "k", 16)


def test_changes_are_read_back_and_leave_other_files(spark, table):
    before = files(table)
    touched = table.update(spark.createDataFrame([(3, "new", None), (999, "no one", 1)], KIND))
    assert rows(table)[3] == (3, "new", 9) and len(rows(table)) == 100
    after = files(table)
    assert 0 < len(touched) <= 2 and all((before[b] == after[b]) == (b not in touched) for b in before)
    touched = table.upsert(spark.createDataFrame([(3, "again", 1), (500, "added", 2)], KIND))
    assert rows(table)[3] == (3, "again", 1) and rows(table)[-1] == (500, "added", 2)
    assert all((after[b] == files(table)[b]) == (b not in touched) for b in after)
    assert sorted(map(tuple, table.lookup(3, 500, 77777).collect())) == [(3, "again", 1), (500, "added", 2)]


def test_children_go_with_their_parents_and_empty_buckets_too(spark, table, tmp_path):
    child = KeyedTable.create(spark.createDataFrame([(i % 10, f"c{i}", i) for i in range(60)], KIND), str(tmp_path / "c"), "k", 4)
    keys = spark.createDataFrame([(i,) for i in range(10)], "k long")
    table.delete(keys, child)
    assert rows(child) == [] and [r[0] for r in rows(table)] == list(range(10, 100))
    child.append(spark.createDataFrame([(50, "x", 1), (None, "y", 2)], KIND))
    child.upsert(spark.createDataFrame([(60, "z", 3)], KIND))
    assert rows(child) == [(None, "y", 2), (50, "x", 1), (60, "z", 3)]
    assert table.delete(keys.limit(0)) == []


def test_clear_and_wrong_changes(spark, table):
    with pytest.raises(ValueError):
        table.change(spark.createDataFrame([(1,)], "k long"), lambda old: old.withColumn("k", F.col("k") + F.lit(1)))
    assert len(rows(table)) == 100
    table.clear()
    assert rows(table) == []
    table.upsert(spark.createDataFrame([(1, "a", 1)], KIND))
    assert rows(table) == [(1, "a", 1)]
