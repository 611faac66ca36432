"""Every query with SQL gives what DuckDB gives; the others run and are checked by brute force below."""

import math

import duckdb
import pytest

from parley.operators import dedup
from parley.plans import all_queries

QUERIES, SQL = all_queries()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    own = duckdb.connect()
    own.execute("set timezone = 'UTC'")
    for t in TABLES:
        own.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return own


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    found = con.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=str)
    assert got == want


def _edit(a, b):
    d = [[(i + j, 0) for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = (min(d[i - 1][j - 1][0] + (a[i - 1] != b[j - 1]), d[i][j - 1][0] + 1, d[i - 1][j][0] + 1), 0)
    return d[-1][-1][0]


def _lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_word_errors_and_common_words(spark, sf):
    from parley.functions import text as X
    from parley.plans.texts import turn_pairs
    from pyspark.sql import functions as F

    rows = turn_pairs(spark, sf).select("meeting", "seq", X.tokens(F.col("before")).alias("a"), X.tokens(F.col("text")).alias("b")).collect()
    want = {(r.meeting, r.seq): _edit(r.a, r.b) for r in rows}
    got = {(r.meeting, r.seq): r.substitutions + r.insertions + r.deletions for r in QUERIES["wer_turns"](spark, sf).collect()}
    assert got == want
    lists = turn_pairs(spark, sf).select("meeting", "seq", X.words(X.normalize(F.col("before"))).alias("a"), X.words(X.normalize(F.col("text"))).alias("b")).collect()
    want = {(r.meeting, r.seq): round(_lcs(r.a, r.b) / max(len(r.a), len(r.b), 1), 6) for r in lists}
    assert {(r.meeting, r.seq): r.similarity for r in QUERIES["lcs_similarity"](spark, sf).collect()} == want
    native = {(r.meeting, r.seq): r.similarity for r in QUERIES["semantic_similarity"](spark, sf).collect()}
    assert native == {(r.meeting, r.seq): pytest.approx(dedup.alike(r.a, r.b), abs=2e-6) for r in lists}


def test_streams_agree_with_batch(spark, sf):
    key = lambda name: sorted((r.meeting, r.seq, r.duplicate) for r in QUERIES[name](spark, sf).collect())
    assert key("stream_repeats") == key("dedup_exact")


def test_utterances_by_brute_force(spark, sf):
    from parley.plans import views

    frames, want = {}, []
    for r in views.frames(spark, sf).select("stream", "t_us", "seq", "energy").collect():
        frames.setdefault(r.stream, []).append((r.t_us, r.seq, r.energy))
    for stream, rows in frames.items():
        own, quiet = [], 0
        for t, _, e in sorted(rows):
            if own and t - own[-1] >= 9 * 600_000_000:
                want.append((stream, own[0], own[-1], "stale"))
                own, quiet = [], 0
            if e > 0.3 or own:
                own.append(t)
                quiet = 0 if e > 0.3 else quiet + 1
                if own[-1] - own[0] >= 20 * 600_000_000:
                    want.append((stream, own[0], own[-1], "longest"))
                    own, quiet = [], 0
                elif quiet >= 3 and own[-1] - own[0] >= 4.5 * 600_000_000:
                    want.append((stream, own[0], own[-1], "silence"))
                    own, quiet = [], 0
        if own:
            want.append((stream, own[0], own[-1], "stale"))
    got = [(r.stream, r.start_us, r.end_us, r.reason) for r in QUERIES["stream_utterances"](spark, sf).collect()]
    assert sorted(got) == sorted(want)


@pytest.fixture(scope="module")
def scattered(spark, sf, tmp_path_factory):
    """The tables that are streamed, each as 20 files in no order."""
    place = tmp_path_factory.mktemp("scattered")
    for t in ("events", "conversations"):
        spark.read.parquet(f"{sf}/{t}.parquet").repartition(20).write.parquet(f"{place}/{t}.parquet")
        assert len(list((place / f"{t}.parquet").glob("*.parquet"))) == 20
    return str(place)


@pytest.mark.parametrize("name", ["stream_session_window", "stream_dedup", "stream_utterances", "stream_repeats"])
def test_streams_of_many_files(spark, sf, scattered, name):
    rows = lambda place: sorted((tuple(map(plain, r)) for r in QUERIES[name](spark, place).collect()), key=str)
    got = rows(scattered)
    assert got and got == rows(sf)


def test_repeats_of_a_session_in_many_files(spark, tmp_path):
    """The last turns come first; only turn 0 is new."""
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq

    (tmp_path / "conversations.parquet").mkdir()
    text = "we meet again on the second day of the month to speak about the plan"
    for turn in range(19, -1, -1):
        file = tmp_path / "conversations.parquet" / f"{19 - turn:02}.parquet"
        pq.write_table(pa.table({"conv_id": pa.array([1], pa.int64()), "turn": pa.array([turn], pa.int64()), "text": [text]}), file)
        os.utime(file, (1_700_000_000 - turn, 1_700_000_000 - turn))
    got = {r.seq: r.duplicate for r in QUERIES["stream_repeats"](spark, str(tmp_path)).collect()}
    assert got == {turn: turn > 0 for turn in range(20)}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
