"""Folds over streams give what they give over tables, whatever the files, triggers and order of rows."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import folds
from parley.plans import streams, views
from parley.plans.streams import POLICY, UNIT
from parley.streaming import live


def cut(table, n, place, by=None):
    """The table as ``n`` files; with ``by`` in its order, else in none."""
    dealt = table.repartitionByRange(n, by) if by else table.repartition(n)
    dealt.write.parquet(str(place))
    names = sorted(p for p in os.listdir(place) if p.endswith(".parquet"))
    for i, name in enumerate(names):
        os.utime(place / name, (1_700_000_000 + i, 1_700_000_000 + i))
    return len(names)


def streamed(spark, table, place, per_trigger):
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", per_trigger).parquet(str(place))


def rows(df, like=None):
    return sorted(map(str, (df.select(*like.columns) if like is not None else df).collect()))


CASES = {
    "utterances": (lambda spark, sf: views.frames(spark, sf), folds.Utterances(POLICY, UNIT), "stream"),
    "correction": (lambda spark, sf: views.timed(views.predicted(views.segments(spark, sf)).join(views.segments(spark, sf).select("meeting", "seq", "text"), ["meeting", "seq"])), folds.Correction(), "meeting"),
    "clusters": (lambda spark, sf: views.timed(views.voices(spark, sf).select((F.col("id") % 3).alias("recording"), F.col("id").alias("seq"), "vector")), folds.OnlineClusters(0.3), "recording"),
}


@pytest.mark.parametrize("name", CASES)
def test_twenty_files_in_any_order(spark, sf, tmp_path, name):
    """Five triggers of four files whose times overlap; the watermark allows for all of it."""
    make, fold, key = CASES[name]
    table = make(spark, sf)
    assert cut(table, 20, tmp_path / "in") == 20
    out = live.replay(streamed(spark, table, tmp_path / "in", 4), lambda s: live.folded(s, fold, key, late="3650 days", stretch=3_600_000_000), str(tmp_path / "run"))
    want = folds.in_order(table, fold, key)
    assert rows(out, want) == rows(want)


def test_rows_go_and_utterances_close_before_the_end(spark, sf, tmp_path):
    """Files in order of time and a short wait: most is out before the stream has ended, and all of it after."""
    table, fold = views.frames(spark, sf), folds.Utterances(POLICY, UNIT)
    n = cut(table, 5, tmp_path / "in", "t_us")
    events = streamed(spark, table, tmp_path / "in", 1)
    seen = []
    plain = live.run
    build = lambda s: live.folded(s, fold, "stream", late="1 minute", stretch=600_000_000)
    try:
        live.run = lambda stream, out, checkpoint: (plain(stream, out, checkpoint), seen.append(spark.read.parquet(out).count()))
        out = live.replay(events, build, str(tmp_path / "run"))
    finally:
        live.run = plain
    want = folds.in_order(table, fold, "stream")
    assert rows(out, want) == rows(want)
    assert n == 5 and 0.5 * seen[1] < seen[0] < seen[1] == want.count()


def test_rows_that_are_too_late_are_rejected(spark, tmp_path):
    make = lambda seq: views.timed(spark.createDataFrame([(1, s, 1.0) for s in seq], "stream long, seq long, energy double"))
    table, place = make([]), tmp_path / "in"
    fold = folds.Silences(0.5, shortest=60.0, longest=600.0, stale=3600.0)
    make([1, 2, 60]).coalesce(1).write.parquet(str(place))
    build = lambda: live.folded(spark.readStream.schema(table.schema).parquet(str(place)), fold, "stream", late="10 minutes")
    live.run(build(), str(tmp_path / "out"), str(tmp_path / "check"))
    make([3, 55]).coalesce(1).write.mode("append").parquet(str(place))
    live.run(build(), str(tmp_path / "out"), str(tmp_path / "check"))
    make([300]).coalesce(1).write.mode("append").parquet(str(place))
    live.run(build(), str(tmp_path / "out"), str(tmp_path / "check"))
    got = [(r.frames, r.reason) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("start_us").collect()]
    assert sum(n for n, _ in got) == 4


def vad(chunks, threshold=0.5, least_ms=100.0, most_ms=600.0):
    """A plain loop over chunks."""
    position, now = 0.0, threshold
    for x in chunks:
        sizes = sorted(map(abs, x))
        floor, power = (sizes[len(x) // 4], sum(v * v for v in x) / len(x)) if x else (0, 0)
        snr = 10 * math.log10(power / floor**2) if floor > 0 else None
        if snr is not None:
            now = min(0.9, threshold + (0.3 if snr < 10 else 0.2 if snr < 20 else 0.1 if snr < 30 else 0))
        found, start, end, c = [], None, None, None
        for i in range(0, len(x), 800):
            w = x[i : i + 800]
            mass = sum(map(abs, w))
            centre = sum(k * abs(v) for k, v in enumerate(w)) / mass if mass else 0
            p = min(1.0, 0.6 * (sum(v * v for v in w) / len(w) > 0.01) + 0.4 * (10 < centre < 1000))
            t = position + i / 16_000
            if p > now:
                start, end, c = (t, t + 0.05, p) if start is None else (start, t + 0.05, (c + p) / 2)
            elif start is not None:
                found.append((start, end, c))
                start = None
        found += [(start, end, c)] if start is not None else []
        parts = []
        for a, b, c in found:
            if (b - a) * 1000 >= least_ms:
                n = math.ceil((b - a) / (most_ms / 1000))
                parts += [(a + k * (b - a) / n, a + (k + 1) * (b - a) / n, c) for k in range(n)]
        yield position, parts, now, snr
        position += len(x) / 16_000


@pytest.mark.parametrize("size", [300, 5000, 90_000])
def test_voice_activity_for_any_chunking(spark, size):
    pick = np.random.default_rng(size)
    loud = np.repeat(pick.choice([0.001, 0.02, 0.4, 1.2], 60), 3000)
    x = (pick.standard_normal(len(loud)) * loud).tolist()
    chunks = [x[i : i + size] for i in range(0, len(x), size)]
    chunks.insert(2, [])
    table = views.timed(spark.createDataFrame([(1, i, c) for i, c in enumerate(chunks)], "stream long, seq long, samples array<double>"))
    got = sorted(folds.in_order(table, streams.VAD, "stream").collect(), key=lambda r: r.seq)
    assert len(got) == len(chunks)
    for r, (position, parts, now, snr) in zip(got, vad(chunks), strict=True):
        assert r.offset_s == pytest.approx(position) and r.threshold == pytest.approx(now) and r.snr_db == (None if snr is None else pytest.approx(snr))
        assert [(s.start_s, s.end_s, s.confidence) for s in r.segments] == [pytest.approx(p) for p in parts]
    assert any(r.segments for r in got) == (size > 300)


def test_packed_states_are_whole():
    for fold, given in ((folds.VoiceActivity(context=5), [[0.5, 0.1] * 900]), (folds.Correction(), [0, 500, "a b", "x", 0.5]), (folds.Repeats(), ["many words in a row", "k"]), (folds.Silences(0.1), [0.5])):
        own = fold.begin()
        list(fold.add(own, 1, 1, *given))
        again = fold.unpack(fold.pack(own))
        assert fold.pack(again) == fold.pack(own)
    own = folds.VoiceActivity(context=5).begin()
    folds.VoiceActivity(context=5).add(own, 1, 1, list(range(9)))
    assert own[2] == [4, 5, 6, 7, 8]


class Puts:
    """State of one key in memory, counting what is put into it."""

    def __init__(self):
        self.own, self.puts = {}, 0

    def keys(self):
        return iter(list(self.own))

    def getValue(self, key):
        return self.own[key]

    def updateValue(self, key, value):
        self.own[key], self.puts = value, self.puts + 1

    def removeKey(self, key):
        del self.own[key]

    def get(self):
        return self.own.get(None)

    def update(self, value):
        self.updateValue(None, value)


def test_rows_far_apart_share_entries_and_a_timer():
    """One key with a row in each of 1,000 stretches, taken in unordered: few entries, one timer at a time, rows in order."""
    import types

    import pandas as pd

    timers, states = [], []
    made = lambda *a: states.append(Puts()) or states[-1]
    own = live.InOrder(folds.Silences(0.3, unit_us=1_000_000), ["t_us", "seq", "energy"], "stream", ["stream", "start_us", "end_us", "frames", "energy", "reason"], 60_000_000)
    own.init(types.SimpleNamespace(getMapState=made, getValueState=made, registerTimer=timers.append, deleteTimer=timers.remove))
    place = np.random.default_rng(2).permutation(1000)
    frames = [pd.DataFrame({"t_us": place[i::4] * 60_000_000, "seq": place[i::4], "energy": 0.9}) for i in range(4)]
    assert not list(own.handleInputRows((7,), iter(frames), None))
    assert own.waiting.puts <= 8 and len(timers) == 1
    out = []
    while timers:
        now = max(timers.pop(0), 60_000 * (len(out) + 100))
        out += pd.concat([pd.DataFrame(), *own.handleExpiredTimer((7,), types.SimpleNamespace(getCurrentWatermarkInMs=lambda now=now: now), None)]).get("start_us", pd.Series()).tolist()
        assert len(timers) <= 1
    assert out == [60_000_000 * i for i in range(1000)] and not own.waiting.own


def test_chunks_are_moved_and_sorted_without_their_samples(spark, sf):
    plan = streams.vad_chunks(spark, sf)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Sort [") :]
    assert "Exchange" in below and "array_repeat" in plan and "array_repeat" not in below and "samples" not in below
