"""Queries without SQL against plain versions of what they compute."""

import numpy as np
import pytest

from parley.operators import boundaries, folds
from parley.plans import all_queries, streams, views
from parley.sources import audio

QUERIES, SQL = all_queries()


def edits(a, b):
    """Cheapest substitutions, insertions, deletions; ties in that order."""
    rows = [[(j, 0, j, 0) for j in range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row = [(i, 0, 0, i)]
        for j, y in enumerate(b, 1):
            d, left, up = rows[-1][j - 1], row[-1], rows[-1][j]
            best = min((d[0] + (x != y), 0), (left[0] + 1, 1), (up[0] + 1, 2))
            row.append(((best[0], d[1] + (x != y), d[2], d[3]), (best[0], left[1], left[2] + 1, left[3]), (best[0], up[1], up[2], up[3] + 1))[best[1]])
        rows.append(row)
    return rows[-1][-1][1:]


def test_character_edits(spark, sf):
    from parley.plans.texts import turn_pairs

    want = {}
    for r in turn_pairs(spark, sf).collect():
        want[r.meeting, r.seq] = (*edits(r.before, r.text), len(r.before))
    got = {(r.meeting, r.seq): (r.substitutions, r.insertions, r.deletions, r.n_chars) for r in QUERIES["cer_turns"](spark, sf).collect()}
    assert got == want
    total = tuple(np.array(list(want.values())).sum(axis=0).tolist())
    assert tuple(QUERIES["cer_corpus"](spark, sf).first())[:4] == total


def test_speakers_whole_texts(spark, sf):
    from parley.functions import text as X
    from pyspark.sql import functions as F

    own = views.segments(spark, sf)
    heard = {(r.meeting, r.seq): r.speaker for r in views.predicted(own).collect()}
    ref, hyp, want = {}, {}, {}
    for r in own.select("meeting", "seq", "speaker", X.tokens(F.col("text")).alias("w")).orderBy("meeting", "seq").collect():
        ref.setdefault((r.meeting, r.speaker), []).extend(r.w)
        hyp.setdefault((r.meeting, heard[r.meeting, r.seq]), []).extend(r.w)
    for (meeting, speaker), a in ref.items():
        if a:
            s, i, d = edits(a, hyp.get((meeting, speaker), []))
            want[speaker] = [x + y for x, y in zip(want.get(speaker, [0] * 4), (s, i, d, len(a)), strict=True)]
    got = {r.speaker: [r.substitutions, r.insertions, r.deletions, r.n_words] for r in QUERIES["sa_wer"](spark, sf).collect()}
    assert got == want


def test_kinds_of_both_forms_agree(spark, sf):
    """Window expressions and the fold tell the same kind for every frame; all kinds occur."""
    rows = {}
    for r in boundaries.classify(views.frames(spark, sf), streams.POLICY, unit_us=streams.UNIT).select("stream", "t_us", "seq", "energy", "kind").collect():
        rows.setdefault(r.stream, []).append((r.t_us, r.seq, r.energy, r.kind))
    seen = set()
    for own in rows.values():
        fold = boundaries.Assembler(streams.POLICY, streams.UNIT)
        for t, _, e, kind in sorted(own):
            loud = e > streams.POLICY.silence
            fold.energies.append(e)
            fold.quiet, fold.speech = (0, fold.speech + 1) if loud else (fold.quiet + 1, 0)
            if loud:
                fold.pattern.append(e)
            assert fold.kind(t) == kind
            seen.add(kind)
    assert {"none", "hard", "sentence_end"} <= seen


def test_policies_of_utterances():
    def run(energies, **policy):
        own = boundaries.Assembler(boundaries.Policy(**policy), 1000)
        return [x for i, e in enumerate(energies) for x in own.add(i * 100_000, e)]

    talk = [0.5, 0.3] * 30
    assert run(talk + [0.0] * 12, speech_ms=3000) == [(0, 6_900_000, 70, "hard")]
    assert run([0.5, 0.3] * 150)[0][2:] == (201, "longest")
    assert run([0.5] * 3 + [0.0] * 160)[0] == (0, 15_000_000, 151, "rest")
    assert run([0.0] * 20) == []
    state = boundaries.Assembler(boundaries.Policy(), 1000)
    list(state.add(0, 0.5))
    assert boundaries.Assembler.unpack(boundaries.Policy(), 1000, state.pack()) == state


def test_timing_is_corrected_and_merged(spark):
    rows = [("m", 0, 0, 5000, "one two", "a", 0.9), ("m", 1, 5200, 8000, "three", "b", 0.8), ("m", 2, 7000, 9000, "three four", "c", 0.9), ("m", 3, 20_000, 21_000, "x", "a", 0.5), ("m", 4, 1000, 1050, "bad", "a", 0.5), ("n", 0, 3, 4, "alone", "a", 0.5)]
    frame = views.timed(spark.createDataFrame(rows, "meeting string, seq long, start_ms long, end_ms long, text string, speaker string, confidence double"))
    got = {(r.meeting, r.seq): (r.start_ms, r.end_ms, r.text, r.speaker, round(r.confidence, 3), r.merged) for r in folds.in_order(frame, folds.Correction(), "meeting").collect()}
    assert got["m", 1] == (5200, 8000, "three", "b", 0.8, 0)
    assert got["m", 2] == (5200, 9000, "three four", "c", 0.85, 1)
    assert got["m", 4] == (5100, 5150, "bad", "a", 0.5, 0)
    assert got["n", 0] == (3, 4, "alone", "a", 0.5, 0)


def test_diarizer_filter(spark, sf):
    rc, dt = 1 / (2 * np.pi * 80), 1 / 640
    a = rc / (rc + dt)
    want = {}
    for r in views.voices(spark, sf).collect():
        x, y = np.array(r.vector), []
        before, out = x[0], x[0]
        for v in x:
            out = a * (out + v - before)
            before = v
            y.append(out)
        y = np.array(y)
        y *= 0.1 / np.sqrt((y * y).mean())
        for s in range(0, len(y), 6):
            if s + 16 >= len(y):
                break
            if (y[s : s + 16] ** 2).mean() < 0.005:
                y[s : s + 16] *= 0.1
        want[r.id] = np.abs(y).sum()
    got = {r.id: r.mass for r in QUERIES["diarizer_filter"](spark, sf).collect()}
    assert got == {i: pytest.approx(v, abs=1e-5) for i, v in want.items()}


def _recordings(spark, sf):
    out = {}
    for r in views.voices(spark, sf).orderBy("id").collect():
        v = np.array(r.vector)
        out.setdefault(r.id // 50, []).append((r.id, v / np.linalg.norm(v)))
    return out


def test_agglomerative_clusters(spark, sf):
    got = {r.id: r.cluster for r in QUERIES["cluster_agglomerative"](spark, sf).collect()}
    for rows in _recordings(spark, sf).values():
        groups = [[i] for i in range(len(rows))]
        sims = np.array([[float(a @ b) for _, b in rows] for _, a in rows])
        mean = lambda g, h: sims[np.ix_(g, h)].mean()
        while len(groups) > 8:
            best, i, j = max((mean(g, h), -i, -j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j)
            if best < 0.3:
                break
            groups[-i] += groups.pop(-j)
        while len(groups) > 8:
            _, i, j = max((mean(g, h), -i, -j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j)
            groups[-i] += groups.pop(-j)
        want = {frozenset(rows[i][0] for i in g) for g in groups}
        own = {}
        for i, _ in rows:
            own.setdefault(got[i], set()).add(i)
        assert {frozenset(g) for g in own.values()} == want


def test_online_clusters(spark, sf):
    got = {r.id: r.cluster for r in QUERIES["cluster_online"](spark, sf).collect()}
    for rows in _recordings(spark, sf).values():
        groups = []
        for i, v in rows:
            scores = [np.mean([float(v @ w) for w in g]) for g in groups]
            at = int(np.argmax(scores)) if scores and max(scores) > 0.3 else len(groups)
            if at == len(groups):
                groups.append([])
            groups[at].append(v)
            assert got[i] == at


def test_recall_of_band_search(spark, sf):
    rows = [(i, v) for own in _recordings(spark, sf).values() for i, v in own]
    found = {}
    for r in QUERIES["band_search"](spark, sf).collect():
        found.setdefault(r.query_id, set()).add(r.id)
    hit = total = 0
    for i, v in rows:
        if i % 100 == 0:
            best = sorted((-float(v @ w), j) for j, w in rows if j != i)[:10]
            hit += len({j for _, j in best} & found[i])
            total += len(best)
    assert hit / total >= 0.9, hit / total


def test_diarized_time_is_the_time_of_speech(spark, sf):
    rows = QUERIES["diarize"](spark, sf).collect()
    spoken = {}
    for r in QUERIES["window_segments"](spark, sf).collect():
        spoken[r.stream] = spoken.get(r.stream, 0) + r.end_us - r.start_us
    own, speakers = {}, {}
    for r in rows:
        own[r.stream] = own.get(r.stream, 0) + r.time_us
        speakers.setdefault(r.stream, []).append(r)
    assert own == spoken
    for r in speakers.values():
        assert sorted(x.speaker for x in r) == list(range(len(r))) and {x.speakers for x in r} == {len(r)} and len(r) <= 4
        assert r[0].overall == pytest.approx(np.mean([x.confidence for x in r]), abs=1e-5)


def test_diarize_finds_speech_once(spark, sf, monkeypatch):
    from parley.operators import diarization

    vectors, made = [], diarization.cluster.cluster
    monkeypatch.setattr(diarization.cluster, "cluster", lambda rows, *a, **b: vectors.append(rows) or made(rows, *a, **b))
    result = QUERIES["diarize"](spark, sf)
    for frame in (*vectors, result):
        plan = frame._jdf.queryExecution().optimizedPlan()
        assert not any("events.parquet" in x for x in frame.inputFiles()), plan.toString()[:2000]
    assert result._jdf.queryExecution().executedPlan().toString().count("MapInArrow") <= 1


def test_statistics_vector_by_its_definition():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.3, 5000)
    rows = []
    for s in range(0, len(x) - 1023, 512):
        f = x[s : s + 1024]
        size = np.abs(f)
        energy = np.sqrt((f * f).sum())
        passed, roll = 0.0, None
        for i, v in enumerate(sorted(size, reverse=True)):
            passed += v
            if roll is None and passed >= 0.85 * size.sum():
                roll = i * 16000 / 1024 / 2
        rows.append((energy, sum((a >= 0) != (b >= 0) for a, b in zip(f, f[1:], strict=False)) / 1024, sum(i * 16000 / 1024 / 2 * v for i, v in enumerate(size)) / size.sum(), roll, abs(energy - rows[-1][0]) if rows else 0.0))
    want = np.zeros(512)
    for k, own in enumerate(np.array(rows).T):
        want[k * 100 : k * 100 + 4] = own.mean(), own.std(), own.min(), own.max()
        for v in own:
            want[k * 100 + 4 + min(int((v - own.min()) / ((own.max() - own.min()) / 96)), 95)] += 1 / len(own)
    got = audio.statistics_vector(x)
    assert np.linalg.norm(got) == pytest.approx(1) and len(got) == 512
    assert np.allclose(got[:500] * (want[2 * 100] / got[200]), want[:500], atol=1e-6)
    assert not audio.statistics_vector(np.zeros(0)).any() and audio.statistics_vector(x[:10]).any()
