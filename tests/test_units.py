"""Small cases with known results, and edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.functions import signal as S
from parley.functions import text as X
from parley.functions import vector as V
from parley.operators import cluster, diarization, folds, intervals, meetings, metrics, similarity, store, windows
from parley.operators.dedup import Memory, alike
from parley.operators.vector_index import VectorIndex
from parley.plans import views


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def arr(*values):
    return V.literal(values)


def test_cosine(spark):
    assert one(spark, V.cosine(arr(1, 0, 0), arr(0, 1, 0))) == 0
    assert one(spark, V.cosine(arr(1, 0, 0), arr(2, 0, 0))) == pytest.approx(1)
    assert one(spark, V.cosine(arr(1, 0), arr(1, 0, 0))) == 0
    assert one(spark, V.cosine(arr(0, 0), arr(1, 0))) == 0


def test_lsh_search(spark, tmp_path):
    kind = "id long, speaker_id long, vector array<double>"
    voices = spark.createDataFrame([(1, 1, [1.0, 0.0, 0.0]), (2, 2, [0.0, 1.0, 0.0]), (3, 2, [-0.9, -0.1, 0.0])], kind)
    queries = spark.createDataFrame([(9, 0, [0.9, 0.1, 0.0]), (8, 0, [-1.0, 0.0, 0.0])], kind)
    found = similarity.lsh_search(queries, voices, VectorIndex.build(voices, str(tmp_path / "x")), 0.5, 5).collect()
    assert {(r.query_id, r.speaker_id) for r in found} == {(9, 1), (8, 2)} and min(r.similarity for r in found) > 0.8


def test_searches_meet_in_blocks(spark, monkeypatch):
    """Pairs are bounded and speakers counted in blocks; copies tie, and rows without a vector are alike to nothing."""
    monkeypatch.setattr(similarity, "ROWS", 7)
    monkeypatch.setattr(similarity, "QUERIES", 3)
    x = np.random.default_rng(1).standard_normal((20, 9))
    rows = [(i, i % 4 or None, x[i % 20].tolist() if i != 33 else None) for i in range(60)]
    voices = spark.createDataFrame(rows, "id long, speaker_id long, vector array<double>")
    queries = voices.where("id % 3 = 0")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    like = {(q, i): float(unit[q % 20] @ unit[i % 20]) if 33 not in (q, i) else None for q in range(0, 60, 3) for i in range(60)}
    got = {(r.query_id, r.id): r.similarity for r in similarity.scored_against(queries, voices).collect()}
    assert got.keys() == like.keys() and all(v is None if like[k] is None else abs(v - like[k]) < 1e-12 for k, v in got.items())
    assert all(got[q, i] == got[q, i + 20] == got[q, i + 40] for q, i in got if i < 13 and q != 33)
    want = {}
    for (q, i), s in like.items():
        if s is not None and s >= 0.2:
            top, n = want.get((q, rows[i][1]), (-2.0, 0))
            want[q, rows[i][1]] = max(top, s), n + 1
    found = {(r.query_id, r.speaker_id): (r.similarity, r.matches) for r in similarity._speakers(queries, voices, 0.2).collect()}
    assert found.keys() == want.keys() and all(abs(found[k][0] - s) < 1e-12 and found[k][1] == n for k, (s, n) in want.items())


def test_queries_without_a_bucket_ask_all_speakers(spark):
    kind = "id long, speaker_id long, vector array<double>"
    queries = spark.createDataFrame([(9, 0, [0.9, 0.1, 0.0])], kind)
    voices = spark.createDataFrame([(1, 1, [-0.9, -0.1, 0.0]), (2, 2, [-1.8, -0.2, 0.0])], kind)
    assert {tuple(r) for r in similarity.lsh_speakers(queries, voices).collect()} == {(9, 1), (9, 2)}
    assert similarity.candidates(queries, voices).count() == 0


def segs(spark, *rows):
    return spark.createDataFrame([("m", i, *r) for i, r in enumerate(rows)], "meeting string, seq long, speaker string, start_ms long, end_ms long, confidence double, text string, n_words long")


def seg(speaker, a, b, text="a b", c=0.8):
    return speaker, a, b, c, text, len(text.split())


def test_statistics(spark):
    rows = segs(spark, seg("s1", 0, 120_000), seg("s1", 0, 60_000), seg("s2", 0, 120_000))
    stats = meetings.speaker_stats(rows, "meeting")
    assert {r.speaker: round(r.percentage, 3) for r in meetings.shares(stats).collect()} == {"s1": 60.0, "s2": 40.0}
    assert meetings.dominant(stats).first().speaker == "s1"


def rates(spark, ref, hyp):
    return metrics.rates(metrics.cells(segs(spark, *ref), segs(spark, *hyp))).first()


def test_error_rates(spark):
    ref = [seg("a", 0, 2000), seg("b", 2500, 4500)]
    assert rates(spark, ref, ref).der == 0
    assert rates(spark, ref, [seg("b", 0, 2000), seg("a", 2500, 4500)]).confusion_rate > 0.8
    missed = rates(spark, ref, ref[:1])
    assert missed.miss_rate > 0.3 and missed.recall < 0.7
    assert rates(spark, ref, [*ref, seg("c", 5000, 6000)]).false_alarm_rate > 0.1


def test_overlaps(spark):
    a, b = segs(spark, seg("x", 1000, 3000), seg("x", 70_000, 200_000)), segs(spark, seg("y", 2000, 4000), seg("y", 110_000, 190_000))
    got = sorted((r.l_seq, r.r_seq, r.overlap) for r in intervals.overlap_join(a, b).collect())
    assert got == [(0, 0, 1000), (1, 1, 80_000)]
    assert intervals.overlap_join(a.limit(0), b).count() == 0
    cells = intervals.labelled_spans(a, a.limit(0)).agg(F.sum(F.col("b") - F.col("a"))).first()[0]
    assert cells == 13_200


def test_split_takes_words_in_proportion(spark):
    text = "one two three four five six seven eight nine ten"
    own = segs(spark, seg("?", 0, 10_000, text))
    found = segs(spark, seg("b", 7000, 10_000, c=0.6), seg("a", 0, 7000))
    got = [(r.part, r.speaker, r.start_ms, r.end_ms, r.text) for r in intervals.align(own, found, 0.2).orderBy("part").collect()]
    assert got == [(0, "a", 0, 7000, "one two three four five six seven"), (1, "b", 7000, 10_000, text)]
    none = intervals.align(own, found.limit(0)).first()
    assert (none.speaker, round(none.overall, 3)) == ("unknown_speaker", 0.4)


def test_resolve(spark):
    rows = segs(spark, seg("a", 0, 3000), seg("a", 2000, 2500), seg("b", 2300, 5000), seg("b", 5500, 6000))
    got = [(r.speaker, r.start_ms, r.end_ms) for r in windows.resolve(rows, 1000).orderBy("part").collect()]
    assert got == [("a", 0, 2400), ("b", 2400, 5500), ("b", 5500, 6000)]


def test_folds_over_batches(spark):
    """Folds go on over the borders of Arrow batches, and groups begin anew."""
    times = [(g, g * 7 + t) for g in range(4) for t in (0, 3, 9, 10, 11, 19, 20, 21, 35)]
    spans = [seg("a", 0, 100), seg("b", 50, 70), seg("a", 60, 500), seg("b", 120, 130), seg("a", 125, 140), seg("b", 140, 150), seg("a", 300, 310)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        kept = windows.spaced(spark.createDataFrame(times[::-1], "g long, t long"), 10, "g", "t").collect()
        groups = windows.overlap_groups(segs(spark, *spans)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, kept)) == [(g, g * 7 + t) for g in range(4) for t in (0, 10, 20, 35)]
    assert sorted((r.g, r.members) for r in groups) == [(0, 3), (1, 2)]


def test_validity(spark):
    rows = segs(spark, seg("a", 1000, 2000), seg("a", 2000, 1000), seg("a", 1000, 70_000), seg("a", 9000, 9050), seg("a", 3000, 3500))
    assert [r.valid for r in windows.validity(rows).orderBy("seq").collect()] == [True, False, False, False, False]


def test_texts(spark):
    lit = F.lit
    assert one(spark, X.normalize(lit("  Hello, WORLD!  I'm "))) == "hello world im"
    assert one(spark, X.tokens(lit("Hello, world! How are you? I'm fine."))) == "hello world how are you im fine".split()
    assert one(spark, X.rarity(lit("the"))) < 0.5 < 1 < one(spark, X.rarity(lit("transcription")))
    assert one(spark, X.clock(lit(3725))) == "1:02:05" and one(spark, X.clock(lit(65.9))) == "1:05"
    assert one(spark, X.spoken(lit(65))) == "1m 5s"
    assert one(spark, X.merge_texts(lit("hello there"), lit("hello"))) == "hello there"
    assert one(spark, X.repeats(lit("Hello everyone"), lit("hello everyone and all"), 0.9))
    assert one(spark, X.trim_marks(lit("..a.b!"))) == "a.b"
    assert one(spark, X.highlight(lit("a.b aXb"), "a.b")) == "<mark>a.b</mark> aXb"
    ref, hyp = X.tokens(lit("Hello world how are you today")), X.tokens(lit("Hi world how are you today"))
    assert one(spark, X.positional_error_rate(ref, hyp)) == pytest.approx(1 / 6)
    pair = spark.createDataFrame([("Hello world how are you today".split(), "Hi world how are you today".split())], "a array<string>, b array<string>")
    got = metrics.word_errors(pair, "a", "b").first()
    assert (got.substitutions, got.insertions, got.deletions, round(got.wer, 4)) == (1, 0, 0, 0.1667)


def test_overlap_of_letters_that_grow_in_capitals(spark):
    rows = spark.createDataFrame([("Die Straße ßa und so weiter", "DIE STRASSE SSA"), ("ﬁne ŉ a rest", "ﬁne ŉ a")], "text string, buffer string")
    assert [r[0] for r in rows.select(X.without_overlap(F.col("text"), F.col("buffer"), 0.3)).collect()] == ["und so weiter", "rest"]


def test_memory():
    memory = Memory(least=0.6)
    texts = ["hello everyone welcome to our meeting", "hello everyone welcome to the meeting", "now the budget for next year", "ok"]
    assert [memory.repeats(t, t) for t in texts] == [False, True, False, False]
    assert alike([], ["a"]) == 0


def test_signals(spark):
    x = arr(0.0, 1.0, 0.0, -1.0)
    assert one(spark, S.resample(x, 1, 2)) == [0.0, 0.5, 1.0, 0.5, 0.0, -0.5, -1.0, -1.0]
    assert one(spark, S.zero_crossings(x)) == pytest.approx(1 / 3)
    assert one(spark, S.level(x)) == 1.0
    assert one(spark, S.preferred_rate(F.array(F.lit(8000), F.lit(44100)))) == 44100
    assert one(spark, S.readable_on(F.lit("#ffffff"))) == "#000000"
    assert one(spark, S.pre_emphasis(arr(1.0, 1.0))) == pytest.approx([1.0, 0.03])
    assert len(one(spark, S.high_pass(arr(*[1.0] * 50), 16000))) == 50
    assert one(spark, S.clipped(x)) and one(spark, S.rolloff(x)) == 3
    assert one(spark, F.size(S.band_energies(arr(*[0.5] * 16)))) == 4


def test_clusters(spark):
    rng = np.random.default_rng(1)
    base = np.eye(3)[[0, 0, 1, 1, 2, 2]] + rng.normal(0, 0.01, (6, 3))
    rows = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(base)], "recording long, id long, vector array<double>")
    got = lambda **o: [r.cluster for r in cluster.cluster(rows, "recording", **o).orderBy("id").collect()]
    assert len(set(got(most=2, stop_at_most=False))) == 2
    assert got(stop_at_most=False) == [0, 0, 1, 1, 2, 2]
    assert got(most=8) == [0, 1, 2, 3, 4, 5]
    timed = views.timed(rows.withColumnRenamed("id", "seq"))
    assert [r.cluster for r in folds.in_order(timed, folds.OnlineClusters(0.7), "recording").orderBy("seq").collect()] == [0, 0, 1, 1, 2, 2]
    assert len(set(got(least=4, stop_at_most=False))) == 4


def test_store(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    assert sorted(map(tuple, store.upsert(rows, spark.createDataFrame([(2, "c"), (3, "d")], rows.schema), "id").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert store.orphans(spark.createDataFrame([(9,)], "id long"), rows, "id").count() == 1
    assert store.current_version(spark.createDataFrame([], "version int")).first().version == 0
    assert store.latest(rows.union(rows), "id", "name").count() == 2
    texts = store.to_export(rows.withColumnRenamed("id", "speaker_id"))
    good, bad = store.from_export(spark, texts.select("json").union(spark.createDataFrame([("{oops",)], "json string")), "speaker_id long, name string")
    assert good.count() == 2 and bad.count() == 1


def test_text_seed_equals_a_plain_loop(spark):
    from parley.functions import vector

    def plain(text):
        seed = 0
        for byte in text.encode():
            seed = (seed * 31 + byte) % 2**32
        return seed

    texts = ["", "a", "speaker_1", "Zoë 日本", "x" * 5000, "a"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string")
    got = dict(rows.select("i", vector.text_seed(rows.t).alias("s")).collect())
    assert [got[i] for i in range(len(texts))] == [plain(t) for t in texts] and got[len(texts)] is None


def test_samples_of_stretches_that_touch_several_spans(spark):
    rng = np.random.default_rng(6)
    frames = [(k, i, int(t), float(e)) for k in (1, 2) for i, (t, e) in enumerate(zip(rng.integers(-50, 400, 200), rng.random(200), strict=True))]
    stretches = [(1, 0, -40, 3), (1, 1, 5, 6), (1, 2, 10, 200), (1, 3, 300, 300), (2, 0, 10, 20), (2, 1, 500, 600)]
    want = {(k, i): [e for _, _, e in sorted((t, q, e) for s, q, t, e in frames if s == k and a <= t < b)] for k, i, a, b in stretches}
    own = spark.createDataFrame(frames, "stream long, seq long, t_us long, energy double")
    rows = diarization.with_samples(spark.createDataFrame(stretches, "stream long, island long, start_us long, end_us long"), own, width=7).collect()
    assert {(r.stream, r.island): r.samples for r in rows} == {k: v for k, v in want.items() if v} and len(rows) == len({(r.stream, r.island) for r in rows})


def test_limit_merges_the_pair_with_the_largest_mean():
    rng = np.random.default_rng(8)
    for n, most in ((1, 4), (9, 0), (14, 3), (20, 5)) * 10:
        vectors = np.round(rng.normal(size=(n, 3)))
        label = cluster.agglomerate(vectors, 0.9, most, False)
        size = np.linalg.norm(vectors, axis=1, keepdims=True)
        unit = np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)
        sims, want = unit @ unit.T, label.copy()
        while len(names := np.unique(want)) > max(most, 1):
            best = max(((sims[np.ix_(want == a, want == b)].mean(), -a, -b) for a in names for b in names if a < b))
            want[want == -best[2]] = -best[1]
        assert (cluster.limit(label, vectors, np.arange(n), 1, most) == want).all()


def test_vectors_made_in_the_task(spark):
    rng = np.random.default_rng(9)
    rows = [(key, i, [float(x) for x in rng.random(3)]) for key in (1, 2) for i in range(30)]
    halves = spark.createDataFrame(rows, "recording long, id long, vector array<double>")
    want = spark.createDataFrame([(key, i, [v[0], -v[1], v[2], 1.0]) for key, i, v in rows], halves.schema)
    got = lambda rows, **o: {(r.recording, r.id): r.cluster for r in cluster.cluster(rows, "recording", 0.9, 1, 4, False, **o).collect()}
    make = lambda v: np.array([v[0], -v[1], v[2], 1.0])
    assert got(halves, make=make) == got(halves, make=make, in_task=0) == got(want) and len(got(want)) == 60
