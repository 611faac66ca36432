import numpy as np

from parley.llm import decontaminate, fm_index, queries
from tests.llm import brute


def test_fm_index_finds_all_occurrences():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 5, 700)
    text[300:400] = text[100:200]
    index = fm_index.FMIndex(text, 5)
    patterns = np.array([text[i : i + 4] for i in range(0, 600, 7)] + [[4, 4, 4, 4]])
    low, high = index.search(patterns, np.full(len(patterns), 4))
    for p, a, b in zip(patterns, low, high, strict=True):
        want = [i for i in range(len(text) - 3) if (text[i : i + 4] == p).all()]
        assert sorted(index.locate(np.arange(a, b))) == want


def test_matches_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = brute.contamination(docs, items)
    got = {r.doc_id: tuple(r)[1:] for r in queries.op7_decontaminate(spark, sf).collect()}
    assert got == want
    assert any(x[1] for x in want.values())


def test_edges_and_several_passes(spark):
    text = " ".join(f"Wé{i}" for i in range(40))
    items = [(1, text), (2, "short ITEM"), (3, ""), (4, None), (10, text + " end"), (1, text)]
    docs = [(1, None), (2, ""), (3, "a short,item here"), (4, "x " + text + " y " + text), (5, "SHORT item short item"), (6, text[: len(text) // 2]), (6, text), (None, "short  item")]
    d = spark.createDataFrame([(a, b, "c") for a, b in docs], "doc_id long, text string, _found string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = [(i, *list(brute.contamination([(0, t)], items).values())[0]) for i, t in docs]
    for size in (10**6, 1500):
        got = [tuple(r) for r in decontaminate.report(d, b, pass_bytes=size).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert decontaminate.report(d.limit(0), b).count() == 0
    assert [r[4] for r in decontaminate.report(d, b.limit(0)).collect()] == [brute.contamination([(0, "")], [])[0][3]] * len(docs)
    kept = decontaminate.clean(d, b)
    assert kept.columns == d.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [1, 2]


def test_clean_bears_any_column_name(spark):
    text = " ".join(f"word{i}" for i in range(20))
    d = spark.createDataFrame([(1, text, "c"), (2, "other", None)], "doc_id long, text string, _found_spans string")
    b = spark.createDataFrame([(1, text)], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.clean(d, b).collect()] == [(2, "other", None)]


def test_cost_does_not_follow_windows_that_cannot_occur():
    """A million windows take at most about twice the time of a few hundred, for one block of text."""
    import random
    import time

    from parley.llm import words

    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(30_000)]
    some = lambda n: " ".join(rng.choices(vocabulary, k=n))
    few = [(str(i), some(20).encode()) for i in range(400)]
    many = few + [(f"x{i}", some(5012).encode()) for i in range(200)]
    block = [(some(300) + " " + few[i][1].decode() + " " + some(60)).encode() for i in range(300)]
    table = words.Table(block)
    took, found = [], []
    for items in (few, many):
        phrases = decontaminate.Phrases(items, 13)
        decontaminate.occurrences(table, phrases)
        best = []
        for _ in range(3):
            began = time.perf_counter()
            first, window = decontaminate.occurrences(table, phrases)
            best.append(time.perf_counter() - began)
        took.append(min(best))
        found.append(sorted(zip(first.tolist(), phrases.lengths[window].tolist())))
    assert len(decontaminate.Phrases(many, 13).lengths) > 1_000_000
    assert len(found[0]) == 300 * 8 == len(found[1])
    assert took[1] < 2.5 * took[0] + 0.1, took


def test_a_pass_of_phrases_is_compact():
    import pickle
    import tracemalloc

    rng = np.random.default_rng(5)
    words = [f"{i:x}w".encode() for i in range(200_000)]
    items = [(str(k), b" ".join(words[i] for i in rng.integers(0, len(words), 11_500))) for k in range(200)]
    assert sum(len(t) for _, t in items) + decontaminate.WORD_BYTES * 200 * 11_500 >= decontaminate.PASS_BYTES
    tracemalloc.start()
    phrases = decontaminate.Phrases(items, 13)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(phrases.lengths) == 200 * 11_488
    assert peak < 400_000_000 and len(pickle.dumps(phrases)) < 120_000_000, peak


def test_windows_stay_right_where_all_codes_collide(monkeypatch):
    from parley.llm import words

    monkeypatch.setattr(decontaminate, "_codes", lambda columns, count: np.zeros(count, np.uint64))
    text = " ".join(f"w{i}" for i in range(16))
    items = [(1, text), (2, "w3 " + text), (3, "w1 w2"), (4, "w1 w2")]
    phrases = decontaminate.Phrases([(str(i), t.encode()) for i, t in items], 13)
    table = words.Table([("x w1 w2 " + text + " w9").encode()])
    first, window = decontaminate.occurrences(table, phrases)
    assert phrases.items_of(np.unique(window)) == ["1", "2", "3", "4"]
    assert sorted(set(first.tolist())) == [1, 3, 4, 5, 6]
