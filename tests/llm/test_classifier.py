"""Held-out accuracy of the quality classifier, and its edges."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parley.llm import classifier


def test_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    seen, held = labels.where("doc_id < 6000"), labels.where("doc_id >= 6000")
    model, figures = classifier.train(docs, seen), {}
    rows = classifier.score(docs, model).join(held, F.col("_id") == F.col("doc_id")).collect()
    for name in classifier.TARGETS:
        own = [(r[f"p_{name}"] >= 0.5, r[name] == 1) for r in rows if r[name] is not None]
        assert len(own) > 100 and sum(a == b for a, b in own) / len(own) > 0.9
        for kind in (True, False):
            found, true, both = (sum(1 for a, b in own if fits(a, b)) for fits in (lambda a, b: a == kind, lambda a, b: b == kind, lambda a, b: a == b == kind))
            figures[name, kind] = round(both / max(1, true), 3), round(both / max(1, found), 3)
    print(figures)
    # a fifth of the toxic labels are of documents without anything that sets them apart
    assert all(min(x) >= (0.7 if k == ("toxic", True) else 0.85) for k, x in figures.items()), figures


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, None), (None, "", "x"), (2, "text " * 5000, None)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(1, 1, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    model = classifier.train(docs, labels)
    assert [tuple(r)[1:] for r in classifier.score(docs, model).collect()] == [(None, None, True)] * 3
    assert classifier.accept(docs, model).count() == 3
    assert classifier.train(docs.limit(0), labels).views == {}


def test_any_column_names_and_ids(spark):
    """Columns named like the operator's own, ids of text, one id with many rows."""
    rows = [(f"d{i}", f"{'bad words here' if i % 2 else 'some good prose'} {i}", "t", 1, "x", 5) for i in range(120)] + [("d0", "some good prose", "t", 2, "y", 6)] * 30
    docs = spark.createDataFrame(rows, "name string, text string, _text string, _lang long, _source string, _n_chars long")
    labels = spark.createDataFrame([(f"d{i}", 1 - i % 2, i % 2) for i in range(100)] + [("d3", 0, 1)] * 5, "name string, quality int, toxic int")
    model = classifier.train(docs, labels, id_col="name", labels_id="name")
    assert set(model.views) == set(classifier.TARGETS)
    kept = classifier.accept(docs, model)
    assert kept.columns == docs.columns and {r.name for r in kept.collect()} == {f"d{i}" for i in range(0, 120, 2)}
    got = {r._id: r.accepted for r in classifier.score(docs, model, id_col="name").collect()}
    assert got == {f"d{i}": i % 2 == 0 for i in range(120)}


def _figures(docs, labels, model):
    out = []
    for name in classifier.TARGETS:
        rows = classifier.score(docs, model).join(labels, F.col("_id") == F.col("doc_id")).select(f"p_{name}", name).dropna().collect()
        out.append(sum((p >= 0.5) == (y == 1) for p, y in rows) / len(rows))
    return out


@pytest.mark.parametrize("size,first", [("sf0.01", 600), ("sf0.1", 6000)])
def test_both_views_pass_on_documents_in_each_round(spark, size, first):
    """On the given tables, in both directions; accuracy on held-out labels does not fall by it."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{size}/{t}.parquet") for t in ("documents", "labels"))
    seen, held = labels.where(F.col("doc_id") < first), labels.where(F.col("doc_id") >= first)
    taught, alone = classifier.train(docs, seen), classifier.train(docs, seen, rounds=1)
    assert taught.passed.keys() == {(t, v) for t in classifier.TARGETS for v in (0, 1)} and alone.passed == {}
    assert all(len(n) == classifier.ROUNDS - 1 and min(n) > 0 for n in taught.passed.values())
    print(size, taught.passed, _figures(docs, held, taught), _figures(docs, held, alone))
    assert all(a >= b - 0.01 for a, b in zip(_figures(docs, held, taught), _figures(docs, held, alone), strict=True))


def test_the_surest_are_passed_on_once_with_their_probability(spark):
    """Words and source both tell the label; each slot has its number, ranked over all partitions."""
    docs = spark.createDataFrame([(i, f"{'bad words here' if i % 2 else 'some good prose'} {i}", "src1" if i % 2 else "src2") for i in range(400)], "doc_id long, text string, source string").repartition(7)
    free = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), *classifier._meta(docs))
    model = classifier.train(docs, docs.where("doc_id < 300").select("doc_id", (1 - F.col("doc_id") % 2).alias("quality"), (F.col("doc_id") % 2).alias("toxic")), taken=20)
    assert set(model.passed) == {(t, v) for t in classifier.TARGETS for v in (0, 1)} and all(12 <= x <= 13 for n in model.passed.values() for x in n)  # an eighth of the 100 free documents, half for each label
    told = classifier._exchange(free, model.views, [(1.0, 0.0)] * 4, [10] * 8, 0)
    for k in range(4):
        lists, p = classifier._told(told, k, "meta")
        assert len(lists) == len(p) == 20 and sum(p > 0.5) == 10
        sure = told[told[f"p{2 * k + 1}"].notna()]
        assert {int(i) % 2 for i in sure["_id"]} == {0 if k < 2 else 1}


def test_features_of_a_large_batch_take_little_memory():
    texts = [f"{i} some words of text {i % 97}, and more of them\n" * 40 for i in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), *[pa.nulls(len(texts))] * 3], ["_id", "_text", "_lang", "_source", "_n_chars"])
    whole = classifier.text_features([t.encode() for t in texts])
    classifier.text_features([b"the table of powers is there"])
    tracemalloc.start()
    parts = [(a, n) for _, a, _, n in classifier._features(batch, 1, 2)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    firsts = np.cumsum([0] + [n for _, n in parts])
    for k in (0, 1):
        assert (np.concatenate([a[k] + (f if k == 0 else 0) for (a, _), f in zip(parts, firsts, strict=False)]) == whole[k]).all()
    assert peak < 15e6
