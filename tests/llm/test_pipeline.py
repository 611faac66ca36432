"""The pipeline against plain versions of its stages, and each stage on rows of all kinds."""

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from parley.llm import bpe, classifier, queries
from tests.llm import brute

PATH = public_tokenizers.path(queries.RANKS)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(open(PATH).read()), special_tokens={})
NAMES = ["quality", "exact_dedup", "near_dedup", "decontaminate", "bpe"]


def plain(rows, accepted, items):
    """The rows (doc_id, text, ...) that stay, by definition."""
    rows = [r for r in rows if r[0] in accepted]
    best = {}
    for r in rows:
        key = "".join(c for c in r[1] or "" if c not in " \t\n\x0b\x0c\r")
        if key not in best or (-len(r[1] or ""), r[0]) < (-len(best[key][1] or ""), best[key][0]):
            best[key] = r
    rows = list(best.values())
    classes = brute.near_classes([(r[0], brute.fingerprint(r[1])) for r in rows])
    rows = [r for r in rows if classes[r[0]] == r[0]]
    found = brute.contamination([(r[0], r[1]) for r in rows], items)
    return [r for r in rows if not found[r[0]][4]]


def test_whole_pipeline_by_brute_force(spark, sf):
    table = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    docs = table("documents")
    score = classifier.score(docs, classifier.train(docs, table("labels")))
    accepted = {r._id for r in score.where("accepted").collect()}
    want = plain([(r.doc_id, r.text) for r in docs.collect()], accepted, [(r.item_id, r.text) for r in table("benchmark").collect()])
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert got.keys() == {i for i, _ in want} and 0 < len(got) < docs.count()
    for i, text in want:
        assert list(got[i].ids) == LIBRARY.encode_ordinary(text or "") and got[i].round_trip and got[i].n_tokens == len(got[i].ids)


@pytest.fixture(scope="module")
def odd(spark, sf, tmp_path_factory):
    """Tables with nulls, empty and very long texts, repeated ids and rows, and clashing column names."""
    place = tmp_path_factory.mktemp("odd")
    item = " ".join(f"item{i}" for i in range(30))
    rows = [(1, "a plain text of some words", "en", "src1", 26, "x", "y"), (1, "a plain  text of some words", "en", "src1", 27, "x", "y"), (2, "a plain text of some\twords", "en", None, None, None, None), (2, "another text with the same id as one before it", "en", "src2", 40, "x", "y")]
    rows += [(None, None, None, None, None, None, None)] * 2 + [(4, "", "en", "src1", 0, "x", "y"), (5, "word and more words again " * 20_000, "en", "src1", 500_000, "x", "y"), (6, item, "en", "src1", 200, "x", "y"), (None, "no id but a text of its own here", "en", "src1", 30, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _text string, _found_spans string")
    docs.write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    spark.createDataFrame([(1, item), (None, "a plain text"), (2, None)], "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    return str(place)


KEPT = {"quality": 10, "exact_dedup": 6, "near_dedup": 6, "decontaminate": 9, "bpe": 10}


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_each_stage_on_odd_rows(spark, odd, name, stage):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    out = stage(spark, docs, odd)
    assert out.count() == KEPT[name]
    if name != "bpe":
        assert out.schema == docs.schema and not out.exceptAll(docs).count()
    if name in ("exact_dedup", "near_dedup"):
        assert out.where("doc_id = 1").count() == 1 and out.where("doc_id = 2").count() == 1 and out.where("doc_id is null").count() == 1
    assert stage(spark, docs.limit(0), odd).count() == 0


def test_stages_in_turn_on_odd_rows(spark, odd):
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    got = corpus_pipeline.run(spark, odd)
    assert sorted(got.select(F.coalesce("doc_id", F.lit(-1))).toPandas().iloc[:, 0]) == [-1, 1, 2, 4, 5]
    assert got.where("not round_trip").count() == 0
