import numpy as np
from pyspark.sql import functions as F

from parley.llm import exact_dedup, queries, simhash
from tests.llm import brute

SCHEMA = "doc_id long, text string, _h string"


def test_exact_dedup_edges(spark):
    rows = [(4, "a b", "x"), (2, "ab", "x"), (9, " a  b", "x"), (1, None, "x"), (3, "", "x"), (5, " \t\n\x0b\f\r", None), (None, "zz", "x"), (6, "zz", "x"), (7, "\x1cq", "x"), (8, "q", "x")]
    got = {(r._id, r.text_sha256): r for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    by = {k[0]: r for k, r in got.items()}
    assert len(got) == len(rows)
    assert by[4].keep_id == by[2].keep_id == 9 and by[9].kept and not by[2].kept and by[2].group_size == 3
    assert by[1].keep_id == 5 and by[3].group_size == 3
    assert by[6].keep_id == 6 and by[None].keep_id == 6 and not by[None].kept
    assert by[7].keep_id == 7 and by[8].keep_id == 8
    assert exact_dedup.exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_exact_dedup_tells_collisions_apart(spark):
    rows = [(1, "a", ""), (2, "a ", ""), (3, "b", ""), (4, "b", "")]
    got = {r._id: r for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, SCHEMA), digest=F.lit("same")).collect()}
    assert (got[1].keep_id, got[2].keep_id, got[3].keep_id, got[4].keep_id) == (2, 2, 3, 3)
    assert got[3].group_size == 2


def test_drop_copies_keeps_one_of_repeated_rows(spark):
    rows = [(1, "a", "k"), (1, "a", "k"), (2, "a ", "l"), (3, None, "m"), (None, "c", "n"), (None, "c", "n")]
    got = exact_dedup.drop_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got if r.text) == [(0, "c"), (2, "a ")] and len(got) == 3


def test_one_row_stays_where_ids_are_repeated(spark):
    rows = [(1, "a b", "x"), (1, "a  b", "x"), (2, "ab", "x"), (5, "q r", "x"), (5, "qr ", "y"), (5, "q r", "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = exact_dedup.exact_dedup(docs).collect()
    assert sorted((r._id, r.keep_id, r.group_size, r.kept) for r in got) == [(1, 1, 3, False), (1, 1, 3, True), (2, 1, 3, False), (5, 5, 3, False), (5, 5, 3, False), (5, 5, 3, True)]
    for parts in (1, 3):
        kept = exact_dedup.drop_copies(docs.repartition(parts)).collect()
        assert len(kept) == 2 and (1, "a  b", "x") in map(tuple, kept)
    assert len({tuple(r) for n in (1, 2, 5) for r in exact_dedup.drop_copies(docs.repartition(n)).where("doc_id = 5").collect()}) == 1


def test_ids_of_other_types_and_ends(spark):
    low = -(2**63)
    got = exact_dedup.exact_dedup(spark.createDataFrame([(low, "a"), (low + 1, "a"), (2**63 - 1, "b")], "doc_id long, text string")).collect()
    assert sorted((r._id, r.keep_id, r.kept) for r in got) == [(low, low, True), (low + 1, low, False), (2**63 - 1, 2**63 - 1, True)]
    got = exact_dedup.exact_dedup(spark.createDataFrame([("x", "a"), ("b", "a"), (None, "a")], "doc_id string, text string")).collect()
    assert {(r._id, r.keep_id, r.kept) for r in got} == {("x", "b", False), ("b", "b", True), (None, "b", False)}


def test_groups_over_many_parts_and_without_broadcast(spark, monkeypatch):
    rows = [(i, "same  text" if i % 7 else f"own {i}", "x") for i in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = sorted(tuple(r) for r in exact_dedup.exact_dedup(docs).collect())
    monkeypatch.setattr(exact_dedup, "PART", 3)
    monkeypatch.setattr(exact_dedup.rows, "SMALL", 0)
    assert sorted(tuple(r) for r in exact_dedup.exact_dedup(docs).collect()) == want
    assert sorted(r.doc_id for r in exact_dedup.drop_copies(docs).collect()) == sorted(r[0] for r in want if r[3])
    clash = exact_dedup.drop_copies(docs, digest=F.lit("one"))
    assert sorted(r.doc_id for r in clash.collect()) == sorted(r[0] for r in want if r[3])


def test_simhash_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in queries.op9_simhash(spark, sf).collect()}
    prints = [(i, brute.fingerprint(t)) for i, t in texts.items()]
    classes = brute.near_classes(prints)
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{x:016x}" for i, x in prints}
    assert {i: r.component_id for i, r in got.items()} == classes


def test_links_reach_all_close_pairs_of_a_crowd(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 6, dtype=np.int64)
    prints = {int(b) ^ (1 << int(x)) ^ (1 << int(y)) for b in base for x, y in rng.integers(0, 62, (60, 2))} | {0, 1, 7, 1 << 62}
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(sorted(prints))], "i long, _fp long")
    edges = simhash.links(frame.select("_fp"), part=16)
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    want = brute.near_classes([(x, x) for x in prints])
    assert {x: roots.get(x, x) for x in prints} == want


def test_more_bit_blocks_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 0.0001)
    rng = np.random.default_rng(4)
    prints = {int(x) for x in rng.integers(0, 2**63, 20, dtype=np.int64)}
    prints |= {x ^ (1 << a) ^ (1 << b) ^ (1 << c) for x in list(prints) for a, b, c in rng.integers(0, 62, (3, 3)).tolist()}
    frame = spark.createDataFrame([(x,) for x in prints], "_fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(frame)).collect()}
    assert {x: roots.get(x, x) for x in prints} == brute.near_classes([(x, x) for x in prints])


def test_near_dedup_edges(spark):
    rows = [(3, None, "a"), (2, "", "a"), (5, "A b", "a"), (7, "a B", "a"), (None, "a b", "a"), (9, "quite another text", None)]
    got = {r._id: r for r in simhash.near_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[3].component_id == 2 and got[2].fingerprint == "0" * 16
    assert got[7].component_id == got[None].component_id == 5
    assert simhash.near_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pivots_discard_the_pairs():
    """Almost all pairs go by the table of distances; none that is close does."""
    rng = np.random.default_rng(8)
    prints = rng.integers(0, 2**64, 400, np.uint64)
    prints = np.unique(np.concatenate((prints, prints[:50] ^ np.uint64(5))))
    group = ((prints >> np.uint64(8)) % np.uint64(3)).astype(int)
    far = np.bitwise_count(prints[:, None] ^ np.array(simhash.pivots(), np.int64).view(np.uint64)[None, :]).astype(np.int8)
    seen = {}
    got = {(min(a, b), max(a, b)) for x, y in simhash.close_pairs(group, prints, far, seen=seen) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    want = {(i, j) for j in range(len(prints)) for i in range(j) if group[i] == group[j] and int(prints[i] ^ prints[j]).bit_count() <= 3}
    assert got == want and want
    made, *left, sure = np.array(seen["pairs"]).sum(axis=0).tolist()
    assert made < len(prints) ** 2 / 6 and left[0] < made and left[-1] < made / 100 and sure == len(want)


def test_pairs_in_blocks_are_the_same(monkeypatch):
    rng = np.random.default_rng(9)
    prints = np.unique(rng.integers(0, 2**6, 60, np.uint64))
    far = np.bitwise_count(prints[:, None] ^ np.array(simhash.pivots(), np.int64).view(np.uint64)[None, :]).astype(np.int8)
    pairs = lambda: {(min(a, b), max(a, b)) for x, y in simhash.close_pairs(np.zeros(len(prints), int), prints, far) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    want = pairs()
    monkeypatch.setattr(simhash, "PAIRS", 7)
    assert pairs() == want and want


def test_table_of_distances(spark):
    frame = spark.createDataFrame([(0,), (-1,), (2**63 - 1,), (-(2**63),)], "_fp long")
    for r in simhash.pivot_table(frame).collect():
        assert list(r._d) == [((r._fp ^ p) & (2**64 - 1)).bit_count() for p in simhash.pivots()]


def test_drop_near_keeps_one_document_of_each(spark, monkeypatch):
    x, y = "one two three four five six", "quite another text which is not alike at all"
    rows = [(1, x, "a"), (7, y, "a"), (7, x, "b"), (7, x, "b"), (7, y, "a"), (9, "ONE two three four five six", "c"), (None, x, "d"), (None, "alone here and now", None), (4, None, "e"), (5, "", "e")]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = [(1, x, "a"), (4, None, "e"), (7, y, "a"), (None, "alone here and now", None)]
    for small in (simhash.rows.SMALL, 0):
        monkeypatch.setattr(simhash.rows, "SMALL", small)
        got = simhash.drop_near(docs)
        assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert simhash.drop_near(docs.limit(0)).count() == 0


def test_hot_keys_are_dealt_out(spark, monkeypatch):
    """100,000 rows of one key: each part gets its share, every row meets its key's row once."""
    from parley.llm import rows

    monkeypatch.setattr(rows, "TOGETHER", 5000)
    big = spark.range(130_000).select(F.when(F.col("id") < 100_000, -1).otherwise(F.col("id")).alias("k"), "id").repartition(9)
    small = big.groupBy("k").agg(F.count("*").alias("n"))
    dealt, parts = rows.spread(big, "k", small, "k", "n", 130_000)
    met = dealt.join(parts, ["k", "_salt"])
    assert met.count() == 130_000
    sizes = [r[1] for r in met.where("k = -1").groupBy("_salt").agg(F.count("*")).collect()]
    assert len(sizes) == 20 and max(sizes) <= 1.5 * min(sizes)


def test_results_do_not_depend_on_what_is_hot(spark, monkeypatch):
    texts = ["", "one two three four five six seven", "one two three four five six seven", "completely other words stand here now"]
    docs = spark.createDataFrame([(i, texts[i % 4] if i < 90 else f"own words number {i} and some {i * 7} more") for i in range(120)], "doc_id long, text string").repartition(5)
    near = sorted(map(tuple, simhash.near_dedup(docs).collect()))
    exact = sorted(map(tuple, exact_dedup.exact_dedup(docs).collect()))
    kept = sorted(r.doc_id for r in exact_dedup.drop_copies(docs).collect())
    monkeypatch.setattr(simhash.rows, "TOGETHER", 2)
    monkeypatch.setattr(simhash.rows, "SMALL", 0)
    assert sorted(map(tuple, simhash.near_dedup(docs).collect())) == near
    assert sorted(map(tuple, exact_dedup.exact_dedup(docs).collect())) == exact
    assert sorted(r.doc_id for r in exact_dedup.drop_copies(docs).collect()) == kept
