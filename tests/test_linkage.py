"""Average linkage in rounds gives the clusters of the one-by-one method, for recordings of any size."""

import numpy as np
import pytest

from parley.operators import cluster, linkage

KIND = "recording long, id long, vector array<double>"


def vectors(n, groups, noise, seed):
    pick = np.random.default_rng(seed)
    centres = pick.standard_normal((groups, 8))
    return centres[pick.integers(0, groups, n)] + noise * pick.standard_normal((n, 8))


def rows(spark):
    given = {0: vectors(70, 6, 0.5, 1), 1: vectors(40, 3, 0.1, 2), 2: vectors(2, 1, 0.3, 3), 3: vectors(1, 1, 0.3, 4), 4: vectors(30, 30, 1.0, 5)}
    return given, spark.createDataFrame([(k, i, v.tolist()) for k, own in given.items() for i, v in enumerate(own)], KIND).repartition(5)


def plain(own, similarity, least, most, stop):
    found = cluster.limit(cluster.agglomerate(own, similarity, most, stop), own, np.arange(len(own)), least, most)
    return cluster._numbered(found).tolist()


@pytest.mark.parametrize("similarity,least,most,stop", [(0.6, 1, 8, True), (0.85, 4, 5, False)])
def test_rounds_are_the_one_by_one_method(spark, monkeypatch, similarity, least, most, stop):
    monkeypatch.setattr(linkage, "BLOCK", 20)
    given, table = rows(spark)
    got = {}
    for r in cluster.cluster(table, "recording", similarity, least, most, stop, in_task=0).collect():
        got.setdefault(r.recording, {})[r.id] = r.cluster
    for k, own in given.items():
        assert [got[k][i] for i in range(len(own))] == plain(own, similarity, least, most, stop), k


def test_small_ones_in_a_task_and_large_ones_in_rounds(spark):
    given, table = rows(spark)
    got = {}
    for r in cluster.cluster(table, "recording", 0.6, 1, 8, False, in_task=50).collect():
        got.setdefault(r.recording, {})[r.id] = r.cluster
    for k, own in given.items():
        assert [got[k][i] for i in range(len(own))] == plain(own, 0.6, 1, 8, False), k


def test_equal_vectors_zero_vectors_and_no_rows(spark):
    table = spark.createDataFrame([(1, i, [0.0, 1.0] if i % 2 else [0.0, 0.0]) for i in range(12)], KIND)
    got = {r.id: r.cluster for r in cluster.cluster(table, "recording", 0.9, 1, 3, False, in_task=0).collect()}
    assert {got[i] for i in range(1, 12, 2)} == {got[1]} and len(set(got.values())) <= 3
    assert cluster.cluster(table.limit(0), "recording", in_task=0).count() == 0


def test_nearest_of_ties_is_the_smallest_pair(spark, monkeypatch):
    monkeypatch.setattr(linkage, "BLOCK", 30)
    x = np.random.default_rng(0).integers(-2, 3, (120, 6)).astype(float)
    x[60:80], x[5] = x[:20], 0
    rows = spark.createDataFrame([(i % 2, i, 1 + i % 3, (x[i] * (1 + i % 3)).tolist()) for i in range(120)], "key long, c long, n long, total array<double>")
    got = {(r.key, r.c): (r.mate, r.similarity) for r in linkage.nearest(rows.where("c % 3 = 0"), rows).collect()}
    best = {i: min((-(x[i] @ x[j]), min(i, j), max(i, j), j) for j in range(120) if j != i and j % 2 == i % 2) for i in range(0, 120, 3)}
    assert got == {(i % 2, i): (b[3], -b[0]) for i, b in best.items()}


def test_groups_merge_only_what_is_sure(spark, monkeypatch):
    # groups of at most 12 of 150 vectors, so most merges have something nearer outside the group to heed
    monkeypatch.setattr(linkage, "GROUP", 12)
    monkeypatch.setattr(linkage, "NEAR", 3)
    monkeypatch.setattr(linkage, "STRIPE", 40)
    monkeypatch.setattr(linkage, "BLOCK", 16)
    given = {7: vectors(150, 9, 0.7, 6), 8: vectors(20, 2, 0.4, 7), 9: np.repeat(vectors(12, 12, 0.1, 8), 5, axis=0)}
    table = spark.createDataFrame([(k, 3 * i, v.tolist()) for k, own in given.items() for i, v in enumerate(own)], KIND)
    got = {}
    for r in cluster.cluster(table, "recording", 0.7, 1, 6, False, in_task=0).collect():
        got.setdefault(r.recording, {})[r.id] = r.cluster
    for k, own in given.items():
        assert [got[k][3 * i] for i in range(len(own))] == plain(own, 0.7, 1, 6, False), k


def test_rounds_do_not_follow_a_chain_step_by_step(spark, monkeypatch):
    # each vector is nearest to the one before, so only one pair at a time is mutually nearest
    monkeypatch.setattr(linkage, "GROUP", 40, raising=False)
    angles = np.cumsum(1.2 / (1 + np.arange(60)))[::-1] / 4
    own = np.stack([np.cos(angles), np.sin(angles)], axis=1)
    made, tables = linkage.written, []
    monkeypatch.setattr(linkage, "written", lambda df, name="rows": tables.append(name) or made(df, name))
    table = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(own)], "key long, id long, vector array<double>")
    found = linkage.merges(table).collect()
    assert len(found) == 59 and len(tables) < 30


def test_a_group_heeds_what_is_outside():
    ids, vectors = np.array([3, 5, 8]), np.array([[1, 0.0], [0.9, 0.1], [0.8, 0.3]])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    like = vectors @ vectors.T
    mates = np.array([[5, 8], [3, 8], [99, 5]])
    # 8 is nearer to 99, which is in another group
    likes = np.array([[like[0, 1], like[0, 2]], [like[0, 1], like[1, 2]], [0.999, like[1, 2]]])
    live, found = linkage._merge(ids, np.ones(3, int), vectors.copy(), np.ones(3), mates, likes)
    assert live.tolist() == [True, False, True] and [(a.tolist(), b.tolist()) for _, a, b, _ in found] == [([0], [1])]
    live, found = linkage._merge(ids, np.ones(3, int), vectors.copy(), np.ones(3), None, None)
    assert live.tolist() == [True, False, False] and len(found) == 2


def test_vectors_without_direction_stay_alone(spark):
    own = [[1.0, 0.0], [float("nan"), 1.0], [0.9, 0.1], [float("nan"), 1.0], [0.0, 1.0], [0.1, 0.9]]
    table = spark.createDataFrame([(0, i, v) for i, v in enumerate(own)], KIND)
    got = {r.id: r.cluster for r in cluster.cluster(table, "recording", 0.9, 1, 8, False, in_task=0).collect()}
    assert [got[i] for i in range(6)] == [0, 1, 0, 2, 3, 3]
