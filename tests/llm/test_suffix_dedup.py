import hashlib
import random
from collections import Counter

import numpy as np

from parley.llm import queries, suffix_dedup, suffix_merge


def brute(texts, length=200):
    """(kept bytes, removed spans) of each text."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((bytes(b for b, g in zip(t, gone, strict=True) if not g), spans))
    return out


def test_merged_transforms_find_repeats():
    rng = random.Random(2)
    some = lambda n: bytes(rng.choice(b"ab") for _ in range(n))
    base = some(300)
    strings = [base, some(250), base[40:280] + some(20), some(30) + base[:225], some(200), base[90:290], some(260)]
    weight = np.array([1, 1, 1, 1, 2, 1, 1])
    seen = Counter()
    for s, w in zip(strings, weight, strict=True):
        for i in range(len(s) - 199):
            seen[s[i : i + 200]] += int(w)
    want = [[i for i in range(len(s) - 199) if seen[s[i : i + 200]] > 1] for s in strings]
    assert [x.tolist() for x in suffix_merge.repeated(strings, weight, 200)] == want
    assert any(want)


def test_symbols_are_told_apart_by_bytes():
    raw = np.frombuffer(bytes(range(60)) + bytes(range(60)), np.uint8)
    at = np.array([0, 60, 5, 30, 65])
    for codes in ([7, 7, 7, 7, 7], [1, 1, 2, 2, 2], [1, 1, 2, 3, 2]):
        name = suffix_merge.named(np.array(codes, np.uint64), raw, at)
        assert [[a == b for b in name] for a in name] == [[bytes(raw[a : a + 25]) == bytes(raw[b : b + 25]) for b in at] for a in at]


def test_strings_are_told_apart_where_all_hashes_collide(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_mix", lambda x, k=0: np.zeros_like(x))
    rng = random.Random(9)
    some = lambda n: bytes(rng.choice(b"ab") for _ in range(n))
    base = some(260)
    texts = [base, some(300), b"x" + base, b"q" * 300, some(199), b"q" * 230]
    text, start, size, run, key, own = suffix_dedup.anchored(texts)
    assert len(set(key.tolist())) == 1 and sum(run) == sum(max(0, len(t) - 199) for t in texts)
    strings = [texts[t][a : a + n] for t, a, n in zip(text, start, size, strict=True)]
    assert len(set(own)) == len(set(strings)) == len(set(zip(own, strings, strict=True))) < len(own)
    assert [r for t, r in zip(text, run, strict=True) if t in (3, 5)] == [101, 31]


def test_hot_anchors_have_parts_in_proportion(spark):
    hot = {7: 2, 8: 64, 9: 64}
    rows = spark.range(4000).selectExpr("id % 4 + 6 as key", "unhex(hex(id)) as ref").select("key", suffix_dedup._part(hot).alias("part"))
    found = {r.key: r.n for r in rows.groupBy("key").agg({"part": "approx_count_distinct"}).toDF("key", "n").collect()}
    assert found[6] == 1 and found[7] == 2 and 55 < found[8] < 72


def test_bands_hold_each_stretch_once():
    rng = random.Random(8)
    string = bytes(rng.randrange(256) for _ in range(331))
    for width in (169, 24, 4, 1):
        parts = {}
        starts = []
        for off, part, mark, place, piece in suffix_dedup.bands(string, 5, 150, width):
            assert string[off : off + len(piece)] == piece and place == 150 - off
            assert len(piece) <= 199 + width
            parts[part] = mark
            starts += range(off, off + len(piece) - 199)
        assert sorted(starts) == list(range(132))
        # another string with the same stretches further on: equal bands stay equal, cut ones keep their part
        other = b"zz" + string[100:]
        again = {part: mark for _, part, mark, _, _ in suffix_dedup.bands(other, 5, 52, width)}
        assert len(set(parts) & set(again)) >= 32 // width
        if width == 1:
            assert sum(parts.get(k) == v for k, v in again.items()) == 32


def test_large_groups(spark):
    """Ten thousand strings around one anchor: some share bytes before it, some after it, most neither."""
    rng = random.Random(6)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    core, left, right = some(110), some(150), some(150)
    rows = [(i, some(130) + core + some(130), "x") for i in range(9000)]
    rows += [(20000 + i, some(130) + core + right[: 60 + i % 91] + some(60), "x") for i in range(600)]
    rows += [(30000 + i, some(60) + left[i % 91 :] + core + some(130), "x") for i in range(600)]
    found = _compare(spark, [r[:2] for r in rows])
    assert any(r[3] for r in found) and sum(r[3] == 0 for r in found) > 8000


def _compare(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ref string")
    got = sorted((r._id is not None, r._id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.report(docs).collect())
    texts = [(t or "").encode() for _, t in rows]
    want = sorted((i is not None, i or 0, len(t), len(t) - len(k), n, hashlib.sha256(k).hexdigest()) for (i, _), t, (k, n) in zip(rows, texts, brute(texts), strict=True))
    assert got == want
    return got


def test_matches_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts = [t.encode() for _, t in rows]
    got = {r.doc_id: tuple(r)[1:] for r in queries.op8_suffix_dedup(spark, sf).collect()}
    want = {i: (len(t), len(t) - len(k), n, hashlib.sha256(k).hexdigest()) for (i, _), t, (k, n) in zip(rows, texts, brute(texts), strict=True)}
    assert got == want
    assert any(x[1] for x in want.values())


def test_edges(spark, monkeypatch):
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passage, short = some(420), some(150)
    rows = [(1, None), (2, ""), (3, "a" * 900), (4, some(800)), (5, "b" * 200), (5, "b" * 200), (None, passage), (6, "x" + passage), (7, passage[3:300] + some(90) + passage[100:]), (8, some(70) + short), (9, short + some(90)), (10, "ab" * 400), (11, some(199)), (12, "c" * 199 + "d"), (13, "c" * 198 + "d"), (14, "é" * 150)]
    rows += [(20 + i, some(60) + passage[50:290] + some(60)) for i in range(12)]
    found = _compare(spark, rows)
    assert any(r[3] for r in found)
    for most in (3, 0):
        monkeypatch.setattr(suffix_dedup, "GROUP_STRINGS", most)
        assert _compare(spark, rows) == found
    monkeypatch.setattr(suffix_dedup, "_hot", lambda texts: {k: 1 + k % 5 for (k,) in texts.select("ref", "copies", "packed").mapInArrow(suffix_dedup._members, suffix_dedup.MEMBER).select("key").distinct().collect()})
    assert _compare(spark, rows) == found
    assert suffix_dedup.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    kept = {r._id: bytes(r.kept) for r in suffix_dedup.strip_repeats(spark.createDataFrame([(1, passage, "x"), (2, "y" + passage, "x"), (3, None, "x")], "doc_id long, text string, kept string")).collect()}
    assert kept == {1: b"", 2: b"y", 3: b""}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("stretches")]


def test_nothing_is_left_in_the_warehouse_or_of_the_table(spark, tmp_path):
    import os

    from parley.session import shared_dir

    before = spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:")
    held = set(os.listdir(before)) if os.path.isdir(before) else set()
    text = "".join(chr(97 + i * i % 23) for i in range(400))
    docs = spark.createDataFrame([(1, text), (2, "x" + text), (3, "short")], "doc_id long, text string")
    assert sorted(r.n_removed for r in suffix_dedup.report(docs).collect()) == [0, 400, 400]
    assert (set(os.listdir(before)) if os.path.isdir(before) else set()) == held
    place = shared_dir(spark).removeprefix("file:")
    assert not [x for x in os.listdir(place) if x.startswith("stretches_")] and not spark.catalog.listTables()
