import gzip
import hashlib
import tracemalloc
from pathlib import Path

import duckdb
import pytest

from parley.llm import queries, warc

SCHEMA = "page_id long, url string, html string, digest string"


def bodies():
    long = "é<p>WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 30_000
    return [(1, "http://a/", "x" * 999), (2, "http://a/", "x" * 999), (3, None, "y" * 1000), (9, "http://b/ \r\nq", "y" * 1000), (4, "u", "y" * 1000), (5, "u", None), (6, "u", ""), (7, "u", long), (8, "u", long), (10, "u", "\r\n"), (11, "u", "a\r\n\r\n"), (12, "u", "\n\r"), (13, "u", "é" * 500), (None, "u", "é" * 500), (None, None, "z" * 2000), (20, "u", "r" * 1000), (20, "u", "r" * 1000), (14, "u", "r" * 1000)]


def archived(spark, rows, tmp_path, parts=3, most=warc.CHUNK):
    warc.write(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(parts), str(tmp_path / "out"), most=most)
    return str(tmp_path / "out")


def test_records_read_back(spark, tmp_path):
    path = archived(spark, bodies(), tmp_path)
    found = {}
    for r in warc.records(warc.chunks(spark, path)).collect():
        found.setdefault(r.page_id and int(r.page_id), []).append(r)
    assert sum(map(len, found.values())) == len(bodies()) and all(r.intact for rs in found.values() for r in rs)
    for page, _, html in bodies():
        data = (html or "").encode()
        assert (len(data), hashlib.sha1(data).hexdigest()) in {(r.size, r.digest) for r in found[page]}
    kind = {p: sorted((r.record_type, r.refers_to) for r in rs) for p, rs in found.items()}
    assert kind[3] == kind[4] == [("revisit", "9")] and kind[9] == [("response", None)] and kind[7] == [("revisit", "8")]
    assert kind[1] == kind[2] == kind[5] == kind[6] == kind[13] == [("response", None)] and kind[20] == [("response", None)] * 2 and kind[14] == [("revisit", "20")]
    assert kind[None] == [("response", None), ("revisit", "13")]


def test_chunks_are_the_payload_and_carry_its_digest(spark, tmp_path):
    rows = [r for r in bodies() if r[0] in (7, 10, 11, 13)]
    table = warc.chunks(spark, archived(spark, rows, tmp_path, most=700), most=1000).collect()
    for page, _, html in rows:
        data, own = html.encode(), sorted((r for r in table if r.page_id == str(page)), key=lambda r: r.chunk)
        assert b"".join(r.data for r in own) == data and [r.last for r in own] == [False] * (len(own) - 1) + [True]
        assert [r.chunk for r in own] == list(range(max(1, -(-len(data) // 1000))))
        assert all(r.digest == hashlib.sha1(data[: r.size]).hexdigest() and len(r.data) <= 1000 for r in own)


def test_archives_are_warc_files(spark, tmp_path):
    """Read by lengths alone: each record ends with an empty line twice, and another begins or the file ends."""
    n = 0
    for file in Path(archived(spark, bodies(), tmp_path)).glob("*.gz"):
        raw, at = gzip.decompress(file.read_bytes()), 0
        while at < len(raw):
            end = raw.index(b"\r\n\r\n", at)
            head = dict(x.split(": ", 1) for x in raw[at:end].decode().split("\r\n")[1:])
            at = end + 4 + int(head["Content-Length"])
            assert raw[at : at + 4] == b"\r\n\r\n" and head["WARC-Record-ID"].startswith("<urn:uuid:")
            at += 4
            n += 1
    assert n == len(bodies())


def test_plain_archives_of_others_in_splits(spark, tmp_path):
    own = [("application/http;msgtype=response", b"HTTP/1.1 200 OK\nA: b\n\nbody \r\n%d\r\n" % i) if i % 2 else ("text/plain", b"\r\n" * i + b"WARC/1.0") for i in range(400)]
    raw = b"".join(b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:%d>\r\ncontent-type: %s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, k.encode(), len(b), b) for i, (k, b) in enumerate(own))
    (tmp_path / "a.warc").write_bytes(raw)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        table = warc.chunks(spark, str(tmp_path / "a.warc")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r.record_id: r.data for r in table} == {f"<urn:x:{i}>": b.split(b"\n\n", 1)[1] if i % 2 else b for i, (_, b) in enumerate(own)}


def test_cut_off_archives_are_told():
    with pytest.raises(EOFError):
        list(warc.parsed(warc.Source(iter([b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"]))))
    with pytest.raises(ValueError):
        list(warc.parsed(warc.Source(iter([b"HTTP/1.1\r\n"]))))


def test_memory_of_a_long_record_is_that_of_chunks():
    size = 200 << 20
    head = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % size

    def pieces():
        yield head
        for _ in range(size >> 16):
            yield bytes(1 << 16)
        yield b"\r\n\r\n"

    tracemalloc.start()
    seen = sum(len(r[7]) for r in warc.parsed(warc.Source(pieces())))
    assert seen == size and tracemalloc.get_traced_memory()[1] < 8 << 20
    tracemalloc.stop()


def test_empty_table_and_query(spark, sf, tmp_path):
    path = archived(spark, [], tmp_path)
    assert warc.chunks(spark, path).count() == 0 and warc.records(warc.chunks(spark, path)).count() == 0
    con = duckdb.connect()
    con.sql(f"create view pages as from '{sf}/pages.parquet'")
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, queries.op12_warc(spark, sf).collect()), key=key) == sorted(con.sql(queries.SQL["op12_warc"]).fetchall(), key=key)
