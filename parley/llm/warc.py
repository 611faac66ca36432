"""WARC archives of pages: written through Spark's text writer, read back as a table of chunks.

A record is a run of rows that the writer ends with CRLF: its head, and its HTTP message, whose body
is cut into transfer chunks where it is oversized. So neither side builds a record as a whole, and
archives can lie in any store that Spark reaches. Reading is a pull parser over the bytes of a file.
It gives rows by record and chunk number with the digest of the payload so far; the last row of a
record has the digest of all of it. Archives are gzip files, one for each task that writes, and each
is read by one task as a stream.

Pages have ``page_id, url, html``. A null html is empty; other columns are not looked at. An empty
table gives an archive without records. Payloads are equal if their SHA-256 and length are. Where a
``page_id`` is repeated, each row is a record of its own, and each row that has the largest id of its
group is a response. A null id is smaller than all others; a group of null ids alone is all response.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import rows
from parley.session import ship, written

#: Payloads above it are written and read in chunks of so many bytes.
CHUNK = 256 * 1024
#: Equal payloads of fewer bytes are all kept.
REVISIT_BYTES = 1000
#: A batch of rows leaves a task at so many bytes or rows.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 1024
CRLF = "\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def record_id(page_id: str | None, digest: str) -> str:
    """Of page and payload, so that a writer knows the id of the response that a revisit refers to."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id}\n{digest}'.encode()).digest()[:16], version=5)}>"


def keepers(pages: DataFrame) -> DataFrame:
    """``digest, keeper``: of payloads that occur twice or more, the largest page id."""
    own = pages.select("page_id", _payload().alias("_p")).where(F.octet_length("_p") >= REVISIT_BYTES)
    return own.groupBy(_told(F.col("_p")).alias("digest")).agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1 and keeper is not null").select("digest", "keeper")


def _payload() -> Column:
    return F.coalesce("html", F.lit("")).cast("binary")


def _told(payload: Column) -> Column:
    return F.concat(F.sha2(payload, 256), F.octet_length(payload).cast("string"))


def _head(page_id: str | None, url: str | None, date: str, digest: str, keeper: str | None, length: int) -> bytes:
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or f"urn:page:{quote(str(page_id), safe='')}")
    fields = [("WARC-Type", "response" if keeper is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date), ("WARC-Target-URI", uri)]
    fields += [("WARC-Payload-Digest", f"sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")]
    fields += [] if page_id is None else [("Page-ID", quote(page_id, safe=""))]
    fields += [("Content-Type", "application/http;msgtype=response")] if keeper is None else [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(keeper, digest))]
    return (CRLF.join(["WARC/1.1", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {length}"]) + CRLF).encode()


def record(page_id: str | None, url: str | None, payload: memoryview, keeper: str | None, date: str, most: int = CHUNK) -> Iterator[bytes | memoryview]:
    """The rows of a record, none with more than ``most`` bytes of payload; each is followed by CRLF in the archive."""
    n, digest = len(payload), hashlib.sha1(payload, usedforsecurity=False).hexdigest()
    if keeper is not None:
        yield from (_head(page_id, url, date, digest, keeper, 0), b"", b"")
    elif n <= most:
        http = f"{HTTP}Content-Length: {n}{CRLF}".encode()
        yield from (_head(page_id, url, date, digest, None, len(http) + len(CRLF) + n), http, payload, b"")
    else:
        http, sizes = f"{HTTP}Transfer-Encoding: chunked{CRLF}".encode(), [min(most, n - a) for a in range(0, n, most)]
        framing = sum(len(f"{s:x}") + 2 * len(CRLF) for s in sizes) + len("0") + 2 * len(CRLF)
        yield from (_head(page_id, url, date, digest, None, len(http) + len(CRLF) + n + framing), http)
        for i, size in enumerate(sizes):
            yield f"{size:x}".encode()
            yield payload[i * most : i * most + size]
        yield from (b"0", b"", b"", b"")


def write(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", most: int = CHUNK) -> None:
    """Archives of all pages in ``path``: a response or a revisit record for each row. Payloads of more
    than ``most`` bytes are cut."""
    spark = pages.sparkSession
    ship(spark)
    found = written(keepers(pages), "keepers")
    own = pages.select("page_id", F.col("page_id").cast("string").alias("id"), "url", _payload().alias("payload"))
    alone = F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))  # no digest: such rows meet no group and are spread
    own = own.withColumn("digest", F.when(F.octet_length("payload") >= REVISIT_BYTES, _told(F.col("payload"))).otherwise(alone))
    joined = own.join(rows.near(found, found.count()), "digest", "left")
    other = F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper").cast("string"))
    slim = joined.select("id", "url", "payload", other.alias("keeper"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, keeper = (batch.column(k)[i] for k in range(4))
                for line in record(page_id.as_py(), url.as_py(), memoryview(payload.as_buffer()), keeper.as_py(), date, most):
                    held.append(line)
                    size += len(line)
                    if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["line"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["line"])

    lines = slim.mapInArrow(run, "line binary")
    lines.select(F.col("line").cast("string")).write.option("lineSep", CRLF).option("compression", "gzip").text(path)


class Source:
    """Bytes that come in pieces of any size: lines, and whatever is there up to a number of bytes."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held, self.at = pieces, b"", 0

    def _more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.held, self.at = self.held[self.at :] + piece, 0
        return True

    def line(self) -> bytes | None:
        """Up to the next line feed, without it and a CR before it; None at the end."""
        while (end := self.held.find(b"\n", self.at)) < 0:
            if not self._more():
                end, rest = len(self.held), self.held[self.at :]
                self.at = end
                return rest or None
        out, self.at = self.held[self.at : end], end + 1
        return out.removesuffix(b"\r")

    def some(self, n: int) -> bytes:
        """One byte or more, at most ``n``; raises EOFError where an archive is cut off."""
        if self.at == len(self.held):
            self.held, self.at = b"", 0
            if not self._more():
                raise EOFError("the archive ends within a record")
        out = self.held[self.at : self.at + n]
        self.at += len(out)
        return out


def _fields(line, first: bytes) -> tuple[bytes, dict[str, str]]:
    """The first line and the fields, by lower-case name, of a head that ends with an empty line."""
    fields: dict[str, str] = {}
    while own := line():
        name, _, value = own.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    return first, fields


class Block:
    """The block of a record: ``length`` bytes of the source."""

    def __init__(self, source: Source, length: int):
        self.source, self.left = source, length

    def some(self, n: int) -> bytes:
        out = self.source.some(min(n, self.left))
        self.left -= len(out)
        return out

    def line(self) -> bytes:
        out = bytearray()
        while self.left:
            byte = self.some(1)
            if byte == b"\n":
                break
            out += byte
        return bytes(out.removesuffix(b"\r"))

    def exactly(self, n: int) -> Iterator[bytes]:
        while n:
            part = self.some(min(n, CHUNK))
            n -= len(part)
            yield part

    def payload(self, http: bool) -> Iterator[bytes]:
        """The payload in parts: of an HTTP message the body, out of its transfer chunks."""
        chunked = False
        if http:
            _, fields = _fields(self.line, self.line())
            chunked = "chunked" in fields.get("transfer-encoding", "").lower()
        if chunked:
            while size := int(self.line().split(b";")[0] or b"0", 16):
                yield from self.exactly(size)
                self.line()
        else:
            yield from self.exactly(self.left)
        for _ in self.exactly(self.left):
            pass


def _chunks(parts: Iterator[bytes], most: int) -> Iterator[tuple[bytes, bool]]:
    """Parts put together to chunks of ``most`` bytes, the last one marked; one empty chunk if there are none."""
    held, size = [], 0
    for part in parts:
        while size + len(part) > most:
            room = most - size
            yield b"".join([*held, part[:room]]), False
            held, size, part = [], 0, part[room:]
        held.append(part)
        size += len(part)
    yield b"".join(held), True


def parsed(source: Source, most: int = CHUNK) -> Iterator[tuple]:
    """Rows ``record_id, page_id, record_type, uri, refers_to, said, chunk, data, size, digest, last`` of one archive.

    ``size`` and ``digest`` (SHA-1) are those of the payload up to and with the chunk; ``said`` is the
    digest in the record's head, if it is a SHA-1 in base 32 or hex.
    """
    while (first := source.line()) is not None:
        if not first.startswith(b"WARC/"):
            if first:
                raise ValueError(f"no record begins with {first[:40]!r}")
            continue
        _, head = _fields(source.line, first)
        block = Block(source, int(head.get("content-length", 0)))
        http = head.get("content-type", "").startswith("application/http")
        page = unquote(head["page-id"]) if "page-id" in head else None
        own = head.get("warc-record-id"), page, head.get("warc-type"), head.get("warc-target-uri"), head.get("warc-refers-to"), _said(head.get("warc-payload-digest", ""))
        digest, size = hashlib.sha1(usedforsecurity=False), 0
        for chunk, (data, last) in enumerate(_chunks(block.payload(http), most)):
            digest.update(data)
            size += len(data)
            yield *own, chunk, data, size, digest.hexdigest(), last


def _said(field: str) -> str | None:
    kind, _, value = field.partition(":")
    if kind.lower() != "sha1":
        return None
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper() + "=" * (-len(value) % 8)).hex()


COLUMNS = "record_id string, page_id string, record_type string, uri string, refers_to string, said string, chunk long, data binary, size long, digest string, last boolean"


def chunks(spark: SparkSession, path: str, data: bool = True, most: int = CHUNK) -> DataFrame:
    """The table of chunks, each of ``most`` bytes but the last of a record, of all archives in ``path`` (see
    ``parsed``); without ``data`` that column is null.

    Gzip archives are not split. Others may be, and their lines are brought together by file first.
    """
    ship(spark)
    text = spark.read.option("lineSep", CRLF).text(path)
    if all(f.endswith(".gz") for f in text.inputFiles()):
        lines = text.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))
    else:
        placed = text.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("line"))
        lines = placed.repartition("file").sortWithinPartitions("file", "start", "at").select("file", "line")
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    kinds = [*[pa.string()] * 6, pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], k) for i, k in enumerate(kinds)], names)

        flat = ((f, line) for b in batches for f, line in zip(b.column(0).to_pylist(), b.column(1), strict=True))
        for _, own in groupby(flat, itemgetter(0)):
            for row in parsed(Source(line.as_py() + b"\r\n" for _, line in own), most):
                held.append(row if data else (*row[:7], None, *row[8:]))
                size += len(row[7]) if data else 0
                if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return lines.mapInArrow(run, COLUMNS)


def records(chunk_rows: DataFrame) -> DataFrame:
    """A row for each record: the last of its chunks, which knows the whole payload. A revisit gets size,
    digest and page of the response that it refers to. ``intact``: the digest is the one the head has."""
    last = written(chunk_rows.where("last").drop("data", "chunk", "last"), "records")
    own = last.where("record_type <> 'revisit'")
    whole = own.groupBy("record_id").agg(F.first(F.struct("page_id", "size", "digest")).alias("of"))
    again = last.where("record_type = 'revisit'").alias("a").join(whole.alias("w"), F.col("a.refers_to") == F.col("w.record_id"), "left")
    again = again.select("a.record_id", "a.page_id", "a.record_type", "a.uri", F.col("w.of.page_id").alias("refers_to"), "a.said", "w.of.size", "w.of.digest")
    both = own.withColumn("refers_to", F.lit(None).cast("string")).unionByName(again)
    return both.withColumn("intact", F.coalesce(F.col("said") == F.col("digest"), F.col("said").isNull()))
