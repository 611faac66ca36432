"""Benchmark decontamination: an FM-index for each block of documents, searched for test phrases.

A block of documents becomes a sequence of word numbers (numbers are given to words of the
benchmark only). Windows are told apart by their last words: where none of these endings occurs, no
window can, so only the words before an ending go into an FM-index, and only windows with an ending
that occurs are searched backwards. The cost of a block thus follows what may occur in it, not the
size of the benchmark. Occurrences are located by sampled positions, confirmed byte for byte, and
merged into spans. Documents never leave their task: no shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm import words
from parley.llm.fm_index import FMIndex
from parley.session import ship, written

#: Words of a window, and last words of it that are looked up first.
WINDOW, ENDING = 13, 4
#: Bytes of the benchmark that one pass over the documents searches for, arrays of ``WORD_BYTES`` for
#: each word included (so about 2.3 million words); more take more passes.
PASS_BYTES, WORD_BYTES = 160_000_000, 64
#: A document is contaminated if at least one word in so many is hit.
SHARE = 20

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("starts", T.ArrayType(T.LongType())),
        T.StructField("ends", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


class Phrases:
    """The distinct windows of some benchmark items, in a few flat arrays.

    ``numbers`` are the words of all items one after the other; window ``w`` is the ``lengths[w]`` words
    from ``starts[w]``, and of the items ``items[bounds[w]:bounds[w + 1]]``.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.names = [name for name, _ in items]
        self.window = window
        hashes, count = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        spelled: dict[int, bytes] = {}
        for a, b in words.blocks([text for _, text in items]):
            table = words.Table([text for _, text in items[a:b]])
            for own, i in zip(*(x.tolist() for x in np.unique(table.hash, return_index=True)), strict=True):
                if own not in spelled:
                    spelled[own] = table.word(i)
            hashes.append(table.hash)
            count.append(table.count)
        self.vocabulary, number = np.unique(np.concatenate(hashes), return_inverse=True)
        self.numbers = number.astype(np.int32)
        self.spelled = [spelled[own] for own in self.vocabulary.tolist()]
        self._windows(np.concatenate(count))
        self.shortest = int(self.lengths.min()) if len(self.lengths) else 0
        self.endings: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in range(1, ENDING + 1):
            own = np.flatnonzero(np.minimum(self.lengths, ENDING) == size)
            if len(own):
                last = self.starts[own] + self.lengths[own] - size
                code = _codes((self.numbers[last + k] for k in range(size)), len(own))
                order = np.argsort(code, kind="stable")
                self.endings[size] = code[order], own[order].astype(np.int32)

    def _windows(self, count: np.ndarray) -> None:
        """Windows of items of ``count`` words each; equal ones are one. Where unlike windows share a
        code, all of that code stay apart, which makes them no less right."""
        many = np.where(count > 0, np.maximum(1, count - self.window + 1), 0)
        item = np.repeat(np.arange(len(count), dtype=np.int32), many)
        start = np.arange(len(item)) - np.repeat(np.cumsum(many) - many - (np.cumsum(count) - count), many)
        length = np.minimum(count[item], self.window)

        def column(k: int, of: np.ndarray = slice(None)) -> np.ndarray:
            return np.where(k < length[of], self.numbers[np.minimum(start[of] + k, len(self.numbers) - 1)], -1)

        code = _codes((column(k) for k in range(self.window)), len(item)) if len(item) else np.empty(0, np.uint64)
        order = np.argsort(code, kind="stable").astype(np.int32)
        code = code[order]
        fresh = np.concatenate(([True], code[1:] != code[:-1]))[: len(order)]
        group = np.cumsum(fresh) - 1
        leader = order[np.flatnonzero(fresh)][group]
        unlike = np.zeros(len(order), bool)
        for k in range(self.window if len(order) else 0):
            unlike |= column(k, order) != column(k, leader)
        if unlike.any():
            fresh |= np.isin(group, group[unlike])
        item = item[order]
        head = np.flatnonzero(fresh)
        once = fresh | np.concatenate(([True], item[1:] != item[:-1]))[: len(item)]
        self.starts, self.lengths = start[order[head]].astype(np.int32), length[order[head]].astype(np.int32)
        self.items, self.bounds = item[once], np.append(np.cumsum(once)[head] - 1, once.sum()).astype(np.int32)

    def rows(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of windows, right-aligned, and which cells of a row are of its window."""
        start, length = self.starts[windows][:, None].astype(np.int64), self.lengths[windows][:, None]
        at = start + np.arange(self.window) - (self.window - length)
        inside = at >= start
        return np.where(inside, self.numbers[np.maximum(at, 0)], 0), inside

    def items_of(self, windows: np.ndarray) -> list[str]:
        """Names of the items that any of the windows is of."""
        found = np.unique(np.concatenate([self.items[self.bounds[w] : self.bounds[w + 1]] for w in windows]))
        return [self.names[i] for i in found]


def _codes(columns: Iterable[np.ndarray], count: int) -> np.ndarray:
    """A 64-bit code of each of ``count`` rows of word numbers; unlike rows may share one."""
    code = np.zeros(count, np.uint64)
    for numbers in columns:
        code = (code ^ (numbers.astype(np.uint64) + np.uint64(1))) * np.uint64(words.BASE)
        code ^= code >> np.uint64(29)
    return code


def _possible(number: np.ndarray, start: np.ndarray, end: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Windows whose last words occur in the stretches, and which words may be of an occurrence."""
    live, near = [], np.zeros(len(number) + 1, np.int64)
    for size, (codes, windows) in phrases.endings.items():
        room = np.maximum(0, end - start - size + 1)
        at = np.repeat(start - (np.cumsum(room) - room), room) + np.arange(int(room.sum()))
        own = _codes((number[at + k] for k in range(size)), len(at))
        low, high = np.searchsorted(codes, own), np.searchsorted(codes, own, "right")
        hit = np.flatnonzero(low < high)
        if not len(hit):
            continue
        pairs = np.unique(np.stack((low[hit], high[hit]), 1), axis=0)
        many = pairs[:, 1] - pairs[:, 0]
        live.append(windows[np.repeat(pairs[:, 0] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))])
        longest = int(phrases.lengths[live[-1]].max())
        first = np.repeat(start, room)[hit]
        np.add.at(near, np.maximum(first, at[hit] + size - longest), 1)
        np.add.at(near, at[hit] + size, -1)
    return np.concatenate(live) if live else np.empty(0, np.int64), np.cumsum(near)[:-1] > 0


def _stretches(known: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of known words within one document, at least ``least`` long."""
    n = len(known)
    same = np.empty(n + 1, bool)
    same[0] = same[n] = False
    same[1:n] = known[1:] & known[:-1] & (doc[1:] == doc[:-1])
    start, end = np.flatnonzero(known & ~same[:n]), np.flatnonzero(known & ~same[1:]) + 1
    enough = end - start >= least
    return start[enough], end[enough]


def occurrences(table: words.Table, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every occurrence of a window in a block."""
    nothing = np.empty(0, np.int64), np.empty(0, np.int64)
    if not len(phrases.lengths) or not len(table.start):
        return nothing
    number = np.searchsorted(phrases.vocabulary, table.hash)
    number[number == len(phrases.vocabulary)] = 0
    known = phrases.vocabulary[number] == table.hash
    start, end = _stretches(known, table.doc, phrases.shortest)
    live, near = _possible(number, start, end, phrases)
    if not len(live):
        return nothing
    start, end = _stretches(near, table.doc, phrases.shortest)
    size = end - start
    offset = np.cumsum(size + 1) - size - 1
    at = np.repeat(start - offset, size + 1) + np.arange(int((size + 1).sum()))
    gap = np.cumsum(size + 1) - 1
    sigma = len(phrases.vocabulary) + 1
    sequence = np.where(np.isin(np.arange(len(at)), gap, assume_unique=True), sigma - 1, number[np.minimum(at, len(number) - 1)])
    # numbers of this block's words only, so that the alphabet and its table stay small
    present, sequence = np.unique(np.append(sequence, sigma - 1), return_inverse=True)
    index = FMIndex(sequence[:-1], len(present))
    rows_of, inside = phrases.rows(live)
    wanted = np.searchsorted(present, rows_of)
    whole = ((present[np.minimum(wanted, len(present) - 1)] == rows_of) | ~inside).all(1)
    live, wanted = live[whole], np.where(inside, wanted, 0)[whole]
    low, high = index.search(wanted, phrases.lengths[live])
    many = high - low
    rows = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    first, window = at[index.locate(rows)], np.repeat(live, many)
    covered = np.zeros(len(known) + 1, np.int64)
    np.add.at(covered, first, 1)
    np.add.at(covered, first + phrases.lengths[window], -1)
    hit = np.flatnonzero(np.cumsum(covered)[:-1] > 0)
    wrong = np.array([table.word(i) != phrases.spelled[number[i]] for i in hit], bool)
    bad = np.zeros(len(known) + 1, np.int64)
    bad[hit + 1] = wrong
    bad = np.cumsum(bad)
    sound = bad[first + phrases.lengths[window]] == bad[first]
    return first[sound], window[sound]


def _search(phrases: Phrases, batches: Iterable[pa.RecordBatch], column: str, found: str) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])

    def of(rows: pa.RecordBatch, values: list[bytes]) -> Iterator[pa.RecordBatch]:
        table = words.Table(values)
        first, window = occurrences(table, phrases)
        doc = table.doc[first]
        before = rows.column(rows.schema.get_field_index(found)).to_pylist()
        cells = [{"n_words": int(n), "starts": x["starts"] if x else [], "ends": x["ends"] if x else [], "items": x["items"] if x else []} for n, x in zip(table.count, before, strict=True)]
        order = np.lexsort((first, doc))
        cut = np.flatnonzero(np.diff(doc[order], prepend=-1, append=-1))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            own = order[a:b]
            k = int(doc[own[0]])
            start = first[own] - table.first[k]
            end = start + phrases.lengths[window[own]]
            reach = np.maximum.accumulate(end)
            fresh = np.concatenate(([True], start[1:] > reach[:-1]))
            last = np.concatenate((fresh[1:], [True]))
            cells[k]["starts"] = cells[k]["starts"] + start[fresh].tolist()
            cells[k]["ends"] = cells[k]["ends"] + reach[last].tolist()
            cells[k]["items"] = cells[k]["items"] + phrases.items_of(np.unique(window[own]))
        yield rows.set_column(rows.schema.get_field_index(found), found, pa.array(cells, kind))

    yield from words.by_batch(of, batches, column)


def _passes(benchmark: DataFrame, item_col: str, item_text_col: str, window: int, pass_bytes: int) -> Iterator[tuple]:
    """The phrases of the benchmark, block by block of about ``pass_bytes`` (an item is in one), each sent to the executors
    when it is asked for; and whether there are more."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("i"), F.coalesce(F.col(f"`{item_text_col}`"), F.lit("")).alias("t")).where("i is not null").distinct()
    held = F.octet_length("t") + WORD_BYTES * F.regexp_count("t", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"))
    size = items.agg(F.coalesce(F.sum(held), F.lit(0))).first()[0]
    count = max(1, -(-size // pass_bytes))
    for k in range(count):
        own = items.where(F.pmod(F.xxhash64("i"), F.lit(count)) == k).orderBy("i", "t").collect()
        yield spark.sparkContext.broadcast(Phrases([(r.i, r.t.encode()) for r in own], window)), k + 1 < count


def search(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, pass_bytes: int = PASS_BYTES, found: str = "_found", then=None, schema: T.StructType | None = None) -> DataFrame:
    """``docs`` with a struct column ``found``: n_words, spans of hit words (starts, ends), items.

    Null and empty texts have no words; items without words or without an id have no windows; items
    that occur twice count once. All columns of ``docs`` stay as they are, repeated rows and null
    ids too; ``found`` must not be one of them (ValueError). A benchmark of more than ``pass_bytes``
    is searched for in passes one after the other: each but the last writes its rows into the shared
    folder and takes its broadcast back before the next begins, so one block of the benchmark is
    held at a time. Spans of one pass do not touch; spans of several passes may, see ``merged``.
    ``then`` goes on with the batches of the last pass in the same worker and gives rows of ``schema``.
    """
    if found in docs.columns:
        raise ValueError(f"documents have a column {found}")
    ship(docs.sparkSession)
    out = docs.withColumn(found, F.lit(None).cast(FOUND))
    passes = _passes(benchmark, item_col, item_text_col, window, pass_bytes)
    held, more = next(passes)
    while more:
        out = written(out.mapInArrow(lambda batches, held=held: _search(held.value, batches, text_col, found), out.schema), "passes")
        held.destroy()
        held, more = next(passes)
    if then is None:
        return out.mapInArrow(lambda batches: _search(held.value, batches, text_col, found), out.schema)
    return out.mapInArrow(lambda batches: then(_search(held.value, batches, text_col, found)), schema)


def merged(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """The union of spans as disjoint, sorted spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts, ends, strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _counts(found: list[dict]) -> Iterator[tuple]:
    for x in found:
        hit = sum(b - a for a, b in merged(x["starts"], x["ends"]))
        items = sorted(set(x["items"]))
        yield x["n_words"], hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0 and SHARE * hit >= x["n_words"]


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    slim = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    schema = T.StructType([slim.schema["_id"], *(T.StructField(n, t) for n, t in (("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType())))])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*_counts(batch.column(2).to_pylist()), strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(x), k) for x, k in zip(rows, kinds, strict=True))], schema.names)

    return search(slim, benchmark, "_text", found="_found", then=count, schema=schema, **options)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated, with all their columns.

    A null or empty text is never contaminated; repeated rows and null ids are judged like any other.
    An empty table, or an empty benchmark, gives the documents back. Columns may have any names: the
    spans go under one that is free.
    """
    found = "_found_spans"
    while found in docs.columns:
        found += "_"

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(found)
            good = [not x[-1] for x in _counts(batch.column(at).to_pylist())]
            yield batch.filter(pa.array(good, pa.bool_())).drop_columns([found])

    return search(docs, benchmark, text_col, found=found, then=keep, schema=docs.schema, **options)
