"""Folds over streams: rows wait in keyed state until the watermark has passed them, then go in order.

A key's waiting rows lie in a map by the first stretch of event time they are of, as small Arrow batches
that may go on into later stretches, so that a row of its own in a stretch needs no entry and no timer of
its own. What has been read of a batch and is not due yet waits for the next stretch, or is put back. A
key has one timer, for what comes first: its next stretch, or silence that closes something. So a result does not depend on the order of rows or on
triggers, as long as rows are no later than the watermark allows; later ones are rejected by Spark.
``replay`` ends a stream: a last row far in the future lets the watermark pass everything.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from parley.operators.folds import Fold, result_schema
from parley.session import ship

#: Event time (microseconds) that waiting rows share a stretch of; a day, an hour, a minute are common.
STRETCH = 60_000_000
#: Output rows of a frame, and rows of a waiting batch (64 elements of a list or text count as a row more).
ROWS, WAITING = 4096, 256
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _packed(frame: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


class InOrder(StatefulProcessor):
    """One key's waiting rows, the fold's state, and timers."""

    def __init__(self, fold: Fold, columns: list[str], key: str, names: list[str], stretch: int):
        self.fold, self.columns, self.key, self.names, self.stretch = fold, columns, key, names, stretch

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "stretch long, nth long", "rows binary")
        self.noted = handle.getValueState("noted", "n long, at long")
        self.state = handle.getMapState("state", *self.fold.parts) if self.fold.parts else handle.getValueState("state", self.fold.state)

    def _load(self) -> object:
        if self.fold.parts:
            own = self.fold.begin()
            own.update((k[0], self.fold.unpack_part(v)) for k, v in self.state.iterator())
            self.before = dict(own)
            return own
        own = self.state.get()
        return self.fold.begin() if own is None else self.fold.unpack(own)

    def _save(self, own: object) -> None:
        if self.fold.parts:
            for k, part in own.items():
                if self.before.get(k) is not part:
                    self.state.updateValue((k,), self.fold.pack_part(part))
        else:
            self.state.update(self.fold.pack(own))

    def _stretches(self, frame: pd.DataFrame) -> np.ndarray:
        return frame[self.columns[0]].to_numpy().astype("int64") // self.stretch

    def _wait(self, frame: pd.DataFrame, nth: int) -> tuple[int, int]:
        """Puts rows in order of time by, numbered after ``nth``; gives their first stretch and the last number."""
        size, stretches = np.ones(len(frame)), self._stretches(frame)
        for name in self.columns[2:]:
            if frame[name].dtype == object:
                size += [len(x) / 64 if hasattr(x, "__len__") else 0 for x in frame[name]]
        piece = (np.cumsum(size) // WAITING).astype(int)
        starts = np.flatnonzero(np.diff(piece, prepend=-1)).tolist()
        for a, b in zip(starts, [*starts[1:], len(frame)], strict=True):
            nth += 1
            self.waiting.updateValue((int(stretches[a]), nth), (_packed(frame.iloc[a:b]),))
        return int(stretches[0]), nth

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        n, at = self.noted.get() or (0, None)
        ends, before = [], n
        for frame in rows:
            frame = frame[self.columns].dropna(subset=self.columns[:2])
            if len(frame):
                first, n = self._wait(frame.sort_values(self.columns[:2], kind="stable"), n)
                ends.append(-(-(first + 1) * self.stretch // 1000))
        if ends and (at is None or min(ends) < at):
            if at is not None:
                self.handle.deleteTimer(at)
            at = min(ends)
            self.handle.registerTimer(at)
        if n > before:
            self.noted.update((n, at))
        yield from ()

    def _ready(self, entries: list[tuple[int, int]], end: int) -> Iterator[pd.DataFrame]:
        """Rows of the stretches before ``end`` in order; what the batches hold beyond is put back, which adds to ``entries``."""
        due, last = sorted(e for e in entries if e[0] < end), max((n for _, n in entries), default=0)
        entries[:] = [e for e in entries if e[0] >= end]
        held = None
        for i, entry in enumerate(due):
            part = pa.ipc.open_stream(self.waiting.getValue(entry)[0]).read_pandas()
            self.waiting.removeKey(entry)
            held = [part] if held is None else [*held, part]
            following = due[i + 1][0] if i + 1 < len(due) else end
            if following > entry[0]:
                rows = pd.concat(held).sort_values(self.columns[:2], kind="stable")
                cut = int(np.searchsorted(self._stretches(rows), following))
                yield rows.iloc[:cut]
                held = [rows.iloc[cut:]]
        if held is not None and len(held[0]):
            entries.append(self._wait(held[0], last))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        entries = [tuple(k) for k in self.waiting.keys()]
        own, out = self._load(), []
        for rows in self._ready(entries, passed // self.stretch):
            for time, seq, *row in rows.itertuples(index=False, name=None):
                out += [(key[0], *x) for x in self.fold.add(own, int(time), int(seq), *row)]
                if len(out) >= ROWS:
                    yield pd.DataFrame(out, columns=self.names)
                    out = []
        due = self.fold.due(own)
        if due is not None and due <= passed:
            out += [(key[0], *x) for x in self.fold.close(own)]
            due = None
        self._save(own)
        times = [(s + 1) * self.stretch for s, _ in entries] + ([] if due is None else [due])
        at = -(-min(times) // 1000) if times else None
        if times:
            self.handle.registerTimer(at)
        self.noted.update((max((n for _, n in entries), default=0), at))
        if out:
            yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def folded(events: DataFrame, fold: Fold, key: str, time: str = "t_us", order: str = "seq", stamp: str = "ts", late: str = "5 seconds", stretch: int = STRETCH) -> DataFrame:
    """``folds.in_order`` of a stream: ``stamp`` is the event time as a timestamp, ``time`` in microseconds."""
    ship(events.sparkSession)
    columns = [time, order, *fold.columns]
    schema = result_schema(events, fold, key)
    slim = events.withWatermark(stamp, late).select(key, stamp, *columns)
    return slim.groupBy(key).transformWithStateInPandas(InOrder(fold, columns, key, schema.names, stretch), schema, "append", "EventTime")


def run(stream: DataFrame, out: str, checkpoint: str) -> None:
    """All that is there as a stream into Parquet files; state in RocksDB, kept in the checkpoint."""
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)


def replay(events: DataFrame, live: Callable[[DataFrame], DataFrame], place: str, stamp: str = "ts") -> DataFrame:
    """The result of a stream that has ended: all of ``events``, then a row without key and number at the
    end of what nanoseconds can count, which passes the watermark by everything, so that nothing waits and nothing is open.

    The second run goes on from the first one's checkpoint, as it would after a restart.
    """
    spark = events.sparkSession
    spark.createDataFrame([], events.schema).write.parquet(f"{place}/end")
    both = events.unionByName(spark.readStream.schema(events.schema).parquet(f"{place}/end"))
    run(live(both), f"{place}/out", f"{place}/checkpoint")
    last = [F.expr("timestamp'2262-01-01'").alias(stamp) if f.name == stamp else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema.fields]
    spark.range(1).select(*last).write.mode("append").parquet(f"{place}/end")
    run(live(both), f"{place}/out", f"{place}/checkpoint")
    return spark.read.parquet(f"{place}/out")
