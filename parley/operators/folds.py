"""Decisions that depend on earlier ones, as folds over the ordered rows of a key.

A fold keeps a small state and gives output rows. ``in_order`` runs it over a table, where sorted rows
pass through tasks in batches; ``parley.streaming.live`` runs the same fold over a stream. Rows without
a time or a number (``seq``) are left out by both.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from parley.operators.boundaries import STATE, Assembler, Policy
from parley.operators.dedup import KEPT, LEAST, Memory
from parley.session import ship


class Fold:
    """``columns``: what of a row is used besides time and number. ``out``: columns of the result besides
    the key. ``state``: columns of the packed state; with ``parts``, (key, value) columns of a map instead."""

    columns: tuple[str, ...] = ()
    out = ""
    state = ""
    parts: tuple[str, str] | None = None

    def begin(self) -> object:
        raise NotImplementedError

    def add(self, own: object, time: int, seq: int, *row: object) -> Iterable[tuple]:
        """Output of one row."""
        raise NotImplementedError

    def due(self, own: object) -> int | None:
        """The time (microseconds) after which, without a further row, ``close`` gives something."""
        return None

    def close(self, own: object) -> Iterable[tuple]:
        """Output of silence; also at the end."""
        return ()

    def pack(self, own: object) -> tuple:
        raise NotImplementedError

    def unpack(self, values: tuple) -> object:
        raise NotImplementedError


class Utterances(Fold):
    """Utterances by boundary kinds (see ``boundaries``); what silence ends is ``stale``."""

    columns, out, state = ("energy",), "start_us long, end_us long, frames long, reason string", STATE

    def __init__(self, policy: Policy, unit_us: int = 1000):
        self.policy, self.unit_us = policy, unit_us

    def begin(self) -> Assembler:
        return Assembler(self.policy, self.unit_us)

    def add(self, own: Assembler, time: int, seq: int, energy: float) -> Iterable[tuple]:
        return list(own.add(time, energy))

    def due(self, own: Assembler) -> int | None:
        return None if own.start is None else own.last + 2 * self.policy.shortest_ms * self.unit_us

    def close(self, own: Assembler) -> Iterable[tuple]:
        return [] if own.start is None else [own.close("stale")]

    def pack(self, own: Assembler) -> tuple:
        return own.pack()

    def unpack(self, values: tuple) -> Assembler:
        return Assembler.unpack(self.policy, self.unit_us, values)


class Silences(Fold):
    """Utterances that end after ``silent`` silent frames once they last ``shortest``, when they reach
    ``longest``, or ``stale`` after their last frame; seconds of ``unit_us`` microseconds."""

    columns, out = ("energy",), "start_us long, end_us long, frames long, energy double, reason string"
    state = "start long, last long, frames long, total double, quiet long"

    def __init__(self, over: float, silent: int = 3, shortest: float = 4.5, longest: float = 20.0, stale: float = 9.0, unit_us: int = 1_000_000):
        self.over, self.silent = over, silent
        self.shortest, self.longest, self.stale = (round(x * unit_us) for x in (shortest, longest, stale))

    def begin(self) -> list:
        return [-1, -1, 0, 0.0, 0]

    def _end(self, own: list, reason: str) -> tuple:
        out = own[0], own[1], own[2], own[3] / own[2], reason
        own[:] = -1, own[1], 0, 0.0, 0
        return out

    def add(self, own: list, time: int, seq: int, energy: float) -> Iterable[tuple]:
        out = [self._end(own, "stale")] if own[2] and time - own[1] >= self.stale else []
        speech = energy > self.over
        if speech or own[2]:
            own[:] = own[0] if own[2] else time, time, own[2] + 1, own[3] + float(energy), 0 if speech else own[4] + 1
            if own[1] - own[0] >= self.longest:
                out.append(self._end(own, "longest"))
            elif own[4] >= self.silent and own[1] - own[0] >= self.shortest:
                out.append(self._end(own, "silence"))
        return out

    def due(self, own: list) -> int | None:
        return own[1] + self.stale if own[2] else None

    def close(self, own: list) -> Iterable[tuple]:
        return [self._end(own, "stale")] if own[2] else []

    def pack(self, own: list) -> tuple:
        return tuple(own)

    def unpack(self, values: tuple) -> list:
        return list(values)


class Repeats(Fold):
    """Whether a normalised text repeats one of the last accepted ones (see ``dedup``)."""

    columns, out, state = ("normal", "mark"), "seq long, duplicate boolean", "texts array<string>, keys array<string>"

    def __init__(self, kept: int = KEPT, least: float = LEAST):
        self.kept, self.least = kept, least

    def begin(self) -> Memory:
        return Memory((), self.kept, self.least)

    def add(self, own: Memory, time: int, seq: int, normal: str, mark: str) -> Iterable[tuple]:
        return [(seq, own.repeats(normal, mark))]

    def pack(self, own: Memory) -> tuple:
        return [t for t, _ in own.texts], [k for _, k in own.texts]

    def unpack(self, values: tuple) -> Memory:
        return Memory(list(zip(*values, strict=True)), self.kept, self.least)


class Correction(Fold):
    """Segments as they are taken in: those of bad timing that overlap what is remembered move behind it,
    those that still overlap merge with all they overlap, which are then forgotten. ``kept`` are remembered."""

    columns = ("start_ms", "end_ms", "text", "speaker", "confidence")
    out = "seq long, start_ms long, end_ms long, text string, speaker string, confidence double, merged long"
    state = "starts array<long>, ends array<long>, texts array<string>, speakers array<string>, confidences array<double>"

    def __init__(self, kept: int = 10, overlap: int = 300, gap: int = 100, least: int = 100, most: int = 60_000, late: int = 5_000):
        self.kept, self.overlap, self.gap, self.least, self.most, self.late = kept, overlap, gap, least, most, late

    def begin(self) -> list:
        return []

    def add(self, own: list, time: int, seq: int, a: int, b: int, text: str, who: str, c: float) -> Iterable[tuple]:
        meets = lambda h: h[0] < b and a < h[1]
        fine = a >= 0 and b > a and self.least <= b - a <= self.most and not (own and a < own[-1][0] - self.late)
        if not fine and any(map(meets, own)):
            length, start = b - a, a
            for h in reversed(own):
                if a >= h[1] - self.overlap:
                    break
                start = h[1] + self.gap
            a, b = start, start + length
        hit = []
        for h in own:
            if meets(h):
                hit.append(h)
                who = who if c > h[4] else h[3]
                text = text if h[2] in text else h[2] if text in h[2] else f"{text} {h[2]}"
                a, b, c = min(a, h[0]), max(b, h[1]), (c + h[4]) / 2
        own[:] = [h for h in own if h not in hit] if hit else sorted([*own, (a, b, text, who, c)], key=lambda h: h[0])[-self.kept :]
        return [(seq, a, b, text, who, c, len(hit))]

    def pack(self, own: list) -> tuple:
        return tuple([h[i] for h in own] for i in range(5))

    def unpack(self, values: tuple) -> list:
        return list(zip(*values, strict=True))


class VoiceActivity(Fold):
    """Chunks of samples: speech segments at stream time, with a threshold adapted to each chunk's noise.

    The state is the stream's position, the threshold, and the last samples as bounded context. Halves
    of 100 ms windows are judged by energy and centre of mass; long segments are cut in equal parts. A
    chunk without samples has no speech and changes nothing.
    """

    columns = ("samples",)
    out = "seq long, offset_s double, segments array<struct<start_s: double, end_s: double, confidence: double>>, confidence double, threshold double, snr_db double, clipping boolean"
    state = "position double, threshold double, context array<double>"

    def __init__(self, threshold: float = 0.5, adaptive: bool = True, least_ms: float = 250, most_ms: float = 30_000, context: int = 64 * 512, rate: int = 16_000):
        self.threshold, self.adaptive, self.least_ms, self.most_ms, self.context, self.rate = threshold, adaptive, least_ms, most_ms, context, rate

    def begin(self) -> list:
        return [0.0, self.threshold, []]

    def add(self, own: list, time: int, seq: int, samples: Iterable[float]) -> Iterable[tuple]:
        x = np.asarray([] if samples is None else samples, float)
        if not len(x):
            return [(seq, own[0], [], 0.1, own[1], None, False)]
        sizes = np.sort(np.abs(x))
        floor, power = float(sizes[len(x) // 4]), float(np.mean(x * x))
        snr = 10 * math.log10(power / (floor * floor)) if floor > 0 else None
        if self.adaptive and snr is not None:
            own[1] = min(0.9, self.threshold + (0.3 if snr < 10 else 0.2 if snr < 20 else 0.1 if snr < 30 else 0.0))
        own[2] = (own[2] + x[-self.context :].tolist())[-self.context :]
        found = list(self._segments(x, own[0], own[1]))
        out = seq, own[0], found, sum(f[2] for f in found) / len(found) if found else 0.1, own[1], snr, bool((sizes > 0.95).sum() > len(x) // 100)
        own[0] += len(x) / self.rate
        return [out]

    def _segments(self, x: np.ndarray, offset: float, threshold: float) -> Iterator[tuple[float, float, float]]:
        hop, now = int(self.rate * 0.1) // 2, None
        for i in [*range(0, len(x), hop), None]:
            likely = -1.0
            if i is not None:
                part = np.abs(x[i : i + hop])
                mass = part.sum()
                centre = float((np.arange(len(part)) * part).sum() / mass) if mass > 0 else 0.0
                likely = min(1.0, (0.6 if float(np.mean(part * part)) > 0.01 else 0.0) + (0.4 if 10 < centre < 1000 else 0.0))
            if i is not None and likely > threshold:
                start = offset + i / self.rate
                now = (start, start + hop / self.rate, likely) if now is None else (now[0], start + hop / self.rate, (now[2] + likely) / 2)
            elif now is not None:
                length = now[1] - now[0]
                if length * 1000 >= self.least_ms:
                    n = max(1, math.ceil(length / (self.most_ms / 1000)))
                    yield from ((now[0] + k * length / n, min(now[0] + (k + 1) * length / n, now[1]), now[2]) for k in range(n))
                now = None

    def pack(self, own: list) -> tuple:
        return tuple(own)

    def unpack(self, values: tuple) -> list:
        return [values[0], values[1], list(values[2])]


class OnlineClusters(Fold):
    """Each vector in turn joins the cluster with the best mean similarity above ``over``, or opens one.

    A cluster is the sum of its unit vectors and their number; a stream keeps them as a map and writes
    only the one that changed.
    """

    columns, out = ("vector",), "seq long, cluster long"
    parts = ("cluster long", "total array<double>, n long")

    def __init__(self, over: float):
        self.over = over

    def begin(self) -> dict:
        return {}

    def add(self, own: dict, time: int, seq: int, vector: Iterable[float]) -> Iterable[tuple]:
        v = np.asarray(vector, float)
        size = np.linalg.norm(v)
        u = v / size if size > 0 else v
        scores = [float(u @ own[k][0]) / own[k][1] for k in range(len(own))]
        best = int(np.argmax(scores)) if scores else -1
        at = best if best >= 0 and scores[best] > self.over else len(own)
        total, n = own.get(at, (np.zeros(len(u)), 0))
        own[at] = total + u, n + 1
        return [(seq, at)]

    def pack_part(self, part: tuple) -> tuple:
        return part[0].tolist(), part[1]

    def unpack_part(self, values: tuple) -> tuple:
        return np.asarray(values[0], float), values[1]


def arrow_rows(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    own = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(own)], own.names)


def _dicts(row: tuple, fold: Fold) -> tuple:
    """Segments as structs."""
    return tuple([dict(zip(("start_s", "end_s", "confidence"), x, strict=True)) for x in v] if isinstance(v, list) else v for v in row) if isinstance(fold, VoiceActivity) else row


def result_schema(rows: DataFrame, fold: Fold, key: str) -> T.StructType:
    return T.StructType([T.StructField(key, rows.schema[key].dataType), *T.StructType.fromDDL(fold.out).fields])


def _values(column: pa.Array) -> list:
    """Values of a column; lists of numbers as arrays."""
    if not (pa.types.is_list(column.type) and pa.types.is_float64(column.type.value_type)):
        return column.to_pylist()
    return [x.values.to_numpy(zero_copy_only=False) if x.is_valid else None for x in column]


def in_order(rows: DataFrame, fold: Fold, key: str, time: str = "t_us", order: str = "seq", **made: Column) -> DataFrame:
    """``key`` and the fold's output. A key's rows come to one task, sorted, which holds a batch and a state.

    ``made`` are columns of the fold that are large and follow from smaller ones: they are made after the
    sort, row by row, so that they are neither moved nor sorted.
    """
    ship(rows.sparkSession)
    schema = result_schema(rows, fold, key)
    slim = rows.where(f"`{time}` is not null and `{order}` is not null")
    if not made:
        slim = slim.select(key, time, order, *fold.columns)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, begun = None, None, False
        for batch in batches:
            out: list[tuple] = []
            for group, *row in zip(*map(_values, batch.columns), strict=True):
                if not begun or group != now:
                    if begun:
                        out += [(now, *x) for x in fold.close(own)]
                    now, own, begun = group, fold.begin(), True
                out += [(group, *_dicts(x, fold)) for x in fold.add(own, *row)]
            yield arrow_rows(out, schema)
        if begun:
            yield arrow_rows([(now, *x) for x in fold.close(own)], schema)

    own = slim.repartition(key).sortWithinPartitions(key, time, order)
    return own.select(key, time, order, *[made[c].alias(c) if c in made else c for c in fold.columns]).mapInArrow(run, schema)
