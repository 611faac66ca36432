"""Digests of texts that are joined in order, as streams over sorted rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.session import ship

#: Results that are gathered before they leave the task.
EMIT = 4096


def joined_sha256(rows: DataFrame, key: Column, order: list[Column], value: Column, separator: str, dealt: int | None = None) -> DataFrame:
    """``key, n, sha256``: per key, how many values there are and the digest of all, in order, joined.

    SHA-256 has to see its bytes one after the other, so a key's values pass through one task, as a
    sorted stream of which the task holds one batch; Spark's sort spills. Nulls come first, null keys are one key,
    and null values count as empty. ``dealt`` is the number of partitions, else that of the session.
    """
    ship(rows.sparkSession)
    named = rows.select(key.alias("key"), *[c.alias(f"o{i}") for i, c in enumerate(order)], value.alias("value"))
    spread = named.repartition(dealt, "key") if dealt else named.repartition("key")
    stream = spread.sortWithinPartitions("key", *[F.col(f"o{i}") for i in range(len(order))]).select("key", "value")
    schema = T.StructType([stream.schema["key"], T.StructField("n", T.LongType()), T.StructField("sha256", T.StringType())])
    gap = separator.encode()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, done, begun, at, n, digest = None, [], False, None, 0, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.string())], ["key", "n", "sha256"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                if not begun or k != at:
                    if begun:
                        done.append((at, n, digest.hexdigest()))
                        if len(done) == EMIT:
                            yield out()
                            done = []
                    begun, at, n, digest = True, k, 0, hashlib.sha256()
                elif n:
                    digest.update(gap)
                digest.update(text.as_py() or b"")
                n += 1
        if begun:
            done.append((at, n, digest.hexdigest()))
            yield out()

    return stream.mapInArrow(run, schema)
