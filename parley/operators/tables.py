"""Stored keyed tables: Parquet in folders by a bucket of the key, of which a change rewrites only those it touches.

A change reads the touched buckets, is staged in the shared folder, and then replaces these buckets'
files by dynamic partition overwrite; buckets that end up empty are removed. Files of other buckets are
not read and keep their names. Writers do not lock: one at a time for each table. What a change does to
the rows of the touched buckets are the functions of ``store``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.operators import store
from parley.session import discard, written

BUCKET = "_bucket"


class KeyedTable:
    """A table in the folder ``path`` with the key ``key``, of ``buckets`` buckets."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = 32):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str, buckets: int = 32) -> KeyedTable:
        """A new table of ``rows``; the folder must not be there. A null key has a bucket like any other."""
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
        table = cls(rows.sparkSession, path, schema, key, buckets)
        table._placed(rows).write.partitionBy(BUCKET).parquet(path)
        return table

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(f"`{self.key}`")), F.lit(self.buckets)).cast("int")

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, self._bucket()).repartition(self.buckets, BUCKET)

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().drop(BUCKET)

    def lookup(self, *keys: object) -> DataFrame:
        """Rows of the given keys; only their buckets are read."""
        asked = self.spark.createDataFrame([(k,) for k in keys], T.StructType([T.StructField(self.key, self.schema[self.key].dataType)]))
        return self._stored().where(F.col(BUCKET).isin(self._touched(asked))).drop(BUCKET).join(F.broadcast(asked.distinct()), self.key, "left_semi")

    def _touched(self, keys: DataFrame) -> list[int]:
        return sorted(r[0] for r in keys.select(self._bucket().alias(BUCKET)).distinct().collect())

    def append(self, fresh: DataFrame) -> None:
        """Rows with keys that are new or may repeat; nothing is read or rewritten."""
        self._placed(fresh.select(*self.schema.names)).write.mode("append").partitionBy(BUCKET).parquet(self.path)

    def change(self, keys: DataFrame, by: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Rewrites the buckets of ``keys`` as ``by`` changes their rows; gives these buckets."""
        touched = self._touched(keys)
        if not touched:
            return []
        old = self._stored().where(F.col(BUCKET).isin(touched)).drop(BUCKET)
        fresh = written(self._placed(by(old).select(*self.schema.names)), "staged")
        left = {r[0] for r in fresh.select(BUCKET).distinct().collect()}
        if not left <= set(touched):
            raise ValueError("a change must not move rows to other keys' buckets")
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        for gone in set(touched) - left:
            discard(self.spark, f"{self.path}/{BUCKET}={gone}")
        self.spark.catalog.refreshByPath(self.path)
        return touched

    def update(self, changes: DataFrame) -> list[int]:
        """The non-null cells of ``changes`` put in; keys that are not there are left out."""
        return self.change(changes, lambda old: store.update(old, changes, self.key))

    def upsert(self, fresh: DataFrame) -> list[int]:
        """Rows of ``fresh`` in the place of those with their key, or added."""
        return self.change(fresh, lambda old: store.upsert(old, fresh.select(*old.columns), self.key))

    def delete(self, keys: DataFrame, *children: KeyedTable) -> list[int]:
        """Rows with the keys go, those of child tables (with the same key) before them."""
        for child in children:
            child.delete(keys)
        return self.change(keys, lambda old: store.delete(old, keys, self.key))

    def clear(self, *children: KeyedTable) -> None:
        """All rows go, children first."""
        for table in (*children, self):
            discard(table.spark, table.path)
            table.spark.createDataFrame([], table.schema).withColumn(BUCKET, F.lit(0)).write.parquet(f"{table.path}/{BUCKET}=0")
            table.spark.catalog.refreshByPath(table.path)
