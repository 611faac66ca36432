"""Deep pages: rows stored in order in ranges of known size, so that a page reads only its own ranges.

``offset`` has to sort and skip all rows before a page. Here rows are written once, dealt by ranges of
the order and sorted in each; a directory has the number of rows before each range. A page is then a
few ranges and a place in the first, whichever page it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a range, about.
ROWS = 100_000


class Pages:
    """Stored ordered rows in the folder ``path``; ``place`` numbers them from 0."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path = spark, path
        self.schema = T.StructType([*schema.fields, T.StructField("_nth", T.LongType()), T.StructField("_range", T.IntegerType())])

    @classmethod
    def create(cls, rows: DataFrame, path: str, order: list[Column], rows_per_range: int = ROWS) -> Pages:
        """Writes the rows. ``order`` should name each row; what it leaves equal keeps one order from then on."""
        ranges = max(1, -(-rows.count() // rows_per_range))
        dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
        numbered = dealt.select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_nth"))
        numbered.write.partitionBy("_range").parquet(f"{path}/rows")
        own = cls(rows.sparkSession, path, rows.schema)
        counts = own._rows().groupBy("_range").agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        counts.coalesce(1).select("_range", "n", before.alias("before")).write.parquet(f"{path}/directory")
        return own

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def total(self) -> int:
        return int(self.spark.read.parquet(f"{self.path}/directory").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])

    def ranges(self, first: int, end: int) -> list[tuple[int, int]]:
        """(range, rows before it) of the ranges that hold places ``first`` to ``end - 1``; a row of the
        directory stands for some 100,000 rows."""
        found = self.spark.read.parquet(f"{self.path}/directory").where((F.col("before") < end) & (F.col("before") + F.col("n") > first))
        return sorted((r["_range"], r["before"]) for r in found.collect())

    def page(self, number: int, size: int) -> DataFrame:
        """Page ``number`` (from 1) in order, with ``place, total_count, page, page_size, has_more``."""
        first, total = (number - 1) * size, self.total()
        own = self.ranges(first, first + size)
        before = F.create_map(*[F.lit(x) for pair in own for x in pair]) if own else F.create_map(F.lit(-1), F.lit(0))
        rows = self._rows().where(F.col("_range").isin([r for r, _ in own]))
        placed = rows.withColumn("place", F.try_element_at(before, F.col("_range")) + F.col("_nth")).where((F.col("place") >= first) & (F.col("place") < first + size))
        out = placed.drop("_range", "_nth").orderBy("place")
        return out.select("*", F.lit(total).cast("long").alias("total_count"), F.lit(number).cast("long").alias("page"), F.lit(size).cast("long").alias("page_size"), F.lit(total > number * size).alias("has_more"))
