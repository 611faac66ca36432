"""Small helpers on whole rows: a digest to tell rows apart, and broadcasts behind a size check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a slim table (keys and ids) that may be broadcast; beyond it Spark joins by shuffle.
SMALL = 400_000


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def digest(table: DataFrame) -> Column:
    """A 64-bit hash of all columns of a row that can be hashed (maps and variants cannot)."""
    names = [f.name for f in table.schema.fields if _hashable(f.dataType)]
    return F.xxhash64(*[F.col(f"`{c}`") for c in names]) if names else F.lit(0).cast("long")


def packed(table: DataFrame) -> Column:
    """All columns as one struct, so that helper columns beside it clash with none of them."""
    return F.struct(*[F.col(f"`{c}`") for c in table.columns])


def near(table: DataFrame, count: int) -> DataFrame:
    """``table`` marked for a broadcast where its counted rows are few; else as it is."""
    return F.broadcast(table) if count <= SMALL else table


#: Rows of one key that a join keeps together, and keys at most that may have more (these are broadcast).
TOGETHER, MOST_HOT = 100_000, 10_000


def spread(big: DataFrame, key: str, small: DataFrame, own: str, size: str, total: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join of ``big.key`` with the unique ``small.own``, with ``_salt`` to join by as well.

    ``size``: how many rows of ``big`` a row of ``small`` meets, of ``total``. A key with more rows than
    stay together is dealt over parts, and its row of ``small`` repeated for each. There can be no more
    than ``MOST_HOT`` such keys, so they may be sent to all rows of ``big``.
    """
    most = max(TOGETHER, -(-total // MOST_HOT))
    parts = F.ceil(F.col(size) / most).cast("int")
    hot = small.where(F.col(size) > most).select(F.col(own).alias("_hot"), parts.alias("_parts"))
    dealt = big.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    dealt = dealt.withColumn("_salt", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("_parts")).cast("int"), F.lit(0))).drop("_hot", "_parts")
    return dealt, small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
