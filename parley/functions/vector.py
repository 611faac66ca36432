"""Vector expressions over ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it in lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def unit(a: Column) -> Column:
    """The vector at length one; a zero vector stays as it is."""
    return let(F.struct(a.alias("a"), norm(a).alias("n")), lambda s: F.transform(s["a"], lambda x: F.when(s["n"] > 0, x / s["n"]).otherwise(x)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for a zero vector, for vectors of different sizes and for null."""
    return let(norm(a) * norm(b), lambda scale: F.when((F.size(a) == F.size(b)) & (scale > 0), dot(a, b) / scale).otherwise(0.0))


def literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def sign_bits(vector: Column, hashes: int = 8) -> Column:
    """Random-projection signature: bit h is 1 where the sum of v[j] * sin(1000 h + j) is above 0."""
    spread = lambda h: F.aggregate(F.transform(vector, lambda x, j: x * F.sin(h * 1000 + j)), F.lit(0.0), lambda s, x: s + x)
    return F.array(*[F.when(spread(F.lit(h)) > 0, 1).otherwise(0) for h in range(hashes)])


def seeded(seed: Column, time: Column, size: int) -> Column:
    """A reproducible unit vector: half the sine of seed, place and time."""
    return unit(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.sin(seed + i + F.sin(time * 0.1)) * 0.5))


def text_seed(text: Column) -> Column:
    """A number below 2**32 for a text: its UTF-8 bytes as digits to base 31; null stays null, empty is 0."""
    digits = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(".."), F.lit(0))
    return F.aggregate(digits, F.lit(0).cast("long"), lambda s, x: (s * 31 + F.conv(x, 16, 10).cast("long")) % (1 << 32))
