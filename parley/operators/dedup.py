"""Duplicate utterances within a session, decided in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.functions import text as X
from parley.operators.metrics import _common, common_words

#: How many accepted texts are remembered, and from which similarity a text repeats one of them.
KEPT, LEAST = 8, 0.6
#: Normalised texts of fewer bytes never repeat anything.
SHORT = 5


def similarity(a: Column, b: Column) -> Column:
    """0.5 weighted word overlap, 0.3 common subsequence, 0.2 lengths, for two columns of word lists."""
    top = F.greatest(F.size(a), F.size(b))
    mixed = F.least(0.5 * X.word_overlap(a, b) + 0.3 * common_words(a, b) / top + 0.2 * X.length_similarity(a, b), F.lit(1.0))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(mixed)


def recent_repeats(rows: DataFrame, key: str = "meeting", order: str = "seq", n: int = KEPT) -> DataFrame:
    """Relaxed form without Python: a row repeats if one of the ``n`` rows before it has the same
    semantic key. Rows that were themselves repeats are compared with too."""
    normal = X.normalize(F.col("text"))
    before = W.partitionBy(key).orderBy(order).rowsBetween(-n, -1)
    marked = rows.withColumn("_key", F.when(F.octet_length(normal) >= SHORT, X.semantic_key(normal)))
    return marked.withColumn("duplicate", F.coalesce(F.array_contains(F.collect_list("_key").over(before), F.col("_key")), F.lit(False))).drop("_key")


def _weight(word: str) -> float:
    size = len(word.encode())
    return 0.1 if size <= 2 else (0.2 if word in X.COMMON else 0.8) if size <= 4 else 1.0 if size <= 7 else 1.2


def alike(a: list[str], b: list[str]) -> float:
    """The same similarity for two word lists."""
    if not a or not b:
        return 0.0
    held, total = set(b), sum(map(_weight, a))
    top = max(len(a), len(b))
    return min(1.0, 0.5 * sum(_weight(w) for w in a if w in held) / total + 0.3 * _common(a, b) / top + 0.2 * (1 - abs(len(a) - len(b)) / top))


class Memory:
    """The last accepted texts; ``repeats`` decides one text and remembers it if it is new."""

    def __init__(self, texts: list[tuple[str, str]] = (), kept: int = KEPT, least: float = LEAST):
        self.texts, self.kept, self.least = list(texts), kept, least

    def repeats(self, normal: str, key: str) -> bool:
        if len(normal.encode()) < SHORT:
            return False
        own = normal.split()
        if any(key == k or alike(own, t.split()) >= self.least for t, k in self.texts):
            return True
        self.texts = [*self.texts, (normal, key)][-self.kept :]
        return False


def marked(rows: DataFrame) -> DataFrame:
    """``rows`` with what ``Memory`` needs of ``text``: ``normal`` and ``mark``."""
    normal = X.normalize(F.coalesce("text", F.lit("")))
    return rows.withColumn("normal", normal).withColumn("mark", X.semantic_key(F.col("normal")))
