"""Exact deduplication with built-in functions only.

Each row becomes a slim one (id, length, 128-bit hash of the normalised text), and rows are grouped by
that hash; of each group the row with the most code points in its original text stays, then the
smallest id. Texts move only for groups of more than one row: each is compared byte for byte with
the first text of its group, and large groups are dealt out over parts that get a copy of that
text each. A group that fails is split by a second, longer digest, so a collision never merges
different texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm import rows
from parley.session import cut

#: The characters that do not count: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = "[\\x20\\x09-\\x0D]+"
#: Rows of a group whose texts are compared in one part.
PART = 512


def normalised(text: Column) -> Column:
    """The text without blanks; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def _marked(docs: DataFrame, id_col: str, text_col: str, digest: Column | None) -> DataFrame:
    """``_row`` (all columns), ``_norm``, its hash ``_h``, and ``_key``, by which rows of a group are ordered."""
    own = F.col(f"`{text_col}`")
    wide = docs.select(rows.packed(docs).alias("_row"), F.col(f"`{id_col}`").alias("_id"), F.char_length(F.coalesce(own, F.lit(""))).alias("_n"), normalised(own).alias("_norm"), rows.digest(docs).alias("_tie"))
    key = F.struct((-F.col("_n")).alias("n"), F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_tie").alias("tie"))
    return wide.select("_row", "_norm", (F.unhex(F.md5("_norm")) if digest is None else digest).alias("_h"), key.alias("_key"))


def _collided(marked: DataFrame, groups: DataFrame, count: int) -> DataFrame:
    """Hashes of groups in which a text differs from the first one."""
    parts = groups.select("_h", F.ceil(F.col("group_size") / PART).cast("int").alias("_parts"))
    texts = marked.select("_h", "_norm", "_key").join(rows.near(parts, count), "_h")
    firsts = texts.groupBy("_h").agg(F.min("_parts").alias("_parts"), F.first("_norm").alias("_first"))
    firsts = firsts.select(F.col("_h").alias("_g"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_p"), "_first")
    own = texts.select("_h", "_norm", F.pmod(F.xxhash64("_key"), F.col("_parts")).cast("int").alias("_part"))
    pairs = own.join(firsts, (F.col("_h") == F.col("_g")) & (F.col("_part") == F.col("_p")))
    return pairs.where("_norm <> _first").select("_h").distinct()


def _decided(docs: DataFrame, id_col: str, text_col: str, digest: Column | None) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Marked rows, slim rows, and the groups of several rows (``_h, _sub, group_size, _best``) with their number.

    ``_sub`` is empty, or the longer digest where texts of one hash differ.
    """
    marked = _marked(docs, id_col, text_col, digest)
    slim = cut(marked.select("_h", F.sha2("_norm", 256).alias("_sha"), "_key", F.monotonically_increasing_id().alias("_at")))
    order = F.struct("_key", "_at")
    groups = cut(slim.groupBy("_h").agg(F.count("*").alias("group_size"), F.min(order).alias("_best")).where("group_size > 1"))
    count = groups.count()
    wrong = cut(_collided(marked, groups, count)) if count else groups.select("_h").limit(0)
    whole = groups.join(wrong, "_h", "left_anti").select("_h", F.lit("").alias("_sub"), "group_size", "_best")
    apart = slim.join(wrong, "_h", "left_semi").groupBy("_h", F.col("_sha").alias("_sub")).agg(F.count("*").alias("group_size"), F.min(order).alias("_best"))
    found = cut(whole.unionByName(apart)) if count and not wrong.isEmpty() else whole
    return marked, slim, found.select(F.col("_h").alias("_g"), "_sub", "group_size", "_best"), count


def _joined(table: DataFrame, groups: DataFrame, count: int) -> DataFrame:
    """Rows with their groups: sent to the rows while they are few, else by shuffle with hot groups dealt out."""
    if count <= rows.SMALL:
        return table.join(F.broadcast(groups), _own_group(), "left")
    dealt, parts = rows.spread(table, "_h", groups.groupBy("_g").agg(F.sum("group_size").alias("_size")), "_g", "_size", table.count())
    salted = groups.join(parts.select(F.col("_g").alias("_p"), F.col("_salt").alias("_s")), F.col("_g") == F.col("_p")).drop("_p")
    return dealt.join(salted, _own_group() & (F.col("_salt") == F.col("_s")), "left").drop("_salt", "_s")


def _own_group() -> Column:
    return (F.col("_h") == F.col("_g")) & ((F.col("_sub") == "") | (F.col("_sub") == F.col("_sha")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Column | None = None) -> DataFrame:
    """One row per input row: ``_id, keep_id, group_size, kept, text_sha256``.

    Exactly one row of each group of equal texts has ``kept`` true, also where ids or whole rows are
    repeated (then the one whose other columns have the smallest hash, then any of those alike). Ids
    may be of any type that can be ordered; a null id comes after all others. Null and empty texts
    are equal to each other. An empty table gives an empty result. ``digest`` (of column ``_norm``)
    replaces the 128-bit hash in tests of the collision path.
    """
    _, slim, groups, count = _decided(docs, id_col, text_col, digest)
    out = _joined(slim, groups, count)
    alone, best = F.col("_g").isNull(), F.col("_best._key.id")
    kept = alone | (F.col("_at") == F.col("_best._at"))
    return out.select(F.col("_key.id").alias("_id"), F.when(alone, F.col("_key.id")).otherwise(best).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), kept.alias("kept"), F.col("_sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Column | None = None) -> DataFrame:
    """The rows that stay, with all columns of ``docs``: one of each group of equal texts.

    Which one is decided as in ``exact_dedup``; of rows alike in every column one stays. Rows whose
    text is theirs alone are passed on where they are, without a shuffle, while the groups are few
    enough to be sent to them.
    """
    marked, _, groups, count = _decided(docs, id_col, text_col, digest)
    every = marked.select("_row", "_h", "_key", F.sha2("_norm", 256).alias("_sha"))
    out = _joined(every, groups, count)
    alone = out.where("_g is null").select("_row.*")
    best = out.where(F.col("_key").eqNullSafe(F.col("_best._key"))).groupBy("_g", "_sub").agg(F.first("_row").alias("_row"))
    return alone.unionByName(best.select("_row.*"))
