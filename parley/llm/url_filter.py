"""URL rules by host suffix and path prefix, with built-in functions only.

Each distinct (host, path) is expanded into its host suffixes and into the path prefixes of the
lengths that rules have. The expressions meet the rules in an equi-join on a short hash prefix alone;
the full digest and then host and path themselves confirm a match, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a url gets that no rule fits.
DEFAULT_VERDICT = "allow"
#: Hex digits of a digest that expressions and rules are joined by.
SHORT = 8


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (lower case A-Z) and path of a url; both empty where it is null or has no ``://``."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return _lower(host), path


def _lower(host: Column) -> Column:
    """A-Z in lower case; other letters stay as they are."""
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _short(digest: Column) -> Column:
    return F.substring(digest, 1, SHORT)


def _same(a: Column, b: Column) -> Column:
    """Equality in a form that is a condition on joined rows, never a join key."""
    return F.array_contains(F.array(a), b)


def judge(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """``urls`` with ``host, path, rule, verdict`` (columns of those names are replaced).

    ``rules``: host, path, verdict. Of rules that fit, the longest (host and path together) wins;
    at equal length the longer host, then ``block``. Null and malformed urls fit no rule and take no
    part in the joins. Repeated urls are judged once. Rows of ``rules`` with a null host or path are
    ignored. Rules join unhinted, so they are broadcast only below Spark's size limit. An empty
    table gives an empty result.
    """
    names = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = split_url(F.col(f"`{url_col}`"))
    rows = urls.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), host.alias("_host"), path.alias("_path"))
    rules = rules.where("host is not null and path is not null").select(_lower(F.col("host")).alias("_rhost"), F.col("path").alias("_rpath"), F.col("verdict").alias("_rverdict"))
    lengths = sorted(r[0] for r in rules.select(F.char_length("_rpath")).distinct().collect())
    rules = rules.select("*", F.sha2(F.concat_ws("\n", "_rhost", "_rpath"), 256).alias("_rdigest")).withColumn("_rkey", _short(F.col("_rdigest")))
    each = rows.select("_host", "_path").distinct().where("_host <> ''")
    labels = F.split("_host", "\\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.char_length("_path") >= n, F.substring("_path", 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>"), lambda p: p.isNotNull())
    wide = each.withColumn("_suffix", F.explode(suffixes)).withColumn("_prefix", F.explode(prefixes))
    wide = wide.withColumn("_digest", F.sha2(F.concat_ws("\n", "_suffix", "_prefix"), 256)).withColumn("_key", _short(F.col("_digest")))
    sure = _same(F.col("_digest"), F.col("_rdigest")) & _same(F.col("_suffix"), F.col("_rhost")) & _same(F.col("_prefix"), F.col("_rpath"))
    hits = wide.join(rules, (F.col("_key") == F.col("_rkey")) & sure)
    rank = F.struct(F.char_length(F.concat("_rhost", "_rpath")).alias("a"), F.char_length("_rhost").alias("b"), (F.col("_rverdict") == "block").alias("c"), F.concat("_rhost", "_rpath").alias("rule"), F.col("_rverdict").alias("verdict"))
    won = hits.groupBy(F.col("_host").alias("_h"), F.col("_path").alias("_p")).agg(F.max(rank).alias("_won"))
    judged = rows.where("_host <> ''").join(won, (F.col("_host") == F.col("_h")) & (F.col("_path") == F.col("_p")), "left").drop("_h", "_p")
    out = judged.unionByName(rows.where("_host = ''").withColumn("_won", F.lit(None).cast(won.schema["_won"].dataType)))
    return out.select("_row.*", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_won.rule").alias("rule"), F.coalesce("_won.verdict", F.lit(default)).alias("verdict"))
