"""Queries on texts: normal forms, similarity of consecutive turns, repeats, word errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.functions import text as X
from parley.operators import cluster, dedup, folds, metrics
from parley.plans import views
from parley.plans.registry import query
from parley.plans.views import SEGMENTS, SQL_WORDS
from parley.session import table

COMMON = ", ".join(f"'{w}'" for w in X.COMMON)
WEIGHT = f"case when strlen(w) <= 2 then 0.1::double when strlen(w) <= 4 then case when w in ({COMMON}) then 0.2::double else 0.8::double end when strlen(w) <= 7 then 1.0::double else 1.2::double end"


def _normal(column: str) -> str:
    return "array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(" + column + r"), '[^\p{L}\p{N}\s]', '', 'g'), '\s+'), lambda w: w <> ''), ' ')"


PAIRS = f"""{SEGMENTS}, pairs as (select * from (select meeting, seq, lag(text) over (partition by meeting order by seq) as before, text from segments) where before is not null),
wp as (select meeting, seq, before, text, {SQL_WORDS.format(_normal("before"))} as a, {SQL_WORDS.format(_normal("text"))} as b from pairs)"""


#: Lower-cased words without other signs, and fields s, i, d of the cheapest edits from one list of words to another.
TOKENS = r"list_filter(list_transform(regexp_split_to_array(lower({0}), '\s+'), lambda w: regexp_replace(w, '[^\p{{L}}\p{{N}}]', '', 'g')), lambda w: w <> '')"
EDITS = """list_last(list_reduce(list_transform({0}, lambda w: struct_pack(w := w, k := 0, row := list_transform(range(0), lambda j: struct_pack(c := 0::bigint, s := 0::bigint, i := 0::bigint, d := 0::bigint)))), lambda up, x:
struct_pack(w := x.w, k := up.k + 1, row := list_reduce(list_transform(range(1, len({1}) + 1), lambda j: struct_pack(j := j, out := list_transform(range(0), lambda q: struct_pack(c := 0::bigint, s := 0::bigint, i := 0::bigint, d := 0::bigint)))), lambda acc, y:
 struct_pack(j := y.j, out := list_append(acc.out, case when up.row[y.j].c + (case when x.w = {1}[y.j] then 0 else 1 end) <= least(acc.out[y.j].c + 1, up.row[y.j + 1].c + 1) then struct_pack(c := up.row[y.j].c + (case when x.w = {1}[y.j] then 0 else 1 end), s := up.row[y.j].s + (case when x.w = {1}[y.j] then 0 else 1 end), i := up.row[y.j].i, d := up.row[y.j].d)
 when acc.out[y.j].c <= up.row[y.j + 1].c then struct_pack(c := acc.out[y.j].c + 1, s := acc.out[y.j].s, i := acc.out[y.j].i + 1, d := acc.out[y.j].d) else struct_pack(c := up.row[y.j + 1].c + 1, s := up.row[y.j + 1].s, i := up.row[y.j + 1].i, d := up.row[y.j + 1].d + 1) end)),
 struct_pack(j := 0::bigint, out := [struct_pack(c := (up.k + 1)::bigint, s := 0::bigint, i := 0::bigint, d := (up.k + 1)::bigint)])).out),
 struct_pack(w := '', k := 0, row := list_transform(range(len({1}) + 1), lambda j: struct_pack(c := j::bigint, s := 0::bigint, i := j::bigint, d := 0::bigint)))).row)"""


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with the one before: meeting, seq, before, text."""
    rows = views.segments(spark, sf_dir)
    own = W.partitionBy("meeting").orderBy("seq")
    return rows.select("meeting", "seq", F.lag("text").over(own).alias("before"), "text").where("before is not null")


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lambda c: X.words(X.normalize(F.col(c)))
    return turn_pairs(spark, sf_dir).withColumns({"a": words("before"), "b": words("text")})


@query(f"select doc_id, md5({_normal('text')}) as digest, length({_normal('text')}) as n from documents")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("doc_id", X.normalize(F.coalesce("text", F.lit(""))).alias("t"))
    return own.select("doc_id", F.md5("t").alias("digest"), F.char_length("t").cast("long").alias("n"))


_KEY = f"""case when len(ws) >= 3 then array_to_string(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]), '/') else '' end || '|' || len(ws) || '|' || strlen(t) // 10"""


@query(f"with n as (select doc_id, {_normal('text')} as t from documents), w as (select doc_id, t, {SQL_WORDS.format('t')} as ws from n) select doc_id, md5({_KEY}) as semantic_key from w")
def semantic_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("doc_id", X.normalize(F.coalesce("text", F.lit(""))).alias("t"))
    return own.select("doc_id", F.md5(X.semantic_key(F.col("t"))).alias("semantic_key"))


@query(f"""with {PAIRS}, o as (select meeting, seq, list_sum(list_transform(a, lambda w: {WEIGHT})) as total, list_sum(list_transform(list_filter(a, lambda w: list_contains(b, w)), lambda w: {WEIGHT})) as common from wp)
select meeting, seq, round(case when coalesce(total, 0) > 0 then coalesce(common, 0) / total else 0 end, 6) as overlap from o""")
def word_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(spark, sf_dir).select("meeting", "seq", F.round(X.word_overlap(F.col("a"), F.col("b")), 6).alias("overlap"))


@query(f"with {PAIRS} select meeting, seq, round(case when len(a) > 0 and len(b) > 0 then 1.0::double - abs(len(a) - len(b)) / greatest(len(a), len(b)) else 0 end, 6) as similarity from wp")
def length_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(spark, sf_dir).select("meeting", "seq", F.round(X.length_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query(f"""with {PAIRS}, c as (select meeting, seq, trim(lower(before)) as x, trim(lower(text)) as y from pairs), w as (select *, {SQL_WORDS.format("x")} as p, {SQL_WORDS.format("y")} as q from c),
m as (select *, list_filter(list_transform(range(len(p)), lambda i: struct_pack(i := i, j := coalesce(list_position(q, p[i + 1]), 0))), lambda s: s.j > 0) as placed, greatest(len(p), len(q)) as top from w),
b as (select *, len(placed) as n, coalesce(list_sum(list_transform(placed, lambda s: 1.0::double - abs(s.i - (s.j - 1)) / top)), 0) as bonus from m)
select meeting, seq, round(case when x = '' or y = '' then 0 when x = y then 1 when least(strlen(x), strlen(y)) >= greatest(8, least(strlen(x), strlen(y)) // 3) and (contains(x, y) or contains(y, x)) then 0.95
when len(p) = 0 or len(q) = 0 then 0 else least(0.7::double * n / (len(p) + len(q) - n) + 0.3::double * bonus / greatest(n, 1), 1) end, 6) as similarity from b""")
def jaccard_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_pairs(spark, sf_dir).select("meeting", "seq", F.round(X.position_similarity(F.col("before"), F.col("text")), 6).alias("similarity"))


@query(f"""with {SEGMENTS}, n as (select meeting, seq, {_normal("text")} as t from segments), w as (select *, {SQL_WORDS.format("t")} as ws from n), k as (select meeting, seq, case when strlen(t) >= 5 then {_KEY} end as key from w),
l as (select *, list(key) over (partition by meeting order by seq rows between 8 preceding and 1 preceding) as before from k)
select meeting, seq, coalesce(list_contains(before, key), false) as duplicate from l""")
def dup_recent_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.recent_repeats(views.segments(spark, sf_dir)).select("meeting", "seq", "duplicate")


@query()
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup.marked(views.timed(views.segments(spark, sf_dir).select("meeting", "seq", "text")))
    return folds.in_order(rows, folds.Repeats(), "meeting").select("meeting", "seq", "duplicate")


#: Length of the longest common subsequence of two lists.
LCS = """list_last(list_reduce(list_transform({0}, lambda w: struct_pack(w := w, row := list_transform(range(0), lambda j: 0::bigint))), lambda up, x: struct_pack(w := x.w, row := list_reduce(list_transform(range(1, len({1}) + 1), lambda j: struct_pack(j := j, out := list_transform(range(0), lambda q: 0::bigint))),
 lambda acc, y: struct_pack(j := y.j, out := list_append(acc.out, case when x.w = {1}[y.j] then up.row[y.j] + 1 else greatest(acc.out[y.j], up.row[y.j + 1]) end)), struct_pack(j := 0::bigint, out := [0::bigint])).out), struct_pack(w := '', row := list_transform(range(len({1}) + 1), lambda j: 0::bigint))).row)"""


@query(f"with {PAIRS}, l as (select *, {LCS.format('a', 'b')} as n from wp) select meeting, seq, round(n / greatest(len(a), len(b), 1), 6) as similarity from l")
def lcs_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = F.greatest(F.size("a"), F.size("b"), F.lit(1))
    return _lists(spark, sf_dir).select("meeting", "seq", F.round(metrics.common_words("a", "b") / top, 6).alias("similarity"))


@query(f"""with {PAIRS}, l as (select *, {LCS.format('a', 'b')} as n, list_sum(list_transform(a, lambda w: {WEIGHT})) as total, coalesce(list_sum(list_transform(list_filter(a, lambda w: list_contains(b, w)), lambda w: {WEIGHT})), 0) as common from wp)
select meeting, seq, round(case when len(a) = 0 or len(b) = 0 then 0 else least(0.5 * common / total + 0.3 * n / greatest(len(a), len(b)) + 0.2 * (1 - abs(len(a) - len(b)) / greatest(len(a), len(b))), 1) end, 6) as similarity from l""")
def semantic_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(spark, sf_dir).select("meeting", "seq", F.round(dedup.similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query(f"""with {PAIRS}, t as (select meeting, seq, {TOKENS.format("before")} as a, {TOKENS.format("text")} as b from pairs), e as (select *, {EDITS.format("a", "b")} as e from t)
select meeting, seq, e.s as substitutions, e.i as insertions, e.d as deletions, round(case when len(a) > 0 then (e.s + e.i + e.d) / len(a) when len(b) > 0 then 1 else 0 end, 6) as wer from e""")
def wer_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _word_errors(spark, sf_dir)
    return out.select("meeting", "seq", "substitutions", "insertions", "deletions", F.round("wer", 6).alias("wer"))


def _word_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = turn_pairs(spark, sf_dir).select("meeting", "seq", X.tokens(F.col("before")).alias("a"), X.tokens(F.col("text")).alias("b"))
    return metrics.word_errors(pairs, "a", "b")


@query(f"""with {PAIRS}, t as (select {TOKENS.format("before")} as a, {TOKENS.format("text")} as b from pairs), e as (select a, {EDITS.format("a", "b")} as e from t), s as (select sum(e.s)::bigint as substitutions, sum(e.i)::bigint as insertions, sum(e.d)::bigint as deletions, sum(len(a))::bigint as n_reference from e)
select *, round((substitutions + insertions + deletions) / n_reference, 6) as error_rate, round(greatest(1 - (substitutions + insertions + deletions) / n_reference, 0), 6) as accuracy from s""")
def wer_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.corpus_errors(_word_errors(spark, sf_dir))
    return out.select("substitutions", "insertions", "deletions", "n_reference", F.round("error_rate", 6).alias("error_rate"), F.round("accuracy", 6).alias("accuracy"))


@query()
def cer_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character edits of the turns as they are, by kind."""
    out = metrics.char_errors(turn_pairs(spark, sf_dir), "before", "text")
    return out.select("meeting", "seq", "substitutions", "insertions", "deletions", F.col("n_words_reference").alias("n_chars"), F.round("wer", 6).alias("cer"))


@query()
def cer_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = cer_turns(spark, sf_dir).withColumnRenamed("n_chars", "n_words_reference")
    out = metrics.corpus_errors(each)
    return out.select("substitutions", "insertions", "deletions", "n_reference", F.round("error_rate", 6).alias("error_rate"))


@query(f"""with {PAIRS}, t as (select meeting, seq, a, b, least(len(a), len(b)) as n from wp)
select meeting, seq, round(case when len(a) > 0 then (abs(len(a) - len(b)) + len(list_filter(range(1, n + 1), lambda i: a[i] <> b[i]))) / len(a) else 0 end, 6) as approximate,
round(case when len(a) > 0 then (greatest(len(a), len(b)) - coalesce(list_min(list_filter(range(1, n + 1), lambda i: a[i] <> b[i])) - 1, n)) / len(a) when len(b) > 0 then 1 else 0 end, 6) as by_prefix from t""")
def simple_error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _lists(spark, sf_dir).select("meeting", "seq", F.round(X.positional_error_rate(a, b), 6).alias("approximate"), F.round(X.prefix_error_rate(a, b), 6).alias("by_prefix"))


@query(f"""with {SEGMENTS} select meeting, seq, regexp_replace(text, '(en)', '<mark>\\1</mark>', 'gi') as marked,
trim(text) = '' or contains(text, '[BLANK_AUDIO]') or contains(text, '[INAUDIBLE]') as noise from segments""")
def highlight_and_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.segments(spark, sf_dir).select("meeting", "seq", X.highlight(F.col("text"), "en").alias("marked"), X.is_noise(F.col("text")).alias("noise"))


def _sql_clock(s: str) -> str:
    return f"case when {s} >= 3600 then ({s} // 3600) || ':' || lpad((({s} % 3600) // 60)::varchar, 2, '0') else (({s} % 3600) // 60)::varchar end || ':' || lpad(({s} % 60)::varchar, 2, '0')"


@query(f"""with {SEGMENTS} select meeting, seq, {_sql_clock("(start_ms // 1000)")} as clock, case when end_ms // 1000 >= 3600 then (end_ms // 1000 // 3600) || 'h ' || (end_ms // 1000 % 3600 // 60) || 'm'
when end_ms // 1000 >= 60 then (end_ms // 1000 // 60) || 'm ' || (end_ms // 1000 % 60) || 's' else (end_ms // 1000) || 's' end as spoken from segments""")
def duration_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.segments(spark, sf_dir).select("meeting", "seq", X.clock(F.col("start_ms") / 1000).alias("clock"), X.spoken(F.col("end_ms") / 1000).alias("spoken"))


@query("""with d as (select o_orderkey, o_orderdate::date as d, date '1995-06-17' as t from orders)
select o_orderkey, case when t - d = 0 then 'Today' when t - d = 1 then 'Yesterday' when t - d between 2 and 6 then (t - d) || ' days ago' when year(d) = year(t) then strftime(d, '%b %-d') else strftime(d, '%b %-d, %Y') end as day from d""")
def relative_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.relative_day(day, F.lit("1995-06-17").cast("date")).alias("day"))


@query(f"""with {SEGMENTS}, f as (select a.meeting, a.seq, b.text as before, a.text from segments a join segments b on a.meeting = b.meeting and b.seq between a.seq - 5 and a.seq - 1),
c as (select meeting, seq, trim(lower(text)) as x, trim(lower(before)) as y from f), w as (select *, {SQL_WORDS.format("x")} as p, {SQL_WORDS.format("y")} as q, least(strlen(x), strlen(y)) as size, least(length(x), length(y)) * 3 // 4 as cut from c),
m as (select *, list_filter(list_transform(range(len(p)), lambda i: struct_pack(i := i, j := coalesce(list_position(q, p[i + 1]), 0))), lambda s: s.j > 0) as placed, greatest(len(p), len(q)) as top from w),
b as (select *, len(placed) as n, coalesce(list_sum(list_transform(placed, lambda s: 1.0::double - abs(s.i - (s.j - 1)) / top)), 0) as bonus from m),
d as (select meeting, seq, strlen(x) >= 5 and (x = y or (size >= greatest(8, size // 4) and (contains(x, y) or contains(y, x) or (size > 15 and x[1:cut] = y[1:cut]))) or case when x = '' or y = '' then 0 when x = y then 1 when len(p) = 0 or len(q) = 0 then 0 else least(0.7::double * n / (len(p) + len(q) - n) + 0.3::double * bonus / greatest(n, 1), 1) end >= 0.4) as hit from b)
select meeting, seq, coalesce(bool_or(hit), false) as duplicate from segments left join d using (meeting, seq) group by 1, 2""")
def dup_recent_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn against the five before it."""
    before = W.partitionBy("meeting").orderBy("seq").rowsBetween(-5, -1)
    rows = views.segments(spark, sf_dir).withColumn("recent", F.collect_list("text").over(before))
    return rows.select("meeting", "seq", X.repeats_any(F.col("text"), F.col("recent"), 0.4).alias("duplicate"))


@query(f"""with {SEGMENTS}, w as (select meeting, seq, text, {SQL_WORDS.format("text")} as ws from segments)
select meeting, seq, case when len(ws) > 3 and 3 / len(ws) > 0.3 then array_to_string(ws[4:], ' ') else text end as rest from w""")
def overlap_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn after a buffer that holds its first three words."""
    ws = X.words(F.col("text"))
    return views.segments(spark, sf_dir).select("meeting", "seq", X.without_overlap(F.col("text"), F.upper(F.array_join(F.slice(ws, 1, 3), " ")), 0.3).alias("rest"))


@query(f"""with {SEGMENTS}, w as (select meeting, seq, unnest({SQL_WORDS.format("text")}) as word from segments)
select meeting, seq, round(avg(case when word in ('the', 'and', 'de', 'la') then 0.9 else 0.5 end), 6) as confidence, count(*) as words from w group by 1, 2""")
def vocabulary_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = F.transform(X.words(F.col("text")), lambda w: F.struct(w.alias("word"), F.lit(0.5).alias("confidence")))
    each = views.segments(spark, sf_dir).select("meeting", "seq", F.explode(X.boosted(ws, ("the", "and", "de", "la"))).alias("w"))
    return each.groupBy("meeting", "seq").agg(F.round(F.avg("w.confidence"), 6).alias("confidence"), F.count("*").alias("words"))


@query(f"""with {SEGMENTS} select meeting, seq, lpad((end_ms // 60000)::varchar, greatest(2, length((end_ms // 60000)::varchar))::int, '0') || ':' || lpad((end_ms // 1000 % 60)::varchar, 2, '0') as minutes,
case when end_ms < 60000 then printf('%.1f', end_ms / 1000) || 's' else (end_ms // 60000) || 'm ' || (end_ms // 1000 % 60) || 's' end as speech from segments where end_ms % 100 = 0""")
def time_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("end_ms") / 1000
    return views.segments(spark, sf_dir).where("end_ms % 100 = 0").select("meeting", "seq", X.minute_clock(s).alias("minutes"), X.speech_time(s).alias("speech"))


@query("""with k as (select event_id, case event_id % 6 when 0 then 'model_load' when 1 then 'audio_system' when 2 then 'permission_denied' when 3 then 'system_busy' when 4 then 'network_down' else 'other' end as kind from events)
select kind, case when contains(kind, 'model') then 'model' when contains(kind, 'audio') then 'audio' when contains(kind, 'permission') then 'permissions' when contains(kind, 'system') then 'system' when contains(kind, 'network') then 'network' else 'unknown' end as area, count(*) as n from k group by 1, 2""")
def error_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("model_load", "audio_system", "permission_denied", "system_busy", "network_down", "other")]), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(kinds.alias("kind")).groupBy("kind", X.error_category(F.col("kind")).alias("area")).agg(F.count("*").alias("n"))


@query(f"""with {PAIRS} select meeting, seq, len({TOKENS.format("text")}) as n_tokens, md5(array_to_string(list_transform({SQL_WORDS.format("text")}, lambda w: regexp_replace(w, '^[[:punct:]]+|[[:punct:]]+$', '', 'g')), ' ')) as trimmed,
md5(case when contains(before, text) then before when contains(text, before) then text else before || ' ' || text end) as merged from pairs""")
def text_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, words without marks at their ends, and the text of a turn merged with the one before."""
    trimmed = F.array_join(F.transform(X.words(F.col("text")), X.trim_marks), " ")
    return turn_pairs(spark, sf_dir).select("meeting", "seq", F.size(X.tokens(F.col("text"))).cast("long").alias("n_tokens"), F.md5(trimmed).alias("trimmed"), F.md5(X.merge_texts(F.col("before"), F.col("text"))).alias("merged"))


def _grouped(voices: DataFrame) -> DataFrame:
    """Recordings of 50 vectors each."""
    return voices.withColumn("recording", F.floor(F.col("id") / 50).cast("long"))


@query()
def cluster_agglomerative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.cluster(_grouped(views.voices(spark, sf_dir)), "recording", similarity=0.3, most=8)


@query()
def cluster_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as one recording, in rounds of mutually nearest clusters."""
    return cluster.cluster(views.voices(spark, sf_dir).withColumn("recording", F.lit(0).cast("long")), "recording", similarity=0.3, most=8, stop_at_most=False, in_task=256)


@query()
def cluster_online(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.timed(_grouped(views.voices(spark, sf_dir)).withColumn("seq", F.col("id")))
    return folds.in_order(rows, folds.OnlineClusters(0.3), "recording").select("recording", F.col("seq").alias("id"), "cluster")

