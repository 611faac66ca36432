"""Queries on stored profiles: creation, search, validation, import, results put in, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import meetings as M
from parley.operators import similarity, store
from parley.plans import views
from parley.plans.registry import query
from parley.plans.speakers import QUERY_SET, _query_set, _table
from parley.plans.views import MEETINGS, PROFILES, SEGMENTS, VOICES
from parley.session import table, written

WIDE = PROFILES + """, wide as (select *, timestamp '2024-01-01' + interval (speaker_id) day as created_at, (60 + speaker_id * 7 % 40) / 100.0::double as confidence_threshold,
case speaker_id % 3 when 0 then '#3B82F6' when 1 then '#10B981' else '#F59E0B' end as color, (speaker_id * 3 % 11)::bigint as identification_count from profiles)"""


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles with time of creation, threshold, colour and count."""
    n = F.col("speaker_id")
    color = F.when(n % 3 == 0, "#3B82F6").when(n % 3 == 1, "#10B981").otherwise("#F59E0B")
    created = F.lit("2024-01-01").cast("timestamp") + F.make_interval(days=n.cast("int"))
    return views.profiles(spark, sf_dir).select("*", created.alias("created_at"), ((60 + n * 7 % 40) / 100.0).alias("confidence_threshold"), color.alias("color"), (n * 3 % 11).alias("identification_count"))


@query(f"""with {WIDE} select speaker_id, name, is_active, confidence_threshold, color from wide
union all select * from (values (200, 'Ada', true, 0.7::double, '#3B82F6'), (201, 'Bo', true, 0.9::double, '#000000')) t(a, b, c, d, e)""")
def profile_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = wide(spark, sf_dir).select("speaker_id", "name", "is_active", "confidence_threshold", "color")
    asked = spark.createDataFrame([(200, "Ada", None, None), (201, "Bo", 0.9, "#000000"), (3, "There already", None, None)], "speaker_id long, name string, confidence_threshold double, color string")
    stored = _table(rows)
    stored.change(asked, lambda old: store.create(old, asked, {"is_active": F.lit(True), "confidence_threshold": F.lit(0.7), "color": F.lit("#3B82F6")}, "speaker_id"))
    return stored.read()


@query(f"""with {VOICES} select speaker_id, count(*) + case when speaker_id = 3 then 1 else 0 end as embeddings, round(sum(duration_s) + case when speaker_id = 3 then 2.5 else 0 end, 6) as total_s from voices group by 1""")
def embedding_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.voices(spark, sf_dir).select("id", "speaker_id", "quality", "duration_s")
    fresh = spark.createDataFrame([(-1, 3, 0.5, 2.5), (-2, 999, 0.5, 2.5)], "id long, speaker_id long, quality double, duration_s double")
    stored = _table(rows)
    stored.append(store.add_children(rows.limit(0), fresh, views.profiles(spark, sf_dir), "speaker_id"))
    return stored.read().groupBy("speaker_id").agg(F.count("*").alias("embeddings"), F.round(F.sum("duration_s"), 6).alias("total_s"))


@query(f"""with {PROFILES}, {VOICES} select 'before' as at, (select count(*) from profiles) as profiles, (select count(*) from voices) as embeddings
union all select 'after', 0, 0 union all select 'refilled', (select count(*) from profiles where is_active), 0""")
def clear_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of both stored tables before they are cleared, after it, and after profiles were put in again."""
    rows = views.profiles(spark, sf_dir)
    profiles, voices = _table(rows), _table(views.voices(spark, sf_dir))

    def counted(at: str) -> DataFrame:
        n = profiles.read().agg(F.count("*").alias("profiles")).crossJoin(voices.read().agg(F.count("*").alias("embeddings")))
        return written(n.select(F.lit(at).alias("at"), "profiles", "embeddings"))

    before = counted("before")
    profiles.clear(voices)
    after = counted("after")
    profiles.upsert(rows.where("is_active"))
    return before.unionByName(after).unionByName(counted("refilled"))


@query(f"""with {WIDE}, {VOICES} select speaker_id, 'with' as kind from wide w where contains(lower(name), 'speaker') and created_at between timestamp '2024-01-02' and timestamp '2024-01-09' and confidence_threshold >= 0.65 and is_active and identification_count >= 2
and exists (select 1 from voices v where v.speaker_id = w.speaker_id and quality >= 0.9) union all
select speaker_id, 'without' from wide w where color = '#10B981' and not exists (select 1 from voices v where v.speaker_id = w.speaker_id and v.speaker_id % 2 = 0)""")
def profile_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, voices = wide(spark, sf_dir), views.voices(spark, sf_dir)
    a = store.find_profiles(rows, voices.where("quality >= 0.9"), "SPEAKER", "2024-01-02", "2024-01-09", 0.65, True, True, None, 2)
    b = store.find_profiles(rows, voices.where("speaker_id % 2 = 0"), has_embeddings=False, color="#10b981")
    return a.select("speaker_id", F.lit("with").alias("kind")).union(b.select("speaker_id", F.lit("without")))


@query(f"""with {VOICES}, {QUERY_SET}, s as (select query_id, speaker_id, max(list_cosine_similarity(vector, qv)) as sim from voices, qs where id % 2 = 0 and quality >= 0.6 group by 1, 2),
k as (select *, row_number() over (partition by query_id order by sim desc, speaker_id) as k from s where sim >= 0.1) select query_id, speaker_id, round(sim, 6) as similarity from k where k <= 3""")
def embedding_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    voices = views.voices(spark, sf_dir).withColumn("model", F.when(F.col("id") % 2 == 0, "a").otherwise("b"))
    out = similarity.search(_query_set(voices), voices, views.profiles(spark, sf_dir), 0.1, 3, True, "a", 0.6)
    return out.withColumn("similarity", F.round("similarity", 6))


@query(f"""with {VOICES}, {QUERY_SET}, s as (select query_id, id, list_cosine_similarity(vector, qv) as sim from voices, qs)
select query_id, id, round(sim, 6) as similarity, row_number() over (partition by query_id order by sim desc, id) as place from s where sim >= 0.3""")
def embedding_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    voices = views.voices(spark, sf_dir)
    return similarity.matches(_query_set(voices), voices, 0.3).select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.col("place").cast("long").alias("place"))


@query(f"with {PROFILES} select speaker_id, name from profiles where not is_active")
def inactive_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.profiles(spark, sf_dir).where("not is_active").select("speaker_id", "name")


@query("""with c as (select n_nationkey as id, n_name as name, null::varchar as own from nation union all select 100, 'ASIA ', null union all select 101, ' ASIA', 'ASIA' union all select 102, '  ', null union all select 103, repeat('x', 101), null)
select id, case when trim(name) = '' then 'empty' when length(trim(name)) > 100 then 'too long' when trim(name) is not distinct from own then '' when trim(name) in (select r_name from region) then 'in use' else '' end as problem from c""")
def name_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("own"))
    more = spark.createDataFrame([(100, "ASIA ", None), (101, " ASIA", "ASIA"), (102, "  ", None), (103, "x" * 101, None)], "id long, name string, own string")
    return store.name_problem(own.union(more), table(spark, sf_dir, "region").select(F.col("r_name").alias("name"))).select("id", "problem")


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles as rows of text, as a store without types has them."""
    n = F.col("vec_id")
    pick = lambda *values: F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))
    return table(spark, sf_dir, "embeddings").select(
        n.alias("id"), F.lit("n").alias("name"), pick("", "d").alias("description"), F.lit("#000000").alias("color"), pick("3", "", "x").alias("identification_count"), pick("0.8", "", "high", "1").alias("confidence_threshold"), pick("1", "0", "").alias("is_active"),
        pick("90", "").alias("pitch_range_min"), pick("", "250.5").alias("pitch_range_max"), pick("x", "120").alias("pitch_mean"), pick("", "4.5", "fast").alias("speaking_rate"), pick('{"a": 0.5, "b": 1}', "", "{bad", "{}").alias("quality_features"), pick("", "f").alias("gender"),
        pick("20", "", "x").alias("age_range_min"), pick("40", "", "y", "50").alias("age_range_max"), pick('["en", "de"]', "[", "").alias("language_markers"),
    )


def _sql_pick(*values: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][vec_id % {len(values)} + 1]"


@query(f"""with t as (select vec_id as id, {_sql_pick("", "d")} as de, {_sql_pick("3", "", "x")} as ic, {_sql_pick("0.8", "", "high", "1")} as ct, {_sql_pick("1", "0", "")} as ac, {_sql_pick("90", "")} as pa, {_sql_pick("", "250.5")} as pb, {_sql_pick("x", "120")} as pm,
{_sql_pick("", "4.5", "fast")} as sr, [2, 0, 0, 0][vec_id % 4 + 1] as nf, {_sql_pick("20", "", "x")} as ga, {_sql_pick("40", "", "y", "50")} as gb, [2, 0, 0][vec_id % 3 + 1] as nm from embeddings)
select id, nullif(de, '') as description, coalesce(try_cast(ic as int), 0)::bigint as identification_count, coalesce(try_cast(ct as double), 0.7) as confidence_threshold, coalesce(try_cast(ac as int), 1) <> 0 as is_active, coalesce(try_cast(pa as double), 80) as pitch_min, coalesce(try_cast(pb as double), 300) as pitch_max, coalesce(try_cast(pm as double), 150) as pitch_mean,
try_cast(nullif(sr, '') as double) as speaking_rate, nf::bigint as features, case when ga <> '' and gb <> '' then coalesce(try_cast(ga as int), 0)::bigint end as age_min, case when ga <> '' and gb <> '' then coalesce(try_cast(gb as int), 100)::bigint end as age_max, nm::bigint as markers from t""")
def profile_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = store.decode_profiles(_stored(spark, sf_dir))
    long = lambda c, name: c.cast("long").alias(name)
    return out.select("id", "description", long(F.col("identification_count"), "identification_count"), "confidence_threshold", "is_active", F.col("pitch_range.min").alias("pitch_min"), F.col("pitch_range.max").alias("pitch_max"), "pitch_mean", "speaking_rate", long(F.size("quality_features"), "features"), long(F.col("age_range.min"), "age_min"), long(F.col("age_range.max"), "age_max"), long(F.size("language_markers"), "markers"))


_TEXTS = ("""{"id": "a", "speaker_id": "b", "vector": [1, 2.5], "dimensions": 2, "model_name": "m", "quality_score": 0.5, "duration_seconds": 3, "created_at": "now"}""", """{"id": 1, "speaker_id": "b", "vector": [], "dimensions": 2, "model_name": "m", "quality_score": 0.5, "duration_seconds": 3, "created_at": "now"}""", """{"id": "a", "speaker_id": "b", "vector": "none", "dimensions": 2}""", "{oops", "null")


@query(f"""with t as (select vec_id as id, {_sql_pick(*_TEXTS)} as j from embeddings),
v as (select id, case when json_valid(j) then j::json end as j from t)
select id, coalesce(json_type(j, '$.id') = 'VARCHAR' and json_type(j, '$.speaker_id') = 'VARCHAR' and json_type(j, '$.vector') = 'ARRAY' and json_type(j, '$.dimensions') in ('UBIGINT', 'BIGINT', 'DOUBLE') and json_type(j, '$.model_name') = 'VARCHAR'
and json_type(j, '$.quality_score') in ('UBIGINT', 'BIGINT', 'DOUBLE') and json_type(j, '$.duration_seconds') in ('UBIGINT', 'BIGINT', 'DOUBLE') and json_type(j, '$.created_at') = 'VARCHAR', false) as fine from v""")
def import_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.element_at(F.array(*[F.lit(t) for t in _TEXTS]), (F.col("vec_id") % len(_TEXTS) + 1).cast("int"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), store.well_formed(texts, store.EMBEDDING_FIELDS).alias("fine"))


@query(f"""with {WIDE}, {VOICES}, f as (select speaker_id + 5 as speaker_id, round(avg(quality), 6) as c, count(*) as n from voices group by 1),
p as (select w.speaker_id, w.name, coalesce(f.c, confidence_threshold) as confidence_threshold, f.c is not null or is_active as is_active from wide w left join f using (speaker_id) union all select speaker_id, 'Speaker ' || speaker_id, c, true from f where speaker_id not in (select speaker_id from wide)),
e as (select speaker_id, count(*) as n from voices group by 1 union all select speaker_id, n from f where speaker_id not in (select speaker_id from wide))
select p.speaker_id, name, confidence_threshold, is_active, coalesce(e.n, 0) as embeddings from p left join e using (speaker_id)""")
def diarization_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    voices = views.voices(spark, sf_dir)
    shifted = voices.withColumn("speaker_id", F.col("speaker_id") + 5)
    found = shifted.groupBy("speaker_id").agg(F.round(F.avg("quality"), 6).alias("confidence")).select("*", F.concat(F.lit("Speaker "), F.col("speaker_id").cast("string")).alias("name"), F.lit("#3B82F6").alias("color"), *[F.lit(None).cast(t).alias(c) for c, t in (("notes", "string"), ("pitch", "double"), ("rate", "double"))])
    own = wide(spark, sf_dir).select("speaker_id", "name", "confidence_threshold", "is_active")
    vectors = store.embeddings_of_result(shifted.select("id", "speaker_id", "vector", F.col("quality").alias("confidence"), F.lit(0).alias("start_ms"), (F.col("duration_s") * 1000).alias("end_ms")))
    kept, rows = store.store_result(own, voices.select("id", "speaker_id", "quality", "duration_s"), store.profiles_of_result(found), vectors)
    counts = rows.groupBy("speaker_id").agg(F.count("*").alias("embeddings"))
    return kept.join(counts, "speaker_id", "left").select("speaker_id", "name", "confidence_threshold", "is_active", F.coalesce("embeddings", F.lit(0)).alias("embeddings"))


@query(f"with {VOICES} select speaker_id, 80.0::double as pitch_min, 300.0::double as pitch_max, 150.0::double as pitch_mean, count(*) as vectors, sum(len(vector))::bigint as dimensions, round(sum(duration_s), 6) as total_s from voices group by 1")
def result_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    voices = views.voices(spark, sf_dir)
    found = voices.select("speaker_id").distinct().select("*", F.lit("x").alias("name"), F.lit("#3B82F6").alias("color"), F.lit(0.5).alias("confidence"), *[F.lit(None).cast(t).alias(c) for c, t in (("notes", "string"), ("pitch", "double"), ("rate", "double"))])
    vectors = store.embeddings_of_result(voices.select("id", "speaker_id", "vector", F.col("quality").alias("confidence"), F.lit(500).alias("start_ms"), (500 + F.col("duration_s") * 1000).alias("end_ms")))
    sums = vectors.groupBy("speaker_id").agg(F.count("*").alias("vectors"), F.sum("dimensions").alias("dimensions"), F.round(F.sum("duration_s"), 6).alias("total_s"))
    return store.profiles_of_result(found).join(sums, "speaker_id").select("speaker_id", "pitch_min", "pitch_max", "pitch_mean", "vectors", "dimensions", "total_s")


@query(f"with {SEGMENTS} select meeting, seq, case when seq = 1 and meeting % 2 = 0 then 'edited ' || meeting else text end as text from segments")
def segment_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.segments(spark, sf_dir)
    edits = rows.where("seq = 1 and meeting % 2 = 0").select("meeting", "seq", F.concat(F.lit("edited "), F.col("meeting").cast("string")).alias("text"))
    return store.edit(rows.select("meeting", "seq", "text"), edits, ["meeting", "seq"], "text")


@query(f"with {SEGMENTS} select case when speaker = 'user' then 'Ada' else speaker end as display, case when speaker = 'user' then '#10B981' else '#6B7280' end as color, count(*) as n from segments group by 1, 2")
def speaker_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([("user", "Ada", "#10B981"), ("nobody", "Bo", None)], "speaker string, display string, color string")
    out = store.looked_up(views.segments(spark, sf_dir).select("speaker"), names, "speaker", {"display": F.col("speaker"), "color": F.lit("#6B7280")})
    return out.groupBy("display", "color").agg(F.count("*").alias("n"))


@query("""with k as (select max(p_partkey) as latest from part where p_partkey % 10 <> 9)
select p_partkey as version, p_name as name, case when p_partkey > 50 and p_partkey % 10 <> 9 then 'undone' else 'kept' end as state, latest from part, k""")
def migration_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as applied migrations, taken back to version 50; every tenth is not known any more and stays."""
    applied = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("version"), F.col("p_name").alias("name"))
    known = applied.where("version % 10 <> 9")
    kept, undone = store.rolled_back(known, applied, 50)
    state = store.history(kept).withColumn("state", F.lit("kept")).unionByName(undone.withColumn("state", F.lit("undone")))
    return state.crossJoin(F.broadcast(store.current_version(known).select(F.col("version").alias("latest"))))


@query("""select count(*) as profiles, count(*) filter (where o_orderdate::timestamp > timestamp '1995-06-17' - interval 30 day) as valid, arg_min(o_orderkey::varchar, (-o_totalprice, o_orderkey::varchar)) as most_successful from orders""")
def device_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    devices = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("device"), F.col("o_orderdate").cast("timestamp").alias("checked_at"), F.col("o_totalprice").alias("successes"))
    return store.device_stats(devices, F.lit("1995-06-17").cast("timestamp"))


@query("select lang as kind, count(*) as files, sum(n_chars)::bigint as bytes from documents group by 1")
def storage_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.col("lang").alias("kind"), F.col("n_chars").alias("size"))
    return M.storage(files, "kind")


@query(f"""with {PROFILES}, {VOICES}, e as (select speaker_id, list(json_object('id', id, 'quality', quality) order by id) as e from voices group by 1)
select speaker_id, json_object('speaker_id', speaker_id, 'name', name, 'is_active', is_active, 'embeddings', e)::varchar as json from profiles join e using (speaker_id)""")
def profile_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.to_export(views.profiles(spark, sf_dir), views.voices(spark, sf_dir))


@query(f"with {PROFILES} select (select count(*) from profiles) as good, 2::bigint as bad")
def profile_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = store.to_export(views.profiles(spark, sf_dir)).select("json").union(spark.createDataFrame([("{oops",), ('{"speaker_id": "x", "name": 3',)], "json string"))
    good, bad = store.from_export(spark, texts, "speaker_id long, name string, is_active boolean")
    return good.agg(F.count("*").alias("good")).crossJoin(bad.agg(F.count("*").alias("bad")))


@query(f"with {MEETINGS} select id, language, quality from meetings where id not in (1, 3) union all select -1, 'en', 'high'")
def meeting_save_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.meetings(spark, sf_dir).select("id", "language", "quality")
    fresh = spark.createDataFrame([(-1, "en", "high"), (-2, "en", "low")], "id long, language string, quality string")
    return store.delete(M.saved(rows, fresh), spark.createDataFrame([(1,), (3,), (-2,)], "id long"), "id")


@query(f"with {MEETINGS} select id, speakers, duration_s from meetings order by speakers asc, id")
def meeting_sort_ascending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.ordered(views.meetings(spark, sf_dir).select("id", "speakers", "duration_s"), "speakers", descending=False)


@query(f"with {SEGMENTS} select meeting::varchar as recording, seq, speaker, start_ms, end_ms, confidence, true as named from segments")
def truth_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth written as JSON files and read again, with the name of the file."""
    from parley.sources import documents

    rows = views.segments(spark, sf_dir).withColumn("recording", F.col("meeting").cast("string"))
    place = written(documents.truth_json(rows).select("json"), "truth")
    folder = f"{place.inputFiles()[0].rsplit('/', 1)[0]}-json"
    place.write.text(folder)
    out = documents.read_truth(spark, folder, multi_line=False)
    return out.select("recording", "seq", "speaker", "start_ms", "end_ms", "confidence", F.col("file").contains("part-").alias("named"))


@query("""select doc_id::varchar as id, lang as language, epoch_ms(timestamp '2024-01-01' + interval (doc_id % 1000) hour) as date_ms, kind from documents, (values ('imported'), ('recorded')) t(kind)
where (kind = 'imported') = (doc_id % 2 = 0)""")
def meeting_list_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists of meetings as JSON, read and put one after the other."""
    from parley.sources import documents

    date = F.date_format(F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours=(F.col("doc_id") % 1000).cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    kind = F.when(F.col("doc_id") % 2 == 0, "imported").otherwise("recorded")
    item = F.struct(F.col("doc_id").cast("string").alias("id"), date.alias("date"), F.col("lang").alias("language"), kind.alias("title"))
    each = table(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 50).alias("g")).agg(*[F.to_json(F.collect_list(F.when(kind == k, item))).alias(k) for k in ("imported", "recorded")])
    out = documents.meeting_rows(each, "imported", "recorded")
    return out.select("id", "language", F.unix_millis("date").alias("date_ms"), F.col("title").alias("kind"))
