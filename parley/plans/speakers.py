"""Queries on speaker profiles and voice embeddings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import quantiles, similarity, store
from parley.operators.pages import Pages
from parley.operators.tables import KeyedTable
from parley.operators.vector_index import VectorIndex
from parley.plans import views
from parley.plans.registry import query
from parley.plans.views import PROFILES, VOICES
from parley.session import shared_dir, table

LEAST, TOP = 0.2, 5
QUERY_SET = "qs as (select id as query_id, vector as qv from voices where id % 100 = 0)"


def _query_set(voices: DataFrame) -> DataFrame:
    """The stated query set: every row whose id is divisible by 100."""
    return voices.where("id % 100 = 0")


def _index(voices: DataFrame) -> VectorIndex:
    return VectorIndex.build(voices, f"{shared_dir(voices.sparkSession)}/index-{uuid.uuid4().hex}")


@query(f"""with {PROFILES}, {VOICES}, {QUERY_SET},
s as (select query_id, speaker_id, name, list_cosine_similarity(vector, qv) as sim from voices join profiles using (speaker_id), qs where is_active),
b as (select query_id, speaker_id, name, max(sim) as sim, count(*) as matches from s where sim >= {LEAST} group by all),
r as (select *, row_number() over (partition by query_id order by sim desc, speaker_id) as k from b)
select query_id, speaker_id, name, round(sim, 6) as similarity, matches from r where k <= {TOP}""")
def similar_speakers_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    voices = views.voices(spark, sf_dir)
    return similarity.similar_speakers(_query_set(voices), voices, views.profiles(spark, sf_dir), LEAST, TOP).withColumn("similarity", F.round("similarity", 6))


@query(f"""with {VOICES}, {QUERY_SET},
p as (select query_id, id, speaker_id, list_cosine_similarity(vector, qv) as sim from voices, qs where id <> query_id),
b as (select *, row_number() over (partition by query_id order by sim desc, id) as k from p where sim > 0.3)
select q.query_id, b.speaker_id, round(b.sim, 6) as similarity from qs q left join b on q.query_id = b.query_id and k = 1""")
def reidentify_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    voices = views.voices(spark, sf_dir)
    return similarity.reidentify(_query_set(voices), voices, 0.3).withColumn("similarity", F.round("similarity", 6))


@query(f"with {VOICES}, {QUERY_SET} select query_id, id, round(list_cosine_similarity(vector, qv), 6) as cosine from voices, qs")
def pairwise_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    voices = views.voices(spark, sf_dir)
    return similarity.scored_against(_query_set(voices), voices).select("query_id", "id", F.round("similarity", 6).alias("cosine"))


_BIT = "case when list_sum(list_transform(range(len(vector)), lambda j: vector[j + 1] * sin(1000 * {h} + j))) > 0 then '1' else '0' end"
_SIGNATURE = " || ".join(_BIT.format(h=h) for h in range(8))


@query(f"with {VOICES} select id, {_SIGNATURE} as signature from voices")
def lsh_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.voices(spark, sf_dir).select("id", similarity.signature(F.col("vector")).alias("signature"))


@query(f"""with {VOICES}, {QUERY_SET}, s as (select id, {_SIGNATURE} as sig from voices),
p as (select q.query_id, len(list_filter(range(1, 9), lambda i: sq.sig[i] = s.sig[i])) as same from qs q join s sq on sq.id = q.query_id, s)
select query_id, count(*) filter (where same >= 1) as any_bit, count(*) filter (where same >= 6) as six_bits from p group by query_id""")
def lsh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    voices = views.voices(spark, sf_dir)
    one = similarity.candidate_counts(_query_set(voices), voices, 1).withColumnRenamed("n", "any_bit")
    six = similarity.candidate_counts(_query_set(voices), voices, 6).withColumnRenamed("n", "six_bits")
    return one.join(six, "query_id", "left").select("query_id", "any_bit", F.coalesce("six_bits", F.lit(0)).alias("six_bits"))


@query(f"""with {VOICES}, {QUERY_SET}, s as (select id, speaker_id, {_SIGNATURE} as sig from voices), q as (select s.* from s join qs on id = query_id)
select q.id as query_id, s.id from q join s on len(list_filter(range(1, 9), lambda i: q.sig[i] = s.sig[i])) >= 6""")
def lsh_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    voices = views.voices(spark, sf_dir)
    return similarity.candidates(_query_set(voices), voices, 6)


@query(f"""with {VOICES}, {QUERY_SET}, s as (select id, speaker_id, vector, {_SIGNATURE} as sig from voices),
q as (select query_id, qv, sig from qs join s on id = query_id),
c as (select distinct query_id, speaker_id from q join s on len(list_filter(range(1, 9), lambda i: q.sig[i] = s.sig[i])) > 0),
a as (select query_id, speaker_id from c union select q.query_id, s.speaker_id from q, s where q.query_id not in (select query_id from c)),
b as (select query_id, speaker_id, max(list_cosine_similarity(vector, qv)) as sim from a join q using (query_id) join s using (speaker_id) group by all),
r as (select *, row_number() over (partition by query_id order by sim desc, speaker_id) as k from b where sim >= {LEAST})
select query_id, speaker_id, round(sim, 6) as similarity from r where k <= {TOP}""")
def lsh_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    voices = views.voices(spark, sf_dir)
    return similarity.lsh_search(_query_set(voices), voices, _index(voices), LEAST, TOP).withColumn("similarity", F.round("similarity", 6))


@query(f"""with {VOICES}, s as (select id, speaker_id, {_SIGNATURE} as sig from voices), b as (select id, speaker_id, i || '_' || sig[i + 1] as bucket from s, range(8) t(i))
select count(distinct speaker_id) as speakers, count(distinct id) as embeddings, count(distinct bucket) as buckets, count(*) as entries from b""")
def lsh_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = similarity.lsh_index(views.voices(spark, sf_dir))
    return index.agg(F.countDistinct("speaker_id").alias("speakers"), F.countDistinct("id").alias("embeddings"), F.countDistinct("bucket").alias("buckets"), F.count("*").alias("entries"))


@query(f"""with {VOICES}, s as (select id, speaker_id, {_SIGNATURE} as sig from voices where speaker_id <> 4), b as (select speaker_id, i || '_' || sig[i + 1] as bucket from s, range(8) t(i))
select speaker_id, bucket, count(*) as n from b where speaker_id <> 2 group by 1, 2 union all
select 2, i || '_' || (case when bit = '0' then '1' else '0' end), count(*) from (select i, sig[i + 1] as bit from s, range(8) t(i) where speaker_id = 2) group by 1, 2""")
def lsh_maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index without speaker 4 and with the vectors of speaker 2 replaced by their opposites."""
    voices = views.voices(spark, sf_dir)
    less = similarity.index_without(similarity.lsh_index(voices), spark.createDataFrame([(4,)], "speaker_id long"))
    fresh = voices.where("speaker_id = 2").withColumn("vector", F.transform("vector", lambda x: -x))
    return similarity.index_replaced(less, fresh).groupBy("speaker_id", "bucket").agg(F.count("*").alias("n"))


@query()
def ivf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of each query by cells and codes; a test counts pairs and measures recall."""
    voices = views.voices(spark, sf_dir)
    return _index(voices).search(_query_set(voices), 10).withColumn("similarity", F.round("similarity", 6))


@query()
def band_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of each query by codes alone, in all cells."""
    voices = views.voices(spark, sf_dir)
    index = _index(voices)
    asked = _query_set(voices).select("id", "vector", F.lit(None).cast("double").alias("least"))
    found = index.best(index.probe(asked, 10, other=True, probes=len(index.trained.centres)), 10)
    return found.select("query_id", "id", F.round("similarity", 6).alias("similarity"))


@query(f"""with {VOICES}, {QUERY_SET}, p as (select query_id, id, list_cosine_similarity(vector, qv) as sim from voices, qs where id <> query_id),
r as (select *, row_number() over (partition by query_id order by sim desc, id) as place from p)
select query_id, id, round(sim, 6) as similarity, place from r where place <= 10""")
def ivf_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    voices = views.voices(spark, sf_dir)
    return _index(voices).search(_query_set(voices), 10, exact=True).withColumn("similarity", F.round("similarity", 6))


@query(f"""with {VOICES}, {QUERY_SET}, v as (select id, speaker_id, vector from voices where speaker_id not in (2, 4) and id % 7 <> 3
union all select id, speaker_id, list_transform(vector, lambda x: -x) from voices where speaker_id = 2),
p as (select query_id, id, list_cosine_similarity(vector, qv) as sim from v, qs where id <> query_id),
r as (select *, row_number() over (partition by query_id order by sim desc, id) as place from p)
select query_id, id, round(sim, 6) as similarity, place from r where place <= 3""")
def ivf_maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact search after rows were put in, a speaker and single rows taken out and another speaker's replaced."""
    voices = views.voices(spark, sf_dir)
    index = _index(voices.where("id % 3 <> 1"))
    index.add(voices.where("id % 3 = 1"))
    index.remove(spark.createDataFrame([(4,)], "speaker_id long"))
    index.remove(voices.where("id % 7 = 3").select("id"), "id")
    index.replace(voices.where("speaker_id = 2").withColumn("vector", F.transform("vector", lambda x: -x)))
    return index.search(_query_set(voices), 3, exact=True).withColumn("similarity", F.round("similarity", 6))


@query(f"with {VOICES} select id, quality, duration_s from voices where speaker_id = 3 order by quality desc, id")
def embeddings_by_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.voices(spark, sf_dir).where("speaker_id = 3").select("id", "quality", "duration_s").orderBy(F.desc("quality"), "id")


@query(f"with {PROFILES} select speaker_id, name, is_active from profiles where is_active order by name")
def active_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.profiles(spark, sf_dir).where("is_active").orderBy("name")


@query(f"with {PROFILES} select speaker_id, name, is_active from profiles where speaker_id = 7")
def profile_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.profiles(spark, sf_dir).where("speaker_id = 7")


def _table(rows: DataFrame) -> KeyedTable:
    """A stored table of the rows in the shared folder."""
    return KeyedTable.create(rows, f"{shared_dir(rows.sparkSession)}/table-{uuid.uuid4().hex}", "speaker_id", 8)


@query(f"with {PROFILES} select speaker_id, case when speaker_id = 2 then 'Renamed' else name end as name, case when speaker_id = 3 then false else is_active end as is_active from profiles")
def profile_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = spark.createDataFrame([(2, "Renamed", None), (3, None, False), (99, "Nobody", True)], "speaker_id long, name string, is_active boolean")
    table = _table(views.profiles(spark, sf_dir))
    table.update(changes)
    return table.read()


@query(f"""with {PROFILES}, {VOICES} select 'profiles' as name, count(*) as n from profiles where speaker_id not in (1, 4)
union all select 'embeddings', count(*) from voices where speaker_id not in (1, 4)""")
def profile_delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.createDataFrame([(1,), (4,)], "speaker_id long")
    profiles, voices = _table(views.profiles(spark, sf_dir)), _table(views.voices(spark, sf_dir))
    profiles.delete(keys, voices)
    a, b = profiles.read(), voices.read()
    return a.agg(F.count("*").alias("n")).select(F.lit("profiles").alias("name"), "n").union(b.agg(F.count("*").alias("n")).select(F.lit("embeddings"), "n"))


@query(f"""with {PROFILES} select * from profiles where speaker_id not in (0, 100) union all select 0, 'First', true union all select 100, 'New', false""")
def profile_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = spark.createDataFrame([(0, "First", True), (100, "New", False)], "speaker_id long, name string, is_active boolean")
    table = _table(views.profiles(spark, sf_dir))
    table.upsert(fresh)
    return table.read()


@query(f"""with {PROFILES}, {VOICES}, m as (select case when speaker_id = 6 then 5 else speaker_id end as speaker_id from voices)
select p.speaker_id, p.name, case when p.speaker_id = 5 then 'Merged profile: Speaker 5 + Speaker 6' end as description, count(m.speaker_id) as embeddings
from profiles p left join m using (speaker_id) where p.speaker_id <> 6 group by p.speaker_id, p.name""")
def profile_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, voices = store.merge_profiles(views.profiles(spark, sf_dir), views.voices(spark, sf_dir), 5, 6)
    counts = voices.groupBy("speaker_id").agg(F.count("*").alias("embeddings"))
    return kept.join(counts, "speaker_id", "left").select("speaker_id", "name", "description", F.coalesce("embeddings", F.lit(0)).alias("embeddings"))


@query(f"with {PROFILES}, {VOICES} select speaker_id, name from profiles p where is_active and contains(lower(name), 'speaker') and exists (select 1 from voices v where v.speaker_id = p.speaker_id and quality >= 0.9)")
def profiles_with_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = views.voices(spark, sf_dir).where("quality >= 0.9")
    return views.profiles(spark, sf_dir).where(F.col("is_active") & F.lower("name").contains("speaker")).join(good, "speaker_id", "left_semi").select("speaker_id", "name")


@query(f"""with {PROFILES}, t as (select count(*) as total_count from profiles)
select speaker_id, name, is_active, total_count, 2::bigint as page, 4::bigint as page_size, total_count > 8 as has_more from profiles, t order by name offset 4 limit 4""")
def profiles_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.page(views.profiles(spark, sf_dir), ["name"], 2, 4)


@query(f"with {PROFILES}, {VOICES} select (select count(*) from profiles) as profiles, (select count(*) from voices) as embeddings, (select count(distinct conv_id) from conversations) as meetings")
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.profiles(spark, sf_dir).agg(F.count("*").alias("profiles"))
    b = views.voices(spark, sf_dir).agg(F.count("*").alias("embeddings"))
    return a.crossJoin(b).crossJoin(table(spark, sf_dir, "conversations").agg(F.countDistinct("conv_id").alias("meetings")))


@query("select p_partkey as version, p_name as name, md5('alter ' || p_name) as checksum from part where p_partkey % 5 <> 0")
def pending_migrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as migrations, of which every fifth was applied."""
    every = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("version"), F.col("p_name").alias("name"), F.concat(F.lit("alter "), "p_name").alias("sql"))
    return store.pending(every, every.where("version % 5 = 0").select("version")).select("version", "name", "checksum")


@query("""with o as (select o_orderkey, o_totalprice, row_number() over (order by o_totalprice desc, o_orderkey) - 1 as place, count(*) over () as total_count from orders),
p as (select unnest([1, 1 + total_count // 100, 1 + (total_count - 1) // 50]) as page, total_count from (select count(*) as total_count from orders))
select o_orderkey, place, o.total_count, p.page, 50::bigint as page_size, o.total_count > p.page * 50 as has_more from o join p on place >= (p.page - 1) * 50 and place < p.page * 50""")
def deep_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first, a middle and the last page of the orders by price."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    stored = Pages.create(rows, f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}", [F.desc("o_totalprice"), F.col("o_orderkey")], 5000)
    total = stored.total()
    out = [stored.page(n, 50) for n in (1, 1 + total // 100, 1 + (total - 1) // 50)]
    return out[0].unionByName(out[1]).unionByName(out[2]).drop("o_totalprice")


@query()
def value_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of event values by kind, from sketches by kind and day that are merged; tests measure ranks."""
    rows = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"), "value")
    by_day = quantiles.sketched(rows, ["event_type", "day"], "value")
    return quantiles.quantiles(quantiles.merged(by_day, ["event_type"]), (0.5, 0.95, 0.99))


@query(f"""with {VOICES}, u as (select speaker_id, list_transform(vector, lambda x: x / sqrt(list_sum(list_transform(vector, lambda y: y * y)))) as v, id from voices),
p as (select a.speaker_id = b.speaker_id as same, list_inner_product(a.v, b.v) as s from u a join u b on a.id < b.id)
select round(avg(s) filter (where same), 6) as intra, round(avg(s) filter (where not same), 6) as inter from p""")
def cluster_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.cluster_quality(views.voices(spark, sf_dir)).select(F.round("intra", 6).alias("intra"), F.round("inter", 6).alias("inter"))


@query(f"""with {VOICES} select a.speaker_id as a, b.speaker_id as b, round(avg(list_cosine_similarity(a.vector, b.vector)), 6) as similarity
from voices a join voices b on a.speaker_id < b.speaker_id group by 1, 2""")
def profile_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.profile_similarity(views.voices(spark, sf_dir)).withColumn("similarity", F.round("similarity", 6))


@query(f"""with {PROFILES}, {VOICES} select p.speaker_id, count(v.id) as embeddings, round(avg(quality), 6) as mean_quality, round(sum(duration_s), 6) as total_s
from profiles p left join voices v using (speaker_id) group by 1""")
def speaker_profile_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.profiles(spark, sf_dir).join(views.voices(spark, sf_dir), "speaker_id", "left")
    return rows.groupBy("speaker_id").agg(F.count("id").alias("embeddings"), F.round(F.avg("quality"), 6).alias("mean_quality"), F.round(F.sum("duration_s"), 6).alias("total_s"))


@query(f"""with {VOICES}, x as (select id, vector, len(vector) as n, list_sum(list_transform(vector, lambda v: abs(v))) as mass from voices)
select id, round(sqrt(list_sum(list_transform(vector, lambda v: v * v)) / n), 6) as rms,
round(len(list_filter(range(1, n), lambda i: (vector[i] >= 0) <> (vector[i + 1] >= 0))) / (n - 1), 6) as crossings,
round(list_sum(list_transform(range(n), lambda i: abs(vector[i + 1]) * i)) / mass, 6) as centroid,
(select min(i) from range(n) t(i) where list_sum(list_transform(vector[1:i + 1], lambda v: abs(v))) >= 0.85 * mass) as rolloff from x""")
def zcr_centroid_rolloff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.functions import signal as S

    v = F.col("vector")
    return views.voices(spark, sf_dir).select("id", F.round(S.rms(v), 6).alias("rms"), F.round(S.zero_crossings(v), 6).alias("crossings"), F.round(S.centroid(v), 6).alias("centroid"), S.rolloff(v).cast("long").alias("rolloff"))


@query(f"""with {VOICES}, r as (select id, vector, i, i * (16.0::double / 24) as place from voices, range((len(vector) * 24 // 16)::bigint) t(i)),
y as (select id, i, vector[least(floor(place)::int, len(vector) - 1) + 1] as a, vector[least(floor(place)::int + 1, len(vector) - 1) + 1] as b, place - floor(place) as f from r)
select id, count(*) as n, round(sum(a + (b - a) * f), 6) as total, round(sum((a + (b - a) * f) * i), 6) as weighted from y group by id""")
def resample_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.functions import signal as S

    out = views.voices(spark, sf_dir).select("id", S.resample(F.col("vector"), 16, 24).alias("y"))
    return out.select("id", F.size("y").cast("long").alias("n"), F.round(S.total(F.col("y")), 6).alias("total"), F.round(S.total(F.transform("y", lambda v, i: v * i)), 6).alias("weighted"))
