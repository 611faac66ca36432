"""Keyed tables of profiles, embeddings and meetings: update, delete, upsert, merge, pages, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def update(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``rows`` with the non-null cells of ``changes`` (at most one row for each key) put in."""
    names = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in names])
    joined = rows.join(new, key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", F.col(c)).alias(c) if c in names else F.col(c) for c in rows.columns])


def delete(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key).distinct(), key, "left_anti")


def delete_cascade(parents: DataFrame, children: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the keys, so no child is left without its parent."""
    return delete(parents, keys, key), delete(children, keys, key)


def upsert(rows: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Rows of ``fresh`` replace those with the same key; the rest is added."""
    return delete(rows, fresh, key).unionByName(fresh)


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row for each key: the last by ``order``."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("_k", rank).where("_k = 1").drop("_k")


def merge_profiles(profiles: DataFrame, voices: DataFrame, primary: int, secondary: int, key: str = "speaker_id") -> tuple[DataFrame, DataFrame]:
    """Vectors of ``secondary`` go to ``primary``, whose name says so; ``secondary`` goes."""
    names = profiles.where(F.col(key).isin(primary, secondary)).agg(F.max(F.when(F.col(key) == primary, F.col("name"))).alias("_p"), F.max(F.when(F.col(key) == secondary, F.col("name"))).alias("_s"))
    kept = profiles.where(F.col(key) != secondary).crossJoin(F.broadcast(names))
    described = kept.withColumn("description", F.when(F.col(key) == primary, F.concat(F.lit("Merged profile: "), "_p", F.lit(" + "), "_s"))).drop("_p", "_s")
    return described, voices.withColumn(key, F.when(F.col(key) == secondary, F.lit(primary)).otherwise(F.col(key)))


def page(rows: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """A page of the ordered rows with ``total_count, page, page_size, has_more``; only the page is sorted out."""
    total = rows.agg(F.count("*").alias("total_count"))
    own = rows.orderBy(*order).offset((number - 1) * size).limit(size)
    out = own.crossJoin(F.broadcast(total))
    return out.select("*", F.lit(number).cast("long").alias("page"), F.lit(size).cast("long").alias("page_size"), (F.col("total_count") > number * size).alias("has_more"))


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows that break the foreign key."""
    return children.join(parents.select(key), key, "left_anti")


def pending(migrations: DataFrame, applied: DataFrame) -> DataFrame:
    """Migrations (version, name, sql) not applied yet, with the checksum of their text."""
    return migrations.join(applied.select("version"), "version", "left_anti").withColumn("checksum", F.md5("sql"))


def current_version(applied: DataFrame) -> DataFrame:
    return applied.agg(F.coalesce(F.max("version"), F.lit(0)).alias("version"))


def to_export(profiles: DataFrame, voices: DataFrame | None = None, key: str = "speaker_id") -> DataFrame:
    """One JSON text for each profile, with its vectors' ids and qualities if they are given."""
    rows = profiles
    if voices is not None:
        lists = voices.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("id", "quality"))).alias("embeddings"))
        rows = rows.join(lists, key, "left")
    return rows.select(key, F.to_json(F.struct(*[c for c in rows.columns])).alias("json"))


def from_export(spark: SparkSession, texts: DataFrame, schema: str, column: str = "json") -> tuple[DataFrame, DataFrame]:
    """Rows that could be read, and the texts that could not."""
    read = texts.select(F.col(column), F.from_json(column, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    good = read.where("r is not null and r._bad is null").select("r.*").drop("_bad")
    return good, read.where("r is null or r._bad is not null").select(column)


def create(rows: DataFrame, requests: DataFrame, defaults: dict[str, Column], key: str) -> DataFrame:
    """``rows`` and new ones: null or missing cells of ``requests`` get ``defaults``; keys that exist already are left out."""
    fresh = requests.join(rows.select(key), key, "left_anti")
    cells = [F.coalesce(*([F.col(c)] if c in fresh.columns else []), *([defaults[c]] if c in defaults else []), F.lit(None)).alias(c) for c in rows.columns]
    return rows.unionByName(fresh.select(*cells))


def add_children(children: DataFrame, fresh: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """``children`` and those of ``fresh`` whose parent exists, as the foreign key asks."""
    return children.unionByName(fresh.join(parents.select(key), key, "left_semi"))


def find_profiles(profiles: DataFrame, voices: DataFrame, name: str | None = None, after: str | None = None, before: str | None = None, min_confidence: float | None = None, has_embeddings: bool | None = None, is_active: bool | None = None, color: str | None = None, min_count: int | None = None, key: str = "speaker_id") -> DataFrame:
    """Profiles that fit every filter given; what is None does not filter. Times are ISO texts, both ends count."""
    tests = [
        (name, lambda v: F.lower("name").contains(v.lower())),
        (after, lambda v: F.col("created_at") >= F.lit(v).cast("timestamp")),
        (before, lambda v: F.col("created_at") <= F.lit(v).cast("timestamp")),
        (min_confidence, lambda v: F.col("confidence_threshold") >= v),
        (is_active, lambda v: F.col("is_active") == v),
        (color, lambda v: F.upper("color") == v.upper()),
        (min_count, lambda v: F.col("identification_count") >= v),
    ]
    out = profiles
    for value, test in tests:
        out = out if value is None else out.where(test(value))
    return out if has_embeddings is None else out.join(voices.select(key), key, "left_semi" if has_embeddings else "left_anti")


def name_problem(candidates: DataFrame, taken: DataFrame, name: str = "name", own: str = "own", most: int = 100) -> DataFrame:
    """``candidates`` with ``problem``: why a new name cannot be used; empty if it can.

    Names are trimmed. The row's own present name may be kept, another one's may not be taken.
    """
    used = taken.select(F.col(name).alias("_used")).distinct()
    trimmed = F.trim(F.coalesce(F.col(name), F.lit("")))
    rows = candidates.withColumn("_new", trimmed).join(used, F.col("_new") == F.col("_used"), "left")
    problem = F.when(F.col("_new") == "", "empty").when(F.char_length("_new") > most, "too long").when(F.col("_new").eqNullSafe(F.col(own)), "").when(F.col("_used").isNotNull(), "in use").otherwise("")
    return rows.withColumn("problem", problem).drop("_new", "_used")


def decode_profiles(rows: DataFrame) -> DataFrame:
    """Typed profiles of rows of text: what is empty is null, what cannot be read gets its default."""
    text = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    number = lambda c, kind, other: F.coalesce(F.col(c).try_cast(kind), F.lit(other))
    features = F.coalesce(F.from_json("quality_features", "map<string,double>"), F.create_map().cast("map<string,double>"))
    markers = F.coalesce(F.from_json("language_markers", "array<string>"), F.array().cast("array<string>"))
    ages = F.when(text("age_range_min").isNotNull() & text("age_range_max").isNotNull(), F.struct(number("age_range_min", "int", 0).alias("min"), number("age_range_max", "int", 100).alias("max")))
    pitch = F.struct(number("pitch_range_min", "double", 80.0).alias("min"), number("pitch_range_max", "double", 300.0).alias("max"))
    return rows.select(
        "id", "name", text("description").alias("description"), "color", number("identification_count", "int", 0).alias("identification_count"), number("confidence_threshold", "double", 0.7).alias("confidence_threshold"),
        (number("is_active", "int", 1) != 0).alias("is_active"), pitch.alias("pitch_range"), number("pitch_mean", "double", 150.0).alias("pitch_mean"), text("speaking_rate").try_cast("double").alias("speaking_rate"),
        features.alias("quality_features"), text("gender").alias("gender"), ages.alias("age_range"), markers.alias("language_markers"),
    )


#: JSON kinds that fields of imported rows must have.
PROFILE_FIELDS = {"id": "STRING", "name": "STRING", "color": "STRING", "created_at": "STRING", "updated_at": "STRING", "identification_count": "NUMBER", "confidence_threshold": "NUMBER", "is_active": "BOOLEAN", "voice_characteristics": "OBJECT"}
EMBEDDING_FIELDS = {"id": "STRING", "speaker_id": "STRING", "vector": "ARRAY", "dimensions": "NUMBER", "model_name": "STRING", "quality_score": "NUMBER", "duration_seconds": "NUMBER", "created_at": "STRING"}
PARTICIPANT_FIELDS = {"id": "STRING", "meeting_id": "STRING", "speaker_id": "STRING", "display_name": "STRING", "speaking_time_seconds": "NUMBER", "segment_count": "NUMBER", "average_confidence": "NUMBER", "first_spoken_at": "STRING", "last_spoken_at": "STRING", "is_verified": "BOOLEAN"}


def well_formed(json: Column, fields: dict[str, str]) -> Column:
    """Whether a JSON text is an object whose ``fields`` have the kinds named; no for null and bad JSON."""
    shape = {"STRING": "STRING", "NUMBER": "(?:BIGINT|DOUBLE|DECIMAL[^,>]*)", "BOOLEAN": "BOOLEAN", "OBJECT": "OBJECT<", "ARRAY": "ARRAY<"}
    fine = F.lit(True)
    for name, kind in fields.items():
        own = F.schema_of_variant(F.try_variant_get(F.try_parse_json(json), f"$.{name}", "variant"))
        fine = fine & F.coalesce(own.rlike(f"^{shape[kind]}"), F.lit(False))
    return fine


def profiles_of_result(found: DataFrame) -> DataFrame:
    """Profiles of the speakers of a diarization (speaker_id, name, color, notes, pitch, rate, confidence)."""
    pitch = lambda other: F.coalesce("pitch", F.lit(other))
    return found.select("speaker_id", "name", F.col("notes").alias("description"), "color", pitch(80.0).alias("pitch_min"), pitch(300.0).alias("pitch_max"), pitch(150.0).alias("pitch_mean"), F.col("rate").alias("speaking_rate"), F.col("confidence").alias("confidence_threshold"), F.lit(True).alias("is_active"), F.lit(0).alias("identification_count"))


def embeddings_of_result(found: DataFrame, model: str = "diarization_model") -> DataFrame:
    """Stored embeddings of a diarization's (id, speaker_id, vector, confidence, start_ms, end_ms)."""
    return found.select("id", "speaker_id", "vector", F.size("vector").alias("dimensions"), F.lit(model).alias("model_name"), F.col("confidence").alias("quality"), ((F.col("end_ms") - F.col("start_ms")) / 1000).alias("duration_s"))


def store_result(profiles: DataFrame, voices: DataFrame, found: DataFrame, vectors: DataFrame, key: str = "speaker_id") -> tuple[DataFrame, DataFrame]:
    """Profiles and voices with a diarization put in: speakers that are known get its confidence and
    become active, new ones are added with their vectors."""
    known = found.select(key, F.col("confidence_threshold").alias("_c"))
    kept = profiles.join(known, key, "left").select(*[F.coalesce("_c", c).alias(c) if c == "confidence_threshold" else (F.col("_c").isNotNull() | F.col(c)).alias(c) if c == "is_active" else F.col(c) for c in profiles.columns])
    fresh = found.join(profiles.select(key), key, "left_anti")
    return kept.unionByName(fresh.select(*profiles.columns)), voices.unionByName(vectors.join(fresh.select(key), key, "left_semi").select(*voices.columns))


def edit(rows: DataFrame, edits: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``rows`` with ``column`` replaced where ``edits`` (keys and column) say so."""
    new = edits.select(*keys, F.col(column).alias("_new"))
    return rows.join(new, keys, "left").select(*[F.coalesce("_new", c).alias(c) if c == column else F.col(c) for c in rows.columns])


def looked_up(rows: DataFrame, names: DataFrame, key: str, fallback: dict[str, Column]) -> DataFrame:
    """``rows`` with the columns of ``names`` for their key, or a fallback where it is unknown."""
    return rows.join(names, key, "left").select(*rows.columns, *[F.coalesce(F.col(c), other).alias(c) for c, other in fallback.items()])


def rolled_back(migrations: DataFrame, applied: DataFrame, target: int) -> tuple[DataFrame, DataFrame]:
    """What stays applied after going down to ``target``, and what is undone, latest first; a version
    without a known migration stays."""
    down = applied.where(F.col("version") > target).join(migrations.select("version"), "version", "left_semi")
    return applied.join(down.select("version"), "version", "left_anti"), down.orderBy(F.desc("version"))


def history(applied: DataFrame) -> DataFrame:
    """Applied migrations in order of version."""
    return applied.orderBy("version")


def device_stats(devices: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Number of device profiles, how many were checked within ``days``, and the one that worked most often (ties: first name)."""
    fresh = F.count_if(F.col("checked_at") > now - F.make_interval(days=F.lit(days)))
    return devices.agg(F.count("*").alias("profiles"), fresh.alias("valid"), F.min_by("device", F.struct((-F.col("successes")).alias("n"), "device")).alias("most_successful"))
