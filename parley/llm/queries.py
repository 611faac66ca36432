"""Queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

import json
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import bpe, chat_format, classifier, decontaminate, exact_dedup, html_extract, prefix_trie, secrets, simhash, suffix_dedup, turn_repair, url_filter, warc
from parley.session import shared_dir, table

RANKS = "byte_bpe_multi_50k.tiktoken"
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    said = json.dumps({"messages": [{"role": r, "content": probe} for r in ("user", "assistant")]})
    extra = chat_format.canonical_rows(spark.createDataFrame([(-1, said)], "conv_id long, row string"), "row")
    turns = chat_format.canonical(table(spark, sf_dir, "conversations")).unionByName(extra)
    return chat_format.digests(chat_format.format_chats(turns)).withColumnRenamed("_conv", "conv_id")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return out.select(F.col("_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = secrets.scan(docs, secrets.train(known=secrets.dictionary(docs))).withColumn("redacted", secrets.redact())
    return found.select("doc_id", F.size("findings").cast("long").alias("n_findings"), "findings", F.sha2("redacted", 256).alias("redacted_sha256"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_texts(table(spark, sf_dir, "pages"), html_extract.train())


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return out.withColumnRenamed("_id", "doc_id")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.withColumnRenamed("_id", "doc_id")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents")).withColumnRenamed("_id", "doc_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(table(spark, sf_dir, "documents")).withColumnRenamed("_id", "doc_id")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return classifier.score(docs, classifier.train(docs, labels)).withColumnRenamed("_id", "doc_id")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turn_repair.digests(turns, *turn_repair.repair(turn_repair.damage(turns)))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, out = table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(pages, out)
    ids = pages.schema["page_id"].dataType
    found = warc.records(warc.chunks(spark, out, data=False))
    return found.select(F.col("page_id").cast(ids), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.col("refers_to").cast(ids), "intact")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.paths(table(spark, sf_dir, "conversations"))))


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_url_filter, op3_exact_dedup, op4_secret_scan, op5_html_extract, op6_bpe, op7_decontaminate, op8_suffix_dedup, op9_simhash, op10_quality, op11_turn_repair, op12_warc, op13_prefix_trie)}

SQL = {
    "op2_url_filter": """
with u as (select page_id, coalesce(url, '') as url from pages),
r as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from u),
h as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r),
rules(rhost, rpath, verdict) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m as (select page_id, rhost || rpath as rule, verdict, row_number() over (partition by page_id order by length(rhost || rpath) desc) as k
      from h join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath))
select h.page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from h left join m on h.page_id = m.page_id and k = 1
""",
    "op3_exact_dedup": r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
n as (select doc_id, length(t) as n, sha256(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as text_sha256 from d)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by text_sha256) as group_size,
       row_number() over w = 1 as kept, text_sha256
from n window w as (partition by text_sha256 order by n desc, doc_id)
""",
    "op12_warc": """
with p as (select page_id, coalesce(html, '') as h from pages),
n as (select page_id, strlen(h) as payload_bytes, sha1(h) as payload_digest, case when strlen(h) >= 1000 then max(page_id) over (partition by h) end as keeper from p)
select page_id, payload_bytes, payload_digest, case when page_id < keeper then 'revisit' else 'response' end as record_type,
       case when page_id < keeper then keeper end as refers_to, true as intact
from n
""",
}
