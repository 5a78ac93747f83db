"""The numbered queries over the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgelake.llm import bpe, centroids, embedding_dedup, langid, near_dedup, packing, quality, resampling, substring_dedup, token_counts, token_files, urls, vector_search
from edgelake.llm.shared import new_path, read
from edgelake.llm.sql import OP12_SQL, OP13_SQL, clusters_sql


#: (verdict, host, path)
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

def sql_host(url: str) -> str:
    return f"translate(regexp_extract({url}, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def sql_node(url: str) -> str:
    scheme = f"translate(regexp_extract({url}, '(?s)^(.*?)://', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"case when contains({url}, '://') then {scheme} || '://' || {sql_host(url)} || regexp_extract({url}, '(?s)^.*?://[^/?#]*([^#]*)', 1) end"


SQL_PATH = "regexp_extract({}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
SQL_RULE = """(select arg_max(verdict || ' ' || rhost || rpath, length(rhost) + length(rpath)) from rules
    where ({0}.host = rhost or ends_with({0}.host, '.' || rhost)) and starts_with({0}.path, rpath))"""

OP6_SQL = rf"""
with recursive rules(verdict, rhost, rpath) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
p as (select page_id, url, html, coalesce({sql_host('url')}, '') host, coalesce({SQL_PATH.format('url')}, '') path from pages),
-- canonical links and meta refreshes, resolved against their page
tags as (select url, regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0) link,
    regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0) meta from pages where contains(url, '://')),
found as (
  select url, regexp_extract(link, '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1) target from tags
  union all select url, regexp_extract(meta, '(?is)\burl\s*=\s*["'']?\s*([^"''\s>]+)', 1) from tags),
parts as (
  select url, replace(target, '&amp;', '&') target, regexp_extract(url, '(?s)^.*?://[^/?#]*', 0) root, regexp_replace({SQL_PATH.format('url')}, '[^/]*$', '') folder
  from found where target <> ''),
whole as (
  select url, case when contains(target, '://') then target when starts_with(target, '//') then regexp_extract(url, '(?s)^(.*?:)//', 1) || target
    when starts_with(target, '/') then root || target else root || case when folder = '' then '/' else folder end || target end target
  from parts),
e as (select {sql_node('url')} a, {sql_node('target')} b from whole),
e2 as (select a, b from e where a <> b union select b, a from e where a <> b),
reach(a, b) as (select a, b from e2 union select r.a, e2.b from reach r join e2 on r.b = e2.a),
nodes as (select a url, {sql_host('a')} host, {SQL_PATH.format('a')} path from (select distinct a from e2)),
blocked as (select distinct b url from reach join nodes n on reach.a = n.url where starts_with({SQL_RULE.format('n')}, 'block')
  union select url from nodes n where starts_with({SQL_RULE.format('n')}, 'block')),
judged as (select page_id, host, path, {sql_node('url')} node, {SQL_RULE.format('p')} found from p)
select page_id, host, path, split_part(found, ' ', 2) rule,
  coalesce(split_part(found, ' ', 1), case when node in (select url from blocked) then 'block' end, 'allow') verdict
from judged
"""


def op1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passages(read(spark, sf_dir, "documents"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.fit(docs.where(~F.col("held_out")))
    return langid.predict(docs, model, keep=["doc_id", "held_out"])


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.components(read(spark, sf_dir, "documents"), percent=85).drop("text_hash")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.cut_and_pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, max_tokens=4096)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bpe.encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    shards = token_files.write_files(read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_files.read_files(spark, path, shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return made.withColumn("over_limit", F.col("n_tokens") > 1024)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rules = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.judge(docs.select("doc_id", "text"), rules).drop("text")


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.components(read(spark, sf_dir, "embeddings"), threshold=0.98)


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read(spark, sf_dir, "embeddings"), k=8, rounds=10, seed=3)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), percent=10, seed=2024).drop("n_words")


def op13_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest(read(spark, sf_dir, "embeddings"), k=20, every=20)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_passages, op2_langid, op3_near_dedup, op4_packing, op5_bpe, op6_urls, op7_token_files, op8_token_counts, op9_quality, op10_embeddings, op11_centroids, op12_resampling, op13_vector_search)}


def oracle_sql() -> dict[str, str]:
    return {"op6_urls": OP6_SQL, "op11_centroids": clusters_sql(k=8, rounds=10, seed=3), "op12_resampling": OP12_SQL, "op13_vector_search": OP13_SQL}
