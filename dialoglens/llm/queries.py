"""One registered query for each operator, with production parameters over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoglens.llm.bpe import bpe_decode, bpe_encode
from dialoglens.llm.compact_windows import repeated_passages
from dialoglens.llm.compression_rules import quality_rules
from dialoglens.llm.conversation_repair import damaged, repair, spoken
from dialoglens.llm.jaccard_join import jaccard_join
from dialoglens.llm.kmeans_tree import nearest
from dialoglens.llm.mixing import mixed_sample
from dialoglens.llm.oracles import REPAIR, codes_sql
from dialoglens.llm.packing import pack
from dialoglens.llm.quality_classifier import quality_scores
from dialoglens.llm.token_counts import token_counts
from dialoglens.llm.toxicity import toxicity_scores
from dialoglens.llm.url_filters import shared_urls, url_filter
from dialoglens.llm.vector_codes import vector_codes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> bytes:
    """A public vocabulary file's bytes; they are sent to executors, which need no such file."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_sample(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_compression_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op5_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter(pages, shared_urls(pages))


def op8_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json").decode())


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(spoken(table(spark, sf_dir, "conversations")))).summary


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text that they decode to."""
    spec = vocabulary("word_bpe_49k.json").decode()
    found = bpe_decode(bpe_encode(table(spark, sf_dir, "documents"), spec), spec)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_classifier, op2_mixing, op3_toxicity, op4_compression_rules, op5_compact_windows, op6_token_counts, op7_url_filters, op8_kmeans_tree, op9_packing, op10_jaccard_join, op11_conversation_repair, op12_vector_codes, op13_bpe)}


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP7_SQL = rf"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut
), named AS (
  SELECT *, CASE WHEN host <> '' THEN concat(regexp_replace(host, '^(www|m)\.', ''), regexp_replace(path, '(\.html)?/*$', '')) END AS canonical FROM parts
), listed AS (
  SELECT canonical FROM named WHERE canonical IS NOT NULL GROUP BY canonical HAVING count(DISTINCT page_id) > 1
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM named
)
SELECT r.page_id, r.host, r.path, r.rule,
       CASE WHEN r.rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN r.rule IS NOT NULL THEN 'block'
            WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       r.canonical, (r.rule IS NULL AND l.canonical IS NOT NULL) AS listed
FROM ruled r LEFT JOIN listed l ON r.canonical = l.canonical
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_url_filters": OP7_SQL, "op11_conversation_repair": REPAIR, "op12_vector_codes": codes_sql()}
