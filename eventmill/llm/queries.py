"""Registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventmill.llm import (
    contamination,
    dedup,
    filter_audit,
    jaccard,
    langid,
    main_text,
    pieces,
    secret_scan,
    sharding,
    suffix_tree,
    token_alignment,
    toxicity,
    warc,
)
from eventmill.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def reachable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver did, when it isn't installed."""
    known = spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        known["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register(
    "op1_exact_dedup",
    """
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256 FROM n WINDOW g AS (PARTITION BY t)""",
)
def op1(spark, sf_dir):
    return dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@register("op2_decontaminate", contamination.ORACLE)
def op2(spark, sf_dir):
    found = contamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@register("op3_shard", sharding.oracle())
def op3(spark, sf_dir):
    placed = sharding.shard_rows(table(spark, sf_dir, "documents"), shards=8)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@register("op4_suffix_tree")
def op4(spark, sf_dir):
    return suffix_tree.score_corpus(table(spark, sf_dir, "documents"))


@register("op5_secrets")
def op5(spark, sf_dir):
    return secret_scan.report(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


@register("op6_language_id")
def op6(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


@register("op7_sentencepiece")
def op7(spark, sf_dir):
    return pieces.encode_texts(table(spark, sf_dir, "documents"))


@register("op8_ngram_jaccard", jaccard.ORACLE)
def op8(spark, sf_dir):
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


@register(
    "op9_warc",
    """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p),
o AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to FROM o""",
)
def op9(spark, sf_dir):
    path = shared_dir(spark, "warc")
    warc.write_archives(warc.resolve_revisits(table(spark, sf_dir, "pages")), path)
    return warc.read_archives(spark, path).drop("url")


@register("op10_main_text")
def op10(spark, sf_dir):
    return main_text.main_text(table(spark, sf_dir, "pages"))


@register("op11_filter_audit", filter_audit.ORACLE)
def op11(spark, sf_dir):
    return filter_audit.filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op12_cross_tokenizer")
def op12(spark, sf_dir):
    return token_alignment.cross_alignment(table(spark, sf_dir, "documents"))


@register("op13_toxicity")
def op13(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
