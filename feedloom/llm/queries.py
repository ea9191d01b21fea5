"""The dealt operators as queries over the whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, common, decontaminate, language, media, near_dup, packing, sharding, token_counts, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    dealt = sharding.shuffle_into_shards(docs, 24, stable=True)
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return dealt.select(
        "doc_id", (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.document_media(_table(spark, sf_dir, "documents"))


def op3_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse_and_render(_table(spark, sf_dir, "conversations"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_table(spark, sf_dir, "documents"))
    return packed.withColumn("ids_crc32", F.crc32("ids")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_bottom_k_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(_table(spark, sf_dir, "documents"), size=4, percent=80).drop("first")


def op6_digest_cache_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a cache of this run alone, so that every run does all the work: the English
    # documents come first, as a delivery of their own, and the whole table finds them there
    cache = common.scratch_path(spark, "token-cache")
    docs = _table(spark, sf_dir, "documents")
    token_counts.fill_cache(docs.filter("lang = 'en'"), cache)
    return token_counts.token_counts(docs, cache).drop("content")


def op7_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op8_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_subsequence_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.training_sample(docs, _table(spark, sf_dir, "labels")))
    scored = toxicity.with_toxicity(docs.select("doc_id", "text"), model, "score")
    return scored.select("doc_id", common.in_fold().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_hierarchical_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.fit(language.training_sample(docs))
    told = language.with_language(docs.select("doc_id", "text"), model, "found")
    return told.select("doc_id", common.in_fold().alias("held_out"), F.col("found.lang_pred").alias("lang_pred"), F.col("found.score").alias("score"))


QUERIES = {f.__name__: f for f in (
    op1_hypergeometric_shards, op2_interleaved_media, op3_snapshot_collapse, op4_best_fit_packing, op5_bottom_k_near_dup,
    op6_digest_cache_counts, op7_url_vocabulary, op8_pigeonhole_decontamination, op9_subsequence_toxicity, op10_hierarchical_language,
)}

#: The other queries have no SQL equivalent: they are tested against brute force, a round trip or held-out labels.
ORACLES = {"op3_snapshot_collapse": chat.ORACLE, "op7_url_vocabulary": url_filter.ORACLE}
