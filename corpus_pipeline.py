"""A training corpus from documents: filter, deduplicate, decontaminate and pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the result is written
and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import common, decontaminate, language, near_dup, packing, toxicity

#: A text is kept if its language is known with at least this probability.
LEAST_LANGUAGE_SCORE = 0.1
#: And if its trigrams are less strange than this to every learned language.
MOST_STRANGE = 0.25


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of 0.5 or more go.

    Null and empty texts stay. Equal texts share their fate; repeated rows stay as they
    are. An empty table stays empty. Columns of any name stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(toxicity.training_sample(docs, labels))
    (name,) = common.unused(docs.columns, "toxicity")
    return toxicity.with_toxicity(docs, model, name).filter(F.col(name) < 0.5).drop(name)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no language that the labelled rows teach, go.

    Null and empty texts go with them, and all if there is nothing to learn from. Equal
    texts share their fate; repeated rows stay as they are. An empty table stays empty.
    Columns of any name stay.
    """
    model = language.fit(language.training_sample(docs))
    (name,) = common.unused(docs.columns, "language")
    known = (F.col(f"{name}.lang_pred") != language.UNKNOWN) & (F.col(f"{name}.score") >= LEAST_LANGUAGE_SCORE) & (F.col(f"{name}.strange") < MOST_STRANGE)
    return language.with_language(docs, model, name).filter(known).drop(name)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: five-word shingles, similarity 0.8.

    It is the one with the least doc_id; of rows that repeat doc_id and text one stays.
    Texts without words are duplicates of nothing. An empty table stays empty. Columns
    of any name stay.
    """
    return near_dup.deduplicate(docs, size=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts stay; equal texts share their fate; repeated rows stay as they
    are. An empty table, or an empty benchmark, changes nothing. Columns of any name stay.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    (name,) = common.unused(docs.columns, "leak")
    return decontaminate.flag(docs, benchmark, name).filter(~F.col(name)).drop(name)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: a row per piece.

    A null or empty text is one token; rows that repeat a doc_id are documents of their
    own. An empty table gives no rows. Further columns are ignored.
    """
    packed = packing.pack(docs)
    return packed.withColumn("ids_crc32", F.crc32("ids")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("near_dup", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Kernels, sketches and packing have no SQL equivalent.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.scratch(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
