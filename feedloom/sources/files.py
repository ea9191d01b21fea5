"""JSON lines and CSV files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.children import json_form
from ..schemas import EVENT_FIELDS, RECEIPT


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines with a declared schema; a malformed line fails the job, or else lands in _corrupt_record.

    Blank lines are skipped.
    """
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(schema + ", _corrupt_record string").json(path)


def read_receipts(spark: SparkSession, path: str, batch: str = "all") -> DataFrame:
    """Delivered receipts, their payload as the JSON text that was delivered; one batch or all."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    envelope = F.from_json("value", RECEIPT, {"mode": "FAILFAST"})
    # the payload as it was delivered: SQL's own JSON text would turn NaN into a text
    got = lines.select(envelope.alias("r"), json_form(F.col("value"), "payload").alias("payload")).select("r.*", F.col("payload").alias("_text"))
    got = got.withColumn("payload", F.col("_text")).drop("_text")
    return got if batch == "all" else got.filter(F.col("batch_id") == batch)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """mode: "ignore" keeps what is there, "overwrite" rebuilds it."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_gold_csv(df: DataFrame, path: str) -> None:
    """The ten event columns with a header, sorted by response_id, one file."""
    df.select(*EVENT_FIELDS).orderBy("response_id").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text file in any file system that Spark reaches."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        stream.write(text.encode())
    finally:
        stream.close()


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """A report as indented JSON with sorted names."""
    write_text(spark, json.dumps(report, indent=2, ensure_ascii=False, sort_keys=True) + "\n", path)
