"""Token counts through a digest cache: every distinct content is encoded once, ever."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import PieceUnits, file_digest, load, tokenizer_path

CACHE = "content string, tokenizer string, n_tokens long"


def content_digest(text: str = "text"):
    """SHA-256 of the normalised content; null counts as the empty text.

    Normalisation may not change a count, so it is exactly that and nothing more.
    """
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


@common.tidily
def _count(batches: Iterator[pa.RecordBatch], path: str, version: str) -> Iterator[pa.RecordBatch]:
    """Counts of the (content, text) rows of a task, each content once."""
    units, told = load(PieceUnits, path), set()
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            part = batch.slice(low, 256)
            fresh = {c: i for i, c in enumerate(part.column(0).to_pylist()) if c not in told}
            if fresh:
                told.update(fresh)
                n = units.counts(part.column(1).take(pa.array(list(fresh.values()))).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(list(fresh)), pa.array([version] * len(n)), pa.array(n, pa.int64())], ["content", "tokenizer", "n_tokens"])


BITS = 1 << 26  # of a bitmap: 8 MB, whatever the table's size
_PAGE = 1 << 15  # bits of a row of it; fixed by bitmap_construct_agg


def bitmap(contents: DataFrame, name: str) -> DataFrame:
    """Which hashes the contents have, as rows (page, bits) of 4 KB; at most BITS / _PAGE of them."""
    h = contents.select(F.pmod(F.xxhash64("content"), F.lit(BITS)).alias("h"))
    return h.groupBy(F.floor(F.col("h") / _PAGE).alias("page")).agg(F.bitmap_construct_agg((F.col("h") % _PAGE).cast("long")).alias(name))


def _bit(bits: Column, h: Column) -> Column:
    place = F.pmod(h, F.lit(_PAGE))
    byte = F.conv(F.hex(F.substring(bits, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) != 0, F.lit(False))


def with_bits(rows: DataFrame, maps: list[DataFrame]) -> DataFrame:
    """rows(content, ...) with a boolean column per bitmap: whether the content's hash is in it."""
    h = F.pmod(F.xxhash64("content"), F.lit(BITS))
    rows = rows.withColumn("page", F.floor(h / _PAGE))
    for m in maps:
        name = m.columns[1]
        rows = rows.join(F.broadcast(m), "page", "left").withColumn(name, _bit(F.col(name), h))
    return rows.drop("page")


def read_cache(spark, path: str) -> DataFrame:
    """The cache table, empty where nothing has been written yet."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(CACHE).parquet(path) if there else spark.createDataFrame([], CACHE)


def misses_of(seen: DataFrame, known: DataFrame) -> DataFrame:
    """(content, several) of the contents that the cache lacks; `several` tells whether several partitions have it."""
    held = seen.groupBy("content").agg((F.min("part") < F.max("part")).alias("several"))
    return held.join(known.select("content"), "content", "left_anti")


def fill_cache(docs: DataFrame, cache_path: str, tokenizer: str = "piece_bpe_32k.model") -> DataFrame:
    """Append the counts of the contents that the cache lacks; returns (doc_id, content, n_bytes, part) of every row."""
    spark = docs.sparkSession
    path = tokenizer_path(tokenizer)
    version = file_digest(path)
    seen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), content_digest().alias("content"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    seen = common.scratch(seen.withColumn("part", F.spark_partition_id()), "digests")
    known = read_cache(spark, cache_path).filter(F.col("tokenizer") == version)
    misses = common.scratch(misses_of(seen, known), "misses")
    if not misses.isEmpty():
        held = seen.select("content").join(known.select("content"), "content", "left_semi")
        elsewhere = common.scratch(bitmap(misses.filter("several").select("content").unionByName(held), "elsewhere"), "bitmap")
        # all misses that the first bitmap keeps from being encoded in place, those with another's hash among them
        wanted = common.scratch(bitmap(with_bits(misses, [elsewhere]).filter("elsewhere").select("content"), "wanted"), "bitmap")
        rows = docs.select(content_digest().alias("content"), F.coalesce("text", F.lit("")).alias("text"))
        rows = with_bits(rows, [elsewhere, wanted])
        moved = rows.filter("elsewhere and wanted").groupBy("content").agg(F.first("text").alias("text")).join(misses.select("content"), "content", "left_semi")
        fresh = _encoded(rows.filter("not elsewhere"), path, version).unionByName(_encoded(moved, path, version))
        fresh.write.mode("append").option("compression", "zstd").parquet(cache_path)
    return seen


def token_counts(docs: DataFrame, cache_path: str, tokenizer: str = "piece_bpe_32k.model", limit: int = 4096) -> DataFrame:
    """Token counts of the whole texts of documents(doc_id, text, ...).

    Contents whose digest and tokenizer version the cache table at cache_path has
    are not encoded; of the others each distinct one is encoded once and its count
    appended. Returns per row: doc_id, content (digest), n_bytes (UTF-8), n_tokens,
    over_limit (n_tokens > limit). Null and empty texts have 0 of both. Rows that
    repeat a doc_id or a text get a row each; very long texts count whole. An empty
    table gives an empty result. Further columns are ignored.

    A missing content that one partition alone has is encoded where it is read. Only
    texts that several partitions have travel, one of each partition. Rows learn which
    they are from two bitmaps of fixed size: a hash in common sends a text on its way
    that needn't, or is sorted out by an exact join; it never changes a result. Input
    whose rows change partitions from read to read may have a text encoded once more.

    One writer at a time; a run that ended early leaves at most rows that are right,
    and repeated rows in the cache (two runs at once) don't multiply results.
    """
    spark = docs.sparkSession
    seen = fill_cache(docs, cache_path, tokenizer)
    version = file_digest(tokenizer_path(tokenizer))
    counts = read_cache(spark, cache_path).filter(F.col("tokenizer") == version).groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))
    counts = common.scratch(counts, "counts")
    return seen.join(counts, "content").select("doc_id", "content", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _encoded(rows: DataFrame, path: str, version: str) -> DataFrame:
    return rows.select("content", "text").mapInArrow(partial(_count, path=path, version=version), CACHE)
