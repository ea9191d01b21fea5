"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import common


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Sizes that differ by one at most, the larger ones first."""
    return np.full(shards, rows // shards) + (np.arange(shards) < rows % shards)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of `drawn` out of good + bad things are good, for numbers of any size.

    Ratio of uniforms around the mode: the pair (u, v) is accepted if u**2 is below the
    probability of its quotient, relative to the mode's.
    """
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    total = good + bad
    chance = lambda k: -sum(map(math.lgamma, (k + 1, good - k + 1, drawn - k + 1, bad - drawn + k + 1)))
    top = chance(min(high, max(low, (drawn + 1) * (good + 1) // (total + 2))))
    mean = drawn * (good / total)
    spread = math.sqrt(mean * (bad / total) * ((total - drawn) / max(1, total - 1)) + 0.5)
    # the hat's width after Stadlober: 2 sqrt(2 / e) deviations and 3 - 2 sqrt(3 / e)
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    while True:
        u, v = 1.0 - rng.random(), rng.random()
        k = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if low <= k <= high and 2 * math.log(u) <= chance(k) - top:
            return k


def matrix_row(before: np.ndarray, received: np.ndarray, seed: int, partition: int) -> np.ndarray:
    """How many of a partition's rows go to each shard; before[p] counts the rows in front of partition p.

    The rows of the matrix together have the law of a uniform permutation's counts. The
    partitions are halved again and again: at each cut the places of all of them are dealt
    to the two halves by the multivariate hypergeometric law, from a seed of the cut. So
    any task finds its row by as many cuts as the number of partitions has binary digits.
    """
    low, high, node = 0, len(before) - 1, 1
    places = [int(n) for n in received]
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.default_rng([seed, 1, node])
        need, rest, left = int(before[middle] - before[low]), sum(places), []
        for n in places:
            rest -= n
            took = hypergeometric(rng, n, rest, need)
            need -= took
            left.append(took)
        if partition < middle:
            high, node, places = middle, 2 * node, left
        else:
            low, node, places = middle, 2 * node + 1, [n - k for n, k in zip(places, left, strict=True)]
    return np.array(places, np.int64)


def communication_matrix(sent: list[int], received: np.ndarray, seed: int) -> np.ndarray:
    """All partitions' rows, for tests and reports: row p, column s counts what p sends to s."""
    before = np.concatenate(([0], np.cumsum(sent, dtype=np.int64)))
    return np.array([matrix_row(before, received, seed, p) for p in range(len(sent))])


def _labels(counts: np.ndarray, buckets: np.ndarray, partition: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, bucket, key) of a partition's rows in their order: its local permutation."""
    rng = np.random.default_rng([seed, 2, partition])
    shard = rng.permutation(np.repeat(np.arange(len(counts), dtype=np.int32), counts))
    bucket = rng.integers(0, buckets[shard]).astype(np.int32)
    return shard, bucket, rng.integers(0, 1 << 62, len(shard))


def _deal(arrays: Iterator[pa.Array], before: np.ndarray, sizes: np.ndarray, buckets: np.ndarray, seed: int) -> Iterator[pa.Array]:
    partition = TaskContext.get().partitionId()
    rows = int(before[partition + 1] - before[partition]) if partition < len(before) - 1 else 0
    counts = matrix_row(before, sizes, seed, partition) if rows else np.zeros(len(sizes), np.int64)
    shard, bucket, key = _labels(counts, buckets, partition, seed)
    low = 0
    for array in arrays:
        high = low + len(array)
        if high > len(shard):
            raise RuntimeError(f"partition {partition} has more rows than were counted: write the input to a table first")
        yield pa.StructArray.from_arrays([pa.array(shard[low:high]), pa.array(bucket[low:high]), pa.array(key[low:high])], ["shard", "bucket", "key"])
        low = high
    if low != len(shard):
        raise RuntimeError(f"partition {partition} has {low} rows, not {len(shard)}: write the input to a table first")


def _count_buckets(batches: Iterator[pa.RecordBatch], before: np.ndarray, sizes: np.ndarray, buckets: np.ndarray, seed: int) -> Iterator[pa.RecordBatch]:
    base = np.concatenate(([0], np.cumsum(buckets)))
    total = np.zeros(base[-1], np.int64)
    for batch in batches:
        for p in batch.column(0).to_pylist():
            shard, bucket, _ = _labels(matrix_row(before, sizes, seed, p), buckets, p, seed)
            total += np.bincount(base[shard] + bucket, minlength=len(total))
    used = np.flatnonzero(total)
    shard = np.searchsorted(base, used, side="right") - 1
    yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array((used - base[shard]).astype(np.int32)), pa.array(total[used])], ["shard", "bucket", "n"])


def _bytes(df: DataFrame) -> Column:
    """About how many bytes a row has: its texts' and 8 for any other column."""
    long = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary")]
    return sum(long, F.lit(8 * len(df.columns))).cast("long")


def shuffle_into_shards(df: DataFrame, shards: int, seed: int = 20240601, bucket_rows: int = 16384, bucket_bytes: int = 1 << 26, stable: bool = False) -> DataFrame:
    """df's rows with `shard` (0 to shards - 1) and `slot` (gapless from 0 in each shard).

    The order (shard, slot) is a uniform random permutation of all rows, decided by
    seed and the input's partitions; shard sizes differ by one row at most. Values
    play no part: nulls, ties, repeated rows, empty and very long texts are rows like
    others. An empty table gives an empty result. Existing columns named shard or slot
    are replaced; columns of any other name stay.

    1. Count the rows and bytes of each partition (two numbers each come to the driver).
    2. The partition-to-shard counts: every task draws its own row of the matrix from the
       partitions' counts, one number each.
    3. Each partition permutes its labels locally; only a key column goes through Python.
    4. One exchange, by (shard, bucket): a shard is spread over buckets of about
       bucket_rows rows, or bucket_bytes if rows are long, so a task's size doesn't
       depend on the input's.
    5. Each bucket is permuted by random keys. Where a bucket starts is known from the
       labels alone, without reading the rows again.

    A lost executor's rows are recomputed from seed and partition, with the same
    labels. For that the input must have the same rows in the same partitions whenever
    it is read: it is written to the shared folder first unless the caller says that it
    is `stable`, as the scan of a stored table is.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    if not stable:
        df = common.scratch(df, "input")
    counted = df.select(_bytes(df).alias("size")).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()
    sent = {r.p: r.n for r in counted}
    rows = [sent.get(p, 0) for p in range(max(sent, default=-1) + 1)]
    before = np.concatenate(([0], np.cumsum(rows, dtype=np.int64)))
    total, size = int(before[-1]), sum(r["size"] for r in counted)
    sizes = shard_sizes(total, shards)
    many = max(1, min(bucket_rows, bucket_bytes * total // max(1, size)))
    buckets = np.maximum(1, -(-sizes // many))

    deal = partial(_deal, before=before, sizes=sizes, buckets=buckets, seed=seed)

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return deal(arrays)

    run.__annotations__ = {"arrays": Iterator[pa.Array], "return": Iterator[pa.Array]}
    label, bucket, key, place, part, at, start = common.unused([*df.columns, "shard", "slot"], "label", "bucket", "key", "place", "part", "at", "start")
    dealt = df.withColumn(label, arrow_udf(run, "shard int, bucket int, key long").asNondeterministic()(F.lit(1)))
    parts = spark.createDataFrame([(p,) for p in sent], "p int").repartition(max(1, min(len(sent), spark.sparkContext.defaultParallelism)))
    found = parts.mapInArrow(partial(_count_buckets, before=before, sizes=sizes, buckets=buckets, seed=seed), "shard int, bucket int, n long")
    found = found.groupBy("shard", "bucket").agg(F.sum("n").alias("n"))
    # one row per bucket: the size is bounded by rows / bucket_rows + shards
    starts = found.select(F.col("shard").alias(part), F.col("bucket").alias(at), (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias(start))
    starts = common.scratch(starts, "starts")
    if buckets.sum() <= 200_000:
        starts = F.broadcast(starts)
    columns = [F.col(f"`{c}`") for c in df.columns]
    dealt = dealt.select(*columns, F.col(f"{label}.shard").alias("shard"), F.col(f"{label}.bucket").alias(bucket), F.col(f"{label}.key").alias(key))
    placed = dealt.withColumn(place, F.row_number().over(Window.partitionBy("shard", bucket).orderBy(key)) - 1)
    told = placed.join(starts, (F.col("shard") == F.col(part)) & (F.col(bucket) == F.col(at)))
    return told.select(*columns, "shard", (F.col(start) + F.col(place)).cast("long").alias("slot"))
