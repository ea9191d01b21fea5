"""What several operators share: scratch tables, bounded reads, components."""

from __future__ import annotations

import ctypes
import ctypes.util
import functools
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Where it is unset in a local session (in tests) a folder beside the warehouse is
    set and used; a cluster must name its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/feedloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def scratch(df: DataFrame, label: str, tasks: int | None = None) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives executors.

    At most `tasks` files are written, for tables that are known to be small for their plan.
    """
    df = df if tasks is None else df.coalesce(tasks)
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables; call it when results are stored."""
    path = f"{shared_folder(spark)}/feedloom/{spark.sparkContext.applicationId}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def unused(columns: list[str], *stems: str) -> list[str]:
    """Names like the stems that none of the columns has, in any case."""
    held, out = {c.lower() for c in columns}, []
    for stem in stems:
        name = stem
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def in_rows(array: pa.Array, rows: int = 256) -> Iterator[list]:
    """An Arrow column as Python lists of a few rows at a time."""
    for low in range(0, len(array), rows):
        yield array.slice(low, rows).to_pylist()


def tidily(work: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """For generators that run as tasks: freed memory goes back to the system when one ends.

    Python workers live on and are lent to other tasks; what they keep counts against
    the executor.
    """

    @functools.wraps(work)
    def run(*args, **named) -> Iterator:
        try:
            yield from work(*args, **named)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(ctypes.util.find_library("c")), "malloc_trim", None):
                trim(0)

    return run


def in_fold(doc_id: str = "doc_id") -> Column:
    """True for rows held out of every fit: crc32(doc_id as text) mod 5 is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


CHUNK = 1 << 18  # edges that a task contracts together


def _contract(batches: Iterator[pa.RecordBatch], limit: int = 2 * CHUNK) -> Iterator[pa.RecordBatch]:
    """Edges with the same components, each from a node to the least one that its chunk connects it to."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while parent.get(x, x) != top:
            parent[x], x = top, parent[x]
        return top

    def told() -> pa.RecordBatch:
        ends = [(x, find(x)) for x in parent]
        ends = [(x, r) for x, r in ends if x != r]
        parent.clear()
        a, b = zip(*ends, strict=True) if ends else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                low, high = (x, y) if x < y else (y, x)
                parent[high] = low
                parent.setdefault(low, low)
        if len(parent) >= limit:
            yield told()
    if parent:
        yield told()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge at most to a root, and no root has one."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("root")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("root").alias("root")).filter("up > 1 or (up = 1 and root = 1)").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge list as (node, root), root the least node id.

    Chunks of edges are contracted within tasks first; then large-star and small-star
    steps alternate until all edges lead to roots. Each step is a few shuffles of the
    edges, the state is a written table, and the number of steps is logarithmic in
    practice. Nodes without an edge are not returned. Null ends and loops are ignored.
    """
    now = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b").distinct()
    now = scratch(now, "edges")
    tasks = -(-now.count() // CHUNK) or 1
    now = scratch(now.coalesce(tasks).mapInArrow(_contract, "a long, b long"), "edges")
    for _ in range(max_rounds):
        if tasks == 1 or _settled(now):  # one chunk has been contracted whole
            break
        both = now.select("a", "b").union(now.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        # small star: every node's smaller neighbours and itself go to the least of them
        low = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = low.groupBy("a").agg(F.min("b").alias("m"))
        small = low.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        now = scratch(small.filter("a <> b").distinct().mapInArrow(_contract, "a long, b long"), "edges")
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root"), F.col("root")).distinct())
