"""Tables as immutable Parquet snapshots behind one pointer file.

A commit writes below a new folder and then renames a pointer: readers see all of the old
tables or all of the new ones. A table that is merged into lies in buckets of its key, and
a commit writes only those that its rows touch. Folders that neither the current nor the
last KEPT snapshots name are deleted. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.upsert import absent, assert_empty, collisions


BUCKETS = 64
#: What the loads and deliveries write at the top of their folder.
GROUPS = ("responses", "comparison", "survey")
OWN = {*GROUPS, *(f"{g}.json" for g in GROUPS), "bronze", "quarantine", "receipts", "normalized"}
KEPT = 3  # snapshots before the current one, for readers that still hold them


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._options = jvm.org.apache.hadoop.fs.FileContext
        self._jvm = jvm

    def _read(self, name: str) -> dict | None:
        where = self._path(f"{self.root}/{name}")
        if not self._fs.exists(where):
            return None
        stream = self._fs.open(where)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _point(self, name: str, content: dict) -> None:
        """Write beside, then rename over: the pointer is never half written."""
        draft, final = self._path(f"{self.root}/.{name}-{uuid.uuid4().hex}"), self._path(f"{self.root}/{name}")
        stream = self._fs.create(draft, True)
        try:
            stream.write(json.dumps(content, sort_keys=True).encode())
        finally:
            stream.close()
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        context = self._options.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        context.rename(draft, final, how)

    def _commit(self, group: str, paths: dict[str, dict[str, str]], facts: dict) -> dict:
        """Point to the tables' parts (bucket -> folder), then delete what no snapshot that is kept names."""
        old = self._read(f"{group}.json") or {}
        before = [*old.get("before", []), *([old["paths"]] if old else [])]
        drop, keep = before[:-KEPT], before[-KEPT:]
        content = {"tables": sorted(paths), "paths": paths, "facts": facts, "before": keep}
        self._point(f"{group}.json", content)
        folders = lambda held: {p for t in held for parts in t.values() for p in parts.values()}
        for path in folders(drop) - folders([paths, *keep]):
            self._fs.delete(self._path(f"{self.root}/{path}"), True)
        return content

    def replace(self, group: str, tables: dict[str, DataFrame], **facts) -> dict:
        """Commit all tables of a group, whole, and the facts about them as its current snapshot."""
        snapshot, paths = uuid.uuid4().hex, {}
        for name, df in tables.items():
            paths[name] = {"all": f"{group}/{snapshot}/{name}"}
            df.write.option("compression", "zstd").parquet(f"{self.root}/{paths[name]['all']}")
        return self._commit(group, paths, facts)

    def merge(self, group: str, name: str, batch: DataFrame, key: str, how: Callable[[DataFrame, DataFrame], DataFrame], schema: str, **facts) -> dict:
        """Commit a table of a group with how(held rows, batch) in the buckets that the batch's keys touch.

        Other buckets and other tables of the group stay as they are; at most BUCKETS
        numbers come to the driver.
        """
        old = (self._read(f"{group}.json") or {}).get("paths", {})
        parts = dict(old.get(name, {}))
        bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
        if "all" in parts:  # written whole before: now in buckets
            touched = list(range(BUCKETS))
        else:
            touched = sorted(r.b for r in batch.select(bucket.alias("b")).distinct().collect())
        reads = [f"{self.root}/{parts[str(b)]}" for b in ("all", *touched) if str(b) in parts]
        held = self.spark.read.schema(schema).parquet(*reads) if reads else self.spark.createDataFrame([], schema)
        if touched:
            folder = f"{group}/{uuid.uuid4().hex}/{name}"
            merged = how(held, batch).withColumn("_bucket", bucket).repartition(len(touched), "_bucket")
            merged.write.partitionBy("_bucket").option("compression", "zstd").parquet(f"{self.root}/{folder}")
            written = {str(b) for b in touched if self._fs.exists(self._path(f"{self.root}/{folder}/_bucket={b}"))}
            parts = {b: p for b, p in parts.items() if b != "all" and b not in map(str, touched)} | {b: f"{folder}/_bucket={b}" for b in written}
        return self._commit(group, old | {name: parts}, facts)

    def facts(self, group: str) -> dict:
        return (self._read(f"{group}.json") or {}).get("facts", {})

    def table(self, group: str, name: str, schema=None) -> DataFrame | None:
        """A table of the current snapshot; without one an empty frame of the schema, or None."""
        parts = (self._read(f"{group}.json") or {}).get("paths", {}).get(name)
        if not parts:
            return None if schema is None else self.spark.createDataFrame([], schema)
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(*(f"{self.root}/{p}" for _, p in sorted(parts.items())))

    def append(self, name: str, df: DataFrame, part: str, value: str, **lineage: str) -> None:
        """Write a part of a raw history, with constant lineage columns; the same part again is written over.

        The history is partitioned by the part's column, so a filter on it reads no other part.
        """
        df = df.withColumns({k: F.lit(v) for k, v in lineage.items()})
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{name}/{part}={value}")

    def history(self, name: str, schema) -> DataFrame:
        there = self._fs.exists(self._path(f"{self.root}/{name}"))
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}") if there else self.spark.createDataFrame([], schema)

    def retain(self, name: str, batch: DataFrame, key: str, content: str, schema, part: tuple[str, ...] = ()) -> None:
        """Insert-only: new keys are appended, known ones must have the same content, else nothing is written."""
        held = self.history(name, schema)
        assert_empty(collisions(batch, held, key, content), f"{key}_collision: immutable delivery changed")
        # a batch may deliver one receipt several times, but not with two contents
        assert_empty(batch.groupBy(key).agg(F.count_distinct(content).alias("n")).filter("n > 1"), f"{key}_collision: immutable delivery changed")
        fresh = absent(batch.dropDuplicates([key]), held, [key])
        fresh.write.mode("append").partitionBy(*part).option("compression", "zstd").parquet(f"{self.root}/{name}")

    def register(self, group: str, prefix: str = "") -> None:
        """The current snapshot's tables as views for SQL."""
        for name in (self._read(f"{group}.json") or {"tables": []})["tables"]:
            self.table(group, name).createOrReplaceTempView(prefix + name)

    def is_own(self) -> bool:
        """Whether the folder holds nothing, or no more than a store's pointers and folders."""
        where = self._path(self.root)
        names = [x.getPath().getName() for x in self._fs.listStatus(where)] if self._fs.exists(where) else []
        return all(n in OWN or n.startswith(".") and n.split(".")[1] in OWN for n in names)

    def reset(self) -> None:
        self._fs.delete(self._path(self.root), True)


def bundle(tables: dict[str, DataFrame]) -> DataFrame:
    """Differently shaped tables as one: (dataset, row_json), nulls kept."""
    out = None
    for name, df in tables.items():
        part = df.select(F.lit(name).alias("dataset"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row_json"))
        out = part if out is None else out.unionByName(part)
    return out


def unbundle(rows: DataFrame, dataset: str, schema) -> DataFrame:
    return rows.filter(F.col("dataset") == dataset).select(F.from_json("row_json", schema).alias("r")).select("r.*")
