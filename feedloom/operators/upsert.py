"""Merges without a table format: every result is a new snapshot of the target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .versions import latest


def newer_wins(target: DataFrame, batch: DataFrame, key: str, clock: str) -> DataFrame:
    """The target with the batch's new keys, and its rows where their clock is strictly later.

    The batch has one row per key. On equal clocks the target's row stays. One shuffle:
    both sides are ranked together, nothing is joined.
    """
    both = target.withColumn("_held", F.lit(1)).unionByName(batch.select(*target.columns).withColumn("_held", F.lit(0)))
    return latest(both, [key], [F.desc_nulls_last(clock), F.desc("_held")]).drop("_held")


def upsert_statistics(target: DataFrame, batch: DataFrame, key: str, clock: str) -> DataFrame:
    """One row (inserted, updated, replayed_or_unchanged); to be read before the write."""
    held = target.select(F.col(key).alias("_key"), F.col(clock).alias("_clock"))
    joined = batch.select(key, clock).join(held, F.col(key) == F.col("_key"), "left")
    new = F.col("_key").isNull()
    later = ~new & (F.col(clock) > F.col("_clock"))
    return joined.agg(
        F.count_if(new).alias("inserted"),
        F.count_if(later).alias("updated"),
        (F.count("*") - F.count_if(new) - F.count_if(F.coalesce(later, F.lit(False)))).alias("replayed_or_unchanged"),
    )


def absent(batch: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """The batch's rows whose key the target lacks: what an insert-only merge appends."""
    return batch.join(target.select(*keys), keys, "left_anti")


def collisions(batch: DataFrame, target: DataFrame, key: str, content: str) -> DataFrame:
    """Keys that the target holds with other content: such a batch must not be merged."""
    held = target.select(F.col(key).alias("_key"), F.col(content).alias("_content"))
    return batch.join(held, F.col(key) == F.col("_key")).filter(~F.col(content).eqNullSafe(F.col("_content"))).select(key).distinct()


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().filter("count > 1")


def orphans(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Child rows without a parent; empty where a foreign key holds."""
    return child.join(parent.select(*keys), keys, "left_anti")


def assert_empty(df: DataFrame, what: str) -> None:
    if not df.isEmpty():
        raise ValueError(what)
