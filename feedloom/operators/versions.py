"""Versions of a key: the latest one, copies, conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, keys: list[str], order: list[Column], column: str = "rank") -> DataFrame:
    """df with each row's place among its key's rows; give an order without ties."""
    return df.withColumn(column, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return ranked(df, keys, order, "_rank").filter("_rank = 1").drop("_rank")


def varies(value: Column, *keys: str) -> Column:
    """Whether a key's rows hold more than one value: no self-join, no distinct count."""
    w = Window.partitionBy(*keys)
    return F.min(value).over(w) != F.max(value).over(w)


def conflicting_keys(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with more than one distinct value, by an aggregate that combines before it shuffles."""
    found = df.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    return found.filter("_low <> _high").select(*keys)
