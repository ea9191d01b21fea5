"""Ordered rules as one reason column; a null reason is a valid row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import CSAT_RANGE, NPS_RANGE, REQUIRED_FIELDS


def missing(df: DataFrame, name: str) -> Column:
    """Null, or the empty text; white space is present."""
    c = F.col(name)
    return c.isNull() | (c == "") if dict(df.dtypes)[name] == "string" else c.isNull()


def missing_fields(df: DataFrame, names: list[str]) -> Column:
    """The names of missing fields in the given order, or null if none is missing."""
    found = F.concat_ws(",", *(F.when(missing(df, n), F.lit(n)) for n in names))
    return F.when(found != "", found)


def first_failure(*rules: tuple[Column, str | Column]) -> Column:
    """The reason of the first condition that holds; null where none does."""
    whens = [(cond, reason if isinstance(reason, Column) else F.lit(reason)) for cond, reason in rules]
    return reduce(lambda acc, r: acc.when(*r), whens[1:], F.when(*whens[0]))


def event_reason(df: DataFrame) -> Column:
    """The flat survey event's rules: required fields, the two scores' type and range, then other fields' types.

    `wrong`, if df has it, names the fields that came with another type: they are there.
    """
    names = F.split(F.coalesce(F.col("wrong"), F.lit("")), ",") if "wrong" in df.columns else F.array().cast("array<string>")
    wrong = lambda name: F.array_contains(names, name)
    lacking = F.concat_ws(",", *(F.when(missing(df, n) & ~wrong(n), F.lit(n)) for n in REQUIRED_FIELDS))
    others = [n for n in REQUIRED_FIELDS if n not in ("nps_score", "csat_score")]
    return first_failure(
        (lacking != "", F.concat(F.lit("missing:"), lacking)),
        (wrong("nps_score") | ~F.col("nps_score").between(*NPS_RANGE), "invalid_nps_score"),
        (wrong("csat_score") | ~F.col("csat_score").between(*CSAT_RANGE), "invalid_csat_score"),
        *((wrong(n), f"invalid_{n}") for n in others),
    )


def split_by_reason(df: DataFrame, reason: Column, column: str = "reason") -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their reason): two filters over one assessed frame."""
    assessed = df.withColumn(column, reason)
    return assessed.filter(F.col(column).isNull()).drop(column), assessed.filter(F.col(column).isNotNull())
