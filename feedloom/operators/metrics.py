"""Satisfaction metrics at the response grain, and the ways a join can spoil them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _share(part: Column, whole: Column) -> Column:
    """100 * part / whole rounded to 6 places; null where whole is 0."""
    return F.round(F.lit(100.0).cast("double") * part / F.nullif(whole, F.lit(0)), 6)


def nps(score: Column, of: Column | None = None) -> Column:
    """Promoters (9 and 10) less detractors (6 and below), in percent; `of` says which rows count."""
    of = F.lit(True) if of is None else of
    return _share(F.sum(F.when(of & (score >= 9), 1).when(of & (score <= 6), -1).otherwise(0)), F.count_if(of))


def top_two(score: Column, of: Column | None = None) -> Column:
    """Scores of 4 and 5 in percent."""
    of = F.lit(True) if of is None else of
    return _share(F.count_if(of & (score >= 4)), F.count_if(of))


def summary(rows: DataFrame) -> DataFrame:
    """One row: rows, nps_responses, nps, csat_responses, csat_top2_pct, in one pass."""
    is_nps, is_csat = F.col("metric") == "NPS", F.col("metric") == "CSAT"
    return rows.agg(
        F.count("*").alias("rows"),
        F.count_if(is_nps).alias("nps_responses"), nps(F.col("score"), is_nps).alias("nps"),
        F.count_if(is_csat).alias("csat_responses"), top_two(F.col("score"), is_csat).alias("csat_top2_pct"),
    )


def with_member(responses: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """Responses that have a member row, each once (EXISTS)."""
    return responses.join(members.select(*keys), keys, "left_semi")


def by_member(responses: DataFrame, members: DataFrame, keys: list[str], label: str) -> DataFrame:
    """NPS per label over distinct membership; labels' populations may overlap."""
    joined = responses.filter("metric = 'NPS'").select(*keys, "score").join(members.select(*keys, label).distinct(), keys)
    return joined.groupBy(label).agg(F.count("*").alias("category_responses"), nps(F.col("score")).alias("category_nps"))


def fan_out(responses: DataFrame, categories: DataFrame, questions: DataFrame, keys: list[str]) -> DataFrame:
    """The join that multiplies responses: a diagnostic, never a metric's input."""
    return responses.join(categories, keys, "left").join(questions, keys, "left")


def read_reduction(available: Column, read: Column) -> tuple[Column, Column]:
    """(rows avoided, percent of the full scan avoided, 0.0 where there is nothing to scan)."""
    avoided = F.greatest(F.lit(0), available - read)
    share = F.when(available == 0, F.lit(0.0)).otherwise(F.round(F.lit(100.0).cast("double") * avoided / F.nullif(available, F.lit(0)), 1))
    return avoided, share


def output_digest(tables: dict[str, DataFrame]) -> dict[str, tuple[int, int, int]]:
    """(rows, exclusive or and sum of row hashes) of each table: equal contents, equal digests, in any order.

    The sum tells rows that occur twice, which the exclusive or doesn't.
    """
    out = {}
    for name, df in sorted(tables.items()):
        row = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))
        r = df.agg(F.count("*").alias("n"), F.bit_xor(row).alias("x"), F.sum(row.cast("decimal(38,0)")).alias("s")).first()
        out[name] = (r.n, r.x or 0, int(r.s or 0))
    return out
