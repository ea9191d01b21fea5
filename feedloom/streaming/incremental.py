"""Repeated loads with a high watermark, an overlap and commits that come last."""

from __future__ import annotations

import time
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import iso_seconds
from ..operators.upsert import newer_wins, upsert_statistics
from ..operators.validation import event_reason, split_by_reason
from ..operators.versions import latest
from ..schemas import EVENT, EVENT_FIELDS
from ..sources import files, paged
from ..sources.store import Store

BRONZE = paged.SCHEMA + ", source_entity string, ingested_at string, run_id string"
QUARANTINE = "reason string, record string, run_id string"
OVERLAP_MINUTES = 5


def latest_valid(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(latest valid version per response, rejected rows with reasons).

    Latest is by update time, then version; of full ties the first that arrived.
    """
    valid, rejected = split_by_reason(events, event_reason(events))
    order = [F.desc("updated_at"), F.desc("event_version"), F.asc("page"), F.asc("place")]
    return latest(valid, ["response_id"], order), rejected


def run_id(now: datetime | None = None) -> str:
    return (now or datetime.now(UTC)).strftime("%Y%m%dT%H%M%S%fZ")


def mode_of(watermark: str | None) -> str:
    return "full" if watermark is None else "incremental"


def overlap(watermark: str | None, minutes: int = OVERLAP_MINUTES) -> str | None:
    """The watermark's whole second less the overlap."""
    if watermark is None:
        return None
    return paged.iso(datetime.fromtimestamp(paged.instant(watermark).timestamp() - 60 * minutes, UTC))


def load(store: Store, url: str, token: str, as_of: str, page_size: int = 250) -> dict:
    """One run: extract, keep, validate, upsert, publish, and only then move the watermark.

    An empty extraction runs through and leaves the watermark. Rejected rows move it
    too: it is a cursor over what was read, no promise about event time.
    """
    spark, began, run = store.spark, time.perf_counter(), run_id()
    paged.register(spark)
    previous = store.facts("responses").get("watermark")
    since = overlap(previous)
    reader = spark.read.format("paged_responses").options(url=url, token=token, as_of=as_of, page_size=page_size)
    extracted = (reader.option("updated_since", since) if since else reader).load()
    told = apply(store, extracted, run, as_of=as_of)
    everything = paged.available(url, token, as_of)
    read = told["extracted_rows"]
    avoided = max(0, everything - read)
    report = {
        "run_id": run, "mode": mode_of(previous), "as_of": as_of, "full_scan_rows_at_cutoff": everything, "extracted_rows": read,
        "rows_avoided_vs_full_scan": avoided, "read_reduction_pct": round(100 * avoided / everything, 1) if everything else 0.0,
        "pages_requested": max(1, -(-read // page_size)), "previous_watermark": previous, "query_watermark": since, **told,
    }
    report["elapsed_seconds"] = round(time.perf_counter() - began, 3)
    record(store, report)
    return report


def apply(store: Store, extracted: DataFrame, run: str, **facts) -> dict:
    """Keep, validate, upsert and publish one extraction under the name of its run; returns the counts.

    Raw and rejected rows are kept in a part of their own, which a replayed run writes
    over. The pointer's rename publishes the table and the watermark together, last.
    """
    store.append("bronze", extracted, "run_id", run, source_entity="responses", ingested_at=paged.iso(datetime.now(UTC)))
    batch = store.history("bronze", BRONZE).filter(F.col("run_id") == run).cache()
    previous = store.facts("responses").get("watermark")
    try:
        top = batch.agg(F.count("*").alias("n"), iso_seconds(F.max("updated_at")).alias("top")).first()
        resolved, rejected = latest_valid(batch)
        resolved = resolved.select(*EVENT_FIELDS).cache()
        store.append("quarantine", rejected.select("reason", F.to_json(F.struct(*EVENT_FIELDS, "wrong"), {"ignoreNullFields": "false"}).alias("record")), "run_id", run)
        target = store.table("responses", "fact_response", EVENT)
        upserted = upsert_statistics(target, resolved, "response_id", "updated_at").first().asDict()
        valid, bad = resolved.count(), rejected.count()
        watermark = max(filter(None, (top.top, previous)), default=None)
        merge = lambda held, new: newer_wins(held, new, "response_id", "updated_at")
        store.merge("responses", "fact_response", resolved, "response_id", merge, EVENT, watermark=watermark, run_id=run, **facts)
        analytical = store.table("responses", "fact_response", EVENT).count()
        resolved.unpersist()
    finally:
        batch.unpersist()
    return {
        "extracted_rows": top.n, "committed_watermark": watermark,
        "validation": {"valid_latest_rows_in_batch": valid, "superseded_or_replayed_rows_in_batch": top.n - valid - bad, "quarantined_rows": bad},
        "upsert": upserted, "analytical_rows": analytical,
    }


COMPARISON = "mode string, as_of string, full_scan_rows_at_cutoff long, extracted_rows long, rows_avoided_vs_full_scan long, read_reduction_pct double, analytical_rows long, run_id string"


def record(store: Store, report: dict) -> None:
    """The comparison table has one row per (mode, cutoff); the last run's counts."""
    names = [x.split()[0] for x in COMPARISON.split(", ")]
    new = store.spark.createDataFrame([tuple(report[n] for n in names)], COMPARISON)
    held = store.table("comparison", "runs", COMPARISON)
    kept = held.join(new.select("mode", "as_of"), ["mode", "as_of"], "left_anti").select(*names)
    store.replace("comparison", {"runs": kept.unionByName(new).coalesce(1)})


def save_reports(store: Store, report: dict, root: str) -> None:
    """One run's report as JSON and as a table, and the comparison of all runs as a table."""
    lines = [[name, value] for name, value in report.items() if not isinstance(value, dict)]
    lines += [[f"{group}.{name}", value] for group, held in report.items() if isinstance(held, dict) for name, value in held.items()]
    stem = f"{root}/{report['mode']}_{report['as_of'][:10]}"
    files.write_report(store.spark, report, f"{stem}.json")
    files.write_text(store.spark, text_table(["metric", "value"], lines) + "\n", f"{stem}.txt")
    runs = store.table("comparison", "runs").orderBy("as_of", "mode")
    files.write_text(store.spark, text_table(runs.columns, [list(r) for r in runs.collect()]) + "\n", f"{root}/load_comparison.txt")


def text_table(headers: list[str], rows: list[list]) -> str:
    """A small table as aligned text."""
    cells = [[str(c) for c in row] for row in [headers, *rows]]
    widths = [max(map(len, column)) for column in zip(*cells, strict=True)]
    lines = [" | ".join(c.ljust(w) for c, w in zip(row, widths, strict=True)) for row in cells]
    return "\n".join([lines[0], "-+-".join("-" * w for w in widths), *lines[1:]])


def stream_upserts(spark: SparkSession, store: Store, options: dict, checkpoint: str):
    """The same load as a stream: micro-batches of the API, each applied and committed by foreachBatch.

    Delivery is at least once. A batch that is replayed writes its parts over and merges
    what is there already, so its effect is that of once; the watermark moves as in load().
    """
    paged.register(spark)

    def commit(batch: DataFrame, epoch: int) -> None:
        apply(store, batch, f"epoch-{epoch}")

    stream = spark.readStream.format("paged_responses").options(**options).load()
    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
