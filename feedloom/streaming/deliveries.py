"""Delivered snapshots in batches: keep the history, resolve, publish all tables at once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.children import json_form
from ..operators import metrics, snapshots
from ..operators.upsert import assert_empty, duplicate_keys, orphans
from ..schemas import KEYS, RECEIPT
from ..sources import files
from ..sources.store import Store


NORMALIZED = (
    "receipt_id string, reason string, payload string, response_id string, survey_id string, event_id string, customer_id string, source_version int, metric string, score int, "
    "updated_at string, answered_at string, created_at string, journey_stage string, feedback string, deleted boolean, categories array<struct<category:string,subcategory:string>>, "
    "questions array<struct<question_id:string,question_text:string,value_json:string>>, payload_hash string, run string"
)
TABLES = ("responses", "response_categories", "question_answers", "responses_wide")
_RAW = RECEIPT + ", whole string"


def run_batch(store: Store, receipts: DataFrame, rebuild: bool = False) -> dict:
    """Merge a batch of receipts into the history and publish the tables it gives.

    A receipt id that comes again with other content fails the whole batch, before
    anything is written. A receipt is normalized once and kept so. Only responses that
    the batch can affect are resolved again, unless rebuild asks for all; the result is
    that of a rebuild from the whole history. Keys and references are checked before
    the commit, which publishes all tables at once.
    """
    # the payload's text is compared in one form, whatever spaces or order it came with
    form = json_form(F.col("payload")).alias("payload")
    batch = receipts.withColumn("whole", F.to_json(F.struct(*(form if c == "payload" else F.col(c) for c in receipts.columns))))
    store.retain("receipts", batch, "receipt_id", "whole", _RAW, ("batch_id",))
    raw = store.history("receipts", _RAW)
    known = store.history("normalized", NORMALIZED)
    fresh = snapshots.normalize(raw.select("receipt_id", "payload").join(known.select("receipt_id"), "receipt_id", "left_anti"))
    # a part of its own: what was normalized before isn't written again
    store.append("normalized", fresh, "run", uuid.uuid4().hex)
    history = store.history("normalized", NORMALIZED)
    told = store.table("survey", "receipt_audit")
    # the audit accounts for every receipt that was published: a run that ended early is made up for
    new = history if told is None else history.join(told.select("receipt_id"), "receipt_id", "left_anti")
    held = None if rebuild else store.table("survey", "current_snapshots")
    again = (history if held is None else snapshots.affected(history, new)).drop("run").cache()
    try:
        resolved = snapshots.resolve(again)
        published = resolved | snapshots.model(resolved["current"])
        published = {"current_snapshots": published.pop("current"), "receipt_audit": published.pop("audit"), **published}
        if held is not None:
            keys = again.select("survey_id", "response_id").distinct()
            for name, df in published.items():
                old = store.table("survey", name)
                by = ["receipt_id"] if "receipt_id" in old.columns else KEYS["responses"]
                gone = again.select("receipt_id") if by == ["receipt_id"] else keys
                published[name] = old.join(gone, by, "left_anti").select(*df.columns).unionByName(df)
        published = {name: df.cache() for name, df in published.items()}
        for name in TABLES:
            assert_empty(duplicate_keys(published[name], KEYS[name]), f"duplicate key in {name}")
            assert_empty(orphans(published[name], published["responses"], KEYS["responses"]), f"rows without a response in {name}")
        facts = {"receipts": raw.count(), "resolved": again.count()}
        store.replace("survey", published, **facts)
        for df in published.values():
            df.unpersist()
    finally:
        again.unpersist()
    return facts


def report(store: Store) -> dict:
    """Counts, metrics at both grains and the invariants of the published snapshot."""
    table = lambda name: store.table("survey", name)
    audit = {r.status: r["count"] for r in table("receipt_audit").groupBy("status").count().orderBy("status").collect()}
    rows = {n: table(n).count() for n in TABLES}
    return {
        "bronze_receipts": store.facts("survey")["receipts"],
        "receipt_statuses": audit,
        "quarantine_reasons": {r.reason: r["count"] for r in table("quarantine").groupBy("reason").count().orderBy("reason").collect()},
        "table_rows": rows,
        "correct_metrics": metrics.summary(table("responses")).first().asDict(),
        "wrong_metrics_latest_join_only": metrics.summary(snapshots.exploded(table("current_snapshots"))).first().asDict(),
        "digest": metrics.output_digest({n: table(n) for n in TABLES}),
        "invariants": {"audit_accounts_for_all_receipts": sum(audit.values()) == store.facts("survey")["receipts"], "wide_equals_response_count": rows["responses_wide"] == rows["responses"]},
    }


def export(store: Store, root: str, micro: tuple[str, ...] = ()) -> dict:
    """The published tables and the evidence beside them, as CSV, JSON lines and a summary.

    Silver and gold tables, the fan-out diagnostic (of all responses and of the ids in
    `micro`, with their wide rows), the audit, the quarantine and report(). Every table is
    a folder with a header line in each file, sorted by its key.
    """
    table = lambda name: store.table("survey", name)
    some = F.col("response_id").isin(*micro) & (F.col("survey_id") == "survey-demo")
    flat = snapshots.exploded(table("current_snapshots"))
    frames = {f"{'gold' if n == 'responses_wide' else 'silver'}/{n}": (table(n), KEYS[n]) for n in TABLES}
    frames["diagnostics/fan_out"] = (flat, flat.columns)
    frames["reports/receipt_audit"] = (table("receipt_audit"), ["receipt_id"])
    if micro:
        frames["diagnostics/micro_before"] = (flat.filter(some), flat.columns)
        frames["diagnostics/micro_after"] = (table("responses_wide").filter(some), KEYS["responses_wide"])
    for path, (df, order) in frames.items():
        df.orderBy(*order).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{root}/{path}")
    files.write_jsonl(table("quarantine").orderBy("receipt_id"), f"{root}/reports/quarantine", "overwrite")
    summary = report(store)
    files.write_report(store.spark, summary, f"{root}/reports/execution_summary.json")
    return summary
