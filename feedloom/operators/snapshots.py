"""Delivered snapshots: validation, conflict resolution and the published tables.

Everything is a function of the retained history and independent of its order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.children import INSTANTS, payload_columns
from ..functions.text import digest, is_identifier, iso_micros, json_object, json_string
from ..schemas import KEYS, QUESTION_COLUMNS, QUESTION_FIELDS, RESPONSE_FIELDS, WIDE_FIELDS
from .validation import first_failure
from .versions import ranked, varies

IDENTIFIERS = ["response_id", "survey_id", "event_id", "customer_id"]


def normalize(receipts: DataFrame) -> DataFrame:
    """receipts(receipt_id, payload as JSON text) with typed columns and the first broken rule as `reason`.

    Rules in order: object; four identifiers; version; metric; score in its metric's
    range (a text of digits, of any script, counts as a number); three instants with
    zones; an update not before answer or creation; child lists and their entries;
    deletion flag; journey stage; feedback. payload_hash is the SHA-256 of the canonical
    model without event id and envelope. A missing or malformed payload, one nested
    beyond the parser, and one with half a surrogate pair are no objects. Of repeated
    JSON names the last counts. Further columns of receipts are ignored.
    """
    read = receipts.select("receipt_id", "payload", payload_columns(F.col("payload")).alias("p")).select("receipt_id", "payload", "p.*")
    low, high = F.when(F.col("metric") == "NPS", 0).otherwise(1), F.when(F.col("metric") == "NPS", 10).otherwise(5)
    no = lambda c: ~F.coalesce(c, F.lit(False))
    reason = first_failure(
        (no(F.col("is_object")), "payload_not_object"),
        *((~is_identifier(F.col(c)), "invalid_identifier") for c in IDENTIFIERS),
        (no(F.col("source_version") >= 1), "invalid_source_version"),
        (no(F.col("metric").isin("NPS", "CSAT")), "invalid_metric"),
        (no(F.col("score").between(low, high)), "score_out_of_range"),
        *((F.col(c).isNull(), F.col(f"{c}_reason")) for c in INSTANTS),
        ((F.col("updated_at") < F.col("answered_at")) | (F.col("updated_at") < F.col("created_at")), "update_precedes_answer_or_creation"),
        (F.col("reason").isNotNull(), F.col("reason")),
    )
    model = {
        **{c: json_string(F.col(c)) for c in ("survey_id", "response_id", "customer_id", "metric", "journey_stage")},
        **{c: json_string(iso_micros(F.col(c))) for c in INSTANTS},
        "source_version": F.col("source_version").cast("string"), "score": F.col("score").cast("string"), "deleted": F.col("deleted").cast("string"),
        "feedback": F.col("feedback_json"), "categories": F.col("categories_json"), "questions": F.col("questions_json"),
    }
    read = read.withColumn("payload_hash", digest(json_object(model))).withColumn("reason", reason)
    instants = [iso_micros(F.col(c)).alias(c) for c in INSTANTS]
    return read.select("receipt_id", "reason", "payload", *IDENTIFIERS, "source_version", "metric", "score", *instants, "journey_stage", "feedback", "deleted", "categories", "questions", "payload_hash")


def resolve(normalized: DataFrame) -> dict[str, DataFrame]:
    """current, audit and quarantine of a whole history.

    Conflicts are judged over valid receipts only: an event id with several contents
    rejects all its receipts, in any survey; else a version with several contents
    rejects all of that version. Of equal copies the least receipt_id stands for the
    version; the highest version is current. A response with any rejected receipt is
    flagged. One exchange serves the version conflict, the copies and the versions.
    """
    key, version = ["survey_id", "response_id"], ["survey_id", "response_id", "source_version"]
    valid, broken = normalized.filter("reason is null"), normalized.filter("reason is not null")
    judged = valid.withColumn("_event", varies(F.col("payload_hash"), "event_id")).repartition(*key)
    judged = judged.withColumn("_version", varies(F.col("payload_hash"), *version))
    judged = judged.withColumn("reason", first_failure((F.col("_event"), "event_id_payload_conflict"), (F.col("_version"), "response_version_conflict")))
    rejected = broken.unionByName(judged.filter("reason is not null").drop("_event", "_version"))
    copies = ranked(judged.filter("reason is null"), version, [F.col("receipt_id").asc()], "copy")
    held = ranked(copies.filter("copy = 1"), key, [F.col("source_version").desc()], "place")
    status = F.when(F.col("place") > 1, "superseded_version").when(F.col("deleted"), "deleted_current").otherwise("selected_current")
    audit = (
        held.select("receipt_id", status.alias("status"), F.lit("source_version_order").alias("reason"))
        .unionByName(copies.filter("copy > 1").select("receipt_id", F.lit("repeated_snapshot").alias("status"), F.lit("same_business_content").alias("reason")))
        .unionByName(rejected.select("receipt_id", F.lit("quarantined").alias("status"), "reason"))
    )
    flagged = rejected.select(*key).filter("survey_id is not null and response_id is not null").distinct().withColumn("_flag", F.lit(True))
    current = held.filter("place = 1").join(flagged, key, "left")
    current = current.withColumn("quality_status", F.when(F.col("_flag"), "has_rejected_history").otherwise("ok"))
    quarantine = rejected.select("receipt_id", "event_id", *key, "reason", F.col("payload").alias("raw_payload"))
    return {"current": current.drop("_flag", "copy", "place", "_event", "_version", "reason"), "audit": audit, "quarantine": quarantine}


def model(current: DataFrame) -> dict[str, DataFrame]:
    """The four published tables of current snapshots; deleted ones have no rows."""
    key = KEYS["responses"]
    active = current.filter(~F.col("deleted"))
    responses = active.select(*RESPONSE_FIELDS)
    categories = active.select(*key, F.explode("categories").alias("c"), "source_version").select(*key, "c.category", "c.subcategory", "source_version")
    questions = active.select(*key, F.explode("questions").alias("q"), "source_version").select(*key, "q.*", "source_version").select(*QUESTION_FIELDS)
    return {"responses": responses, "response_categories": categories, "question_answers": questions, "responses_wide": wide(responses, categories, questions)}


def wide(responses: DataFrame, categories: DataFrame, questions: DataFrame) -> DataFrame:
    """Responses with one column per registered question and the number of their categories."""
    key = KEYS["responses"]
    pivot = questions.groupBy(*key).pivot("question_id", list(QUESTION_COLUMNS)).agg(F.max("value_json"))
    pivot = pivot.withColumnsRenamed(QUESTION_COLUMNS)
    counts = categories.groupBy(*key).agg(F.count("*").cast("int").alias("category_count"))
    return responses.join(pivot, key, "left").join(counts, key, "left").fillna(0, ["category_count"]).select(*WIDE_FIELDS)


def exploded(current: DataFrame) -> DataFrame:
    """Active responses times their categories times their questions: the fan-out diagnostic."""
    rows = current.filter(~F.col("deleted")).select("survey_id", "response_id", "metric", "score", F.explode_outer("categories").alias("c"), "questions")
    rows = rows.select("survey_id", "response_id", "metric", "score", "c.category", "c.subcategory", F.explode_outer("questions").alias("q"))
    return rows.select("survey_id", "response_id", "metric", "score", "category", "subcategory", "q.question_id")


def affected(history: DataFrame, batch: DataFrame) -> DataFrame:
    """The normalized history's rows that a new batch can change the outcome of.

    Those of the batch's responses, and of responses that share an event id with them,
    however indirectly: event conflicts cross surveys and are retroactive. The history
    includes the batch. Only keys and event ids are shuffled until nothing is added.
    """
    key = ["survey_id", "response_id"]
    links = history.filter("reason is null").select(*key, "event_id").distinct()
    keys = batch.select(*key).distinct()
    n = keys.count()
    while True:
        events = links.join(keys, key, "left_semi").select("event_id").distinct()
        # a key without valid receipts has no links and stays by the union
        keys = links.join(events, "event_id", "left_semi").select(*key).unionByName(batch.select(*key)).distinct()
        more = keys.count()
        if more == n:
            break
        n = more
    return history.join(keys.select(*(F.col(c).alias(f"_{c}") for c in key)), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key], "left_semi")
