"""Named queries over delivered payloads, stores and loads, each with its DuckDB equivalent.

Orders and events are written out as JSON payloads and files here, and the engine reads
them back; the equivalents compute the same results from the tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import children
from ..functions import text as fn
from ..operators import metrics, snapshots, versions
from ..schemas import EVENT_FIELDS, KEYS
from ..sources import files
from ..sources.store import Store
from ..streaming import incremental
from .catalog import CUTOFF, WATERMARK, query, table


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see, for files that a query writes and reads back."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-shared"
    return f"{shared.rstrip('/')}/feedloom-plans/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


# -- every rule -------------------------------------------------------------------

#: What is wrong with an order's payload, by its key: a JSON field's name, its text, the reason.
FAULTS = [
    (None, None, None), ("_id", "5", "invalid_identifier"), ("_id", '" x"', "invalid_identifier"), ("actionId", '""', "invalid_identifier"), ("eventId", "null", "invalid_identifier"), ("clientId", '"a\\u200bb"', "invalid_identifier"),
    ("version", "0", "invalid_source_version"), ("version", "1.0", "invalid_source_version"), ("version", "true", "invalid_source_version"), ("metric", '"CES"', "invalid_metric"),
    ("review", "11", "score_out_of_range"), ("review", "true", "score_out_of_range"), ("review", "9.0", "score_out_of_range"), ("review", '"nine"', "score_out_of_range"), ("review", '"\\t7 "', None), ("review", '"\\u0667"', None),
    ("updatedAt", '"soon"', "invalid_timestamp"), ("answerDate", '"2026-08-01T12:00:00"', "timestamp_without_timezone"), ("createdAt", '"2026-08-01T13:00:01+01:00"', "update_precedes_answer_or_creation"), ("updatedAt", '"20260801T150000,25+0200"', None),
    ("categories", "null", "missing_snapshot_children"), ("additionalQuestions", "{}", "missing_snapshot_children"), ("categories", "[1]", "invalid_category"), ("categories", '[{"category":null}]', "expected_string"), ("categories", '[{"category":" "}]', "empty_category"),
    ("additionalQuestions", "[1]", "invalid_question"), ("additionalQuestions", '[{"_id":1,"text":"a"}]', "invalid_identifier"), ("additionalQuestions", '[{"_id":"q"}]', "expected_string"), ("additionalQuestions", '[{"_id":"q","text":"\\ufeff"}]', "empty_question_label"),
    ("additionalQuestions", '[{"_id":"q","text":"a","review":1},{"_id":"q","text":"a","review":true}]', "conflicting_question_in_snapshot"), ("additionalQuestions", '[{"_id":"q","text":"a","review":NaN}]', "non_finite_value"),
    ("deleted", '"no"', "invalid_deleted_flag"), ("journeyStage", "3", "expected_string"), ("feedback", "[Infinity]", "non_finite_value"), ("feedback", '"\\ud800"', "payload_not_object"), ("broken", "{", "payload_not_object"),
]
WHOLE = {
    "_id": '"r"', "actionId": '"s"', "eventId": '"e"', "clientId": '"c"', "version": "1", "metric": '"NPS"', "review": "7", "updatedAt": '"2026-08-01T12:00:00Z"', "answerDate": '"2026-08-01T12:00:00Z"',
    "createdAt": '"2026-08-01T12:00:00Z"', "categories": "[]", "additionalQuestions": "[]", "deleted": "false", "journeyStage": '"support"', "feedback": "null",
}


def faulty(field: str | None, value: str | None) -> str:
    held = WHOLE if field is None else WHOLE | {field: value}
    return "{" + ",".join(f'"{k}":{v}' for k, v in held.items()) + "}"


def _reasons_sql() -> str:
    cases = " ".join(f"WHEN {i} THEN '{reason}'" for i, (_, _, reason) in enumerate(FAULTS) if reason)
    return f"SELECT o_orderkey, CASE o_orderkey % {len(FAULTS)} {cases} END AS reason FROM orders"


@query(_reasons_sql())
def payload_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.array(*(F.lit(faulty(field, value)) for field, value, _ in FAULTS))
    receipts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("receipt_id"), F.get(texts, (F.col("o_orderkey") % len(FAULTS)).cast("int")).alias("payload"))
    return snapshots.normalize(receipts).select(F.col("receipt_id").alias("o_orderkey"), "reason")


# -- a whole snapshot -------------------------------------------------------------

LABELS = "SELECT DISTINCT l_orderkey, l_returnflag, l_linestatus FROM lineitem"
ASKED = "SELECT l_orderkey, l_linenumber, max(l_suppkey) AS answer FROM lineitem GROUP BY 1, 2"
DAY = "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%fZ')"
MODEL = f"""
  SELECT o_orderkey, o_custkey, o_orderkey % 11 AS score, {DAY} AS instant, trim(o_orderpriority) AS feedback,
    coalesce((SELECT string_agg('{{"category":"' || l_returnflag || '","subcategory":"' || l_linestatus || '"}}', ',' ORDER BY l_returnflag, l_linestatus) FROM ({LABELS}) WHERE l_orderkey = o_orderkey), '') AS categories,
    coalesce((SELECT string_agg('{{"question_id":"q' || l_linenumber || '","question_text":"line ' || l_linenumber || '","value":[' || answer || ',null]}}', ',' ORDER BY l_linenumber) FROM ({ASKED}) WHERE l_orderkey = o_orderkey), '') AS questions
  FROM orders"""
HASHED = f"""SELECT *, sha256('{{"answered_at":"' || instant || '","categories":[' || categories || '],"created_at":"' || instant || '","customer_id":"c' || o_custkey || '","deleted":false,"feedback":"' || feedback
  || '","journey_stage":"a stage","metric":"NPS","questions":[' || questions || '],"response_id":"r' || o_orderkey || '","score":' || score || ',"source_version":1,"survey_id":"orders","updated_at":"' || instant || '"}}') AS payload_hash FROM ({MODEL})"""


def order_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(receipt_id, payload): an order as a survey response, its lines as categories and questions, some of them twice."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber").agg(F.max("l_suppkey").alias("answer"), F.collect_set(F.struct(F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s"))).alias("labels"))
    per = lines.groupBy("o_orderkey").agg(
        F.flatten(F.collect_list(F.transform("labels", lambda x: F.struct(F.concat(F.lit("​ "), x["f"]).alias("category"), x["s"].alias("subCategory"))))).alias("categories"),
        F.collect_list(F.struct(F.concat(F.lit("q"), "l_linenumber").alias("_id"), F.concat(F.lit(" line  "), "l_linenumber").alias("text"), F.lit("  ").alias("review"), F.array(F.col("answer").cast("string"), F.lit(" ")).alias("multipleValues"))).alias("asked"),
    )
    rows = table(spark, sf_dir, "orders").join(per, "o_orderkey", "left")
    when = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    body = F.to_json(F.struct(
        F.concat(F.lit("r"), "o_orderkey").alias("_id"), F.lit("orders").alias("actionId"), F.concat(F.lit("e"), "o_orderkey").alias("eventId"), F.concat(F.lit("c"), "o_custkey").alias("clientId"), F.lit(1).alias("version"),
        F.lit("NPS").alias("metric"), F.concat(F.lit(" "), F.col("o_orderkey") % 11).alias("review"), when.alias("updatedAt"), when.alias("answerDate"), when.alias("createdAt"), F.lit(" a  stage").alias("journeyStage"),
        F.concat(F.lit(" "), "o_orderpriority").alias("feedback"), F.coalesce("categories", F.array()).alias("categories"),
        F.coalesce(F.concat("asked", "asked"), F.array()).alias("additionalQuestions"),
    ))
    # answers are numbers: their quotes go
    return rows.select(F.col("o_orderkey").alias("receipt_id"), F.regexp_replace(body, r'"multipleValues":\["(\d+)"', r'"multipleValues":[$1').alias("payload"))


@query(f"SELECT o_orderkey, score::INT AS score, instant AS updated_at, 'a stage' AS journey_stage, feedback, payload_hash FROM ({HASHED})")
def payload_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = snapshots.normalize(order_payloads(spark, sf_dir))
    return read.filter("reason is null").select(F.col("receipt_id").alias("o_orderkey"), "score", "updated_at", "journey_stage", "feedback", "payload_hash")


@query(f"SELECT 'r' || l_orderkey AS response_id, l_returnflag AS category, l_linestatus AS subcategory FROM ({LABELS}) JOIN orders ON l_orderkey = o_orderkey")
def published_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.model(snapshots.resolve(snapshots.normalize(order_payloads(spark, sf_dir)))["current"])["response_categories"].select("response_id", "category", "subcategory")


@query(f"SELECT 'r' || l_orderkey AS response_id, 'q' || l_linenumber AS question_id, 'line ' || l_linenumber AS question_text, '[' || answer || ',null]' AS value_json FROM ({ASKED}) JOIN orders ON l_orderkey = o_orderkey")
def published_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.model(snapshots.resolve(snapshots.normalize(order_payloads(spark, sf_dir)))["current"])["question_answers"].select("response_id", "question_id", "question_text", "value_json")


# -- resolution of a history ------------------------------------------------------

# an event is a delivery of its user's response; by its id it has one of four versions, and a type decides its content
DELIVERED = """SELECT event_id, user_id, 1 + event_id % 4 AS version, event_type = 'error' AS broken,
  CASE WHEN event_type = 'click' AND event_id % 4 = 1 THEN 3 WHEN event_id % 4 = 3 AND event_type = 'view' THEN 9 ELSE 5 END AS score,
  CASE WHEN event_type = 'signup' AND event_id % 4 = 2 THEN 'shared' ELSE 'v' || (event_id % 4) END || CASE WHEN event_type = 'signup' AND event_id % 4 = 2 THEN (user_id // 2)::VARCHAR ELSE '-' || user_id END AS event FROM events"""
JUDGED = f"""SELECT d.*, min(user_id * 1000 + version * 100 + score) OVER e <> max(user_id * 1000 + version * 100 + score) OVER e AS twin, min(score) OVER v <> max(score) OVER v AS torn
  FROM ({DELIVERED}) d WHERE NOT broken WINDOW e AS (PARTITION BY event), v AS (PARTITION BY user_id, version)"""
RANKED = f"SELECT *, row_number() OVER (PARTITION BY user_id, version ORDER BY lpad(event_id::VARCHAR, 12, '0')) AS copy FROM ({JUDGED}) WHERE NOT twin AND NOT torn"
PLACED = f"SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY version DESC) AS place FROM ({RANKED}) WHERE copy = 1"
AUDIT = f"""SELECT event_id, CASE WHEN place > 1 THEN 'superseded_version' WHEN version = 4 AND user_id % 5 = 0 THEN 'deleted_current' ELSE 'selected_current' END AS status, 'source_version_order' AS reason FROM ({PLACED})
  UNION ALL SELECT event_id, 'repeated_snapshot', 'same_business_content' FROM ({RANKED}) WHERE copy > 1
  UNION ALL SELECT event_id, 'quarantined', CASE WHEN twin THEN 'event_id_payload_conflict' ELSE 'response_version_conflict' END FROM ({JUDGED}) WHERE twin OR torn
  UNION ALL SELECT event_id, 'quarantined', 'score_out_of_range' FROM ({DELIVERED}) WHERE broken"""


def event_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, part = F.col("event_type"), F.col("event_id") % 4
    shared = (kind == "signup") & (part == 2)
    score = F.when(kind == "error", 77).when((kind == "click") & (part == 1), 3).when((kind == "view") & (part == 3), 9).otherwise(5)
    event = F.when(shared, F.concat(F.lit("shared"), F.floor(F.col("user_id") / 2))).otherwise(F.concat(F.lit("v"), part, F.lit("-"), "user_id"))
    day = F.lit("2026-08-01T12:00:00Z")
    body = F.to_json(F.struct(
        F.concat(F.lit("u"), "user_id").alias("_id"), F.lit("events").alias("actionId"), event.alias("eventId"), F.lit("c").alias("clientId"), (part + 1).alias("version"), F.lit("NPS").alias("metric"), score.alias("review"),
        day.alias("updatedAt"), day.alias("answerDate"), day.alias("createdAt"), ((part == 3) & (F.col("user_id") % 5 == 0)).alias("deleted"), F.array().cast("array<string>").alias("categories"), F.array().cast("array<string>").alias("additionalQuestions"),
    ))
    return table(spark, sf_dir, "events").select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("receipt_id"), body.alias("payload"))


@query(AUDIT)
def snapshot_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = snapshots.resolve(snapshots.normalize(event_receipts(spark, sf_dir)))["audit"]
    return audit.select(F.col("receipt_id").cast("long").alias("event_id"), "status", "reason")


@query(f"""SELECT 'u' || p.user_id AS response_id, p.version::INT AS source_version, p.score::INT AS score, p.version = 4 AND p.user_id % 5 = 0 AS deleted,
  CASE WHEN b.user_id IS NULL THEN 'ok' ELSE 'has_rejected_history' END AS quality_status FROM (SELECT * FROM ({PLACED}) WHERE place = 1) p
  LEFT JOIN (SELECT DISTINCT e.user_id FROM events e JOIN ({AUDIT}) a ON a.event_id = e.event_id WHERE a.status = 'quarantined') b ON b.user_id = p.user_id""")
def snapshot_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = snapshots.resolve(snapshots.normalize(event_receipts(spark, sf_dir)))["current"]
    return current.select("response_id", "source_version", "score", "deleted", "quality_status")


@query(f"SELECT count(*) AS receipts, count(*) AS accounted, true AS all_accounted, count(*) FILTER (status = 'selected_current') AS active, true AS order_is_no_matter FROM ({AUDIT})")
def accounting_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    receipts = event_receipts(spark, sf_dir)
    normal = snapshots.normalize(receipts)
    found = snapshots.resolve(normal)
    other = snapshots.resolve(snapshots.normalize(receipts.orderBy(F.xxhash64("receipt_id"))))
    audit, active = found["audit"], snapshots.model(found["current"])["responses"]
    same = metrics.output_digest({"current": found["current"]}) == metrics.output_digest({"current": other["current"]})
    counts = receipts.agg(F.count("*").alias("receipts")).crossJoin(audit.agg(F.count_distinct("receipt_id").alias("accounted"))).crossJoin(active.agg(F.count("*").alias("active")))
    return counts.select("receipts", "accounted", (F.col("receipts") == F.col("accounted")).alias("all_accounted"), "active", F.lit(same).alias("order_is_no_matter"))


@query("SELECT user_id, true AS affected FROM (SELECT DISTINCT user_id FROM events WHERE user_id // 2 IN (SELECT user_id // 2 FROM events WHERE ts > TIMESTAMP '2024-01-25') AND user_id // 2 IN (SELECT user_id // 2 FROM events))")
def affected_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses that late deliveries can change: those that share an event id with them, here in twos."""
    rows = table(spark, sf_dir, "events").select(F.lit("s").alias("survey_id"), F.col("user_id").cast("string").alias("response_id"), F.floor(F.col("user_id") / 2).cast("string").alias("event_id"), F.lit(None).cast("string").alias("reason"), "ts")
    found = snapshots.affected(rows, rows.filter(F.col("ts") > F.expr("timestamp_ntz'2024-01-25'")))
    return found.select(F.col("response_id").cast("long").alias("user_id")).distinct().withColumn("affected", F.lit(True))


# -- functions --------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 4 THEN epoch_us(o_orderdate) + CASE o_orderkey % 6 WHEN 1 THEN 3600000000 WHEN 2 THEN 250000 ELSE 0 END END AS micros,
  CASE o_orderkey % 6 WHEN 4 THEN 'timestamp_without_timezone' WHEN 5 THEN 'invalid_timestamp' END AS reason FROM orders""")
def instant_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts, form = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey") % 6
    plain = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    said = (
        F.when(form == 0, F.concat(plain, F.lit("Z"))).when(form == 1, F.concat(plain, F.lit("-01:00"))).when(form == 2, F.concat(plain, F.lit(".2500000009Z")))
        .when(form == 3, F.concat(F.date_format(ts, "yyyyMMdd'T'HHmmss"), F.lit("+0000"))).when(form == 4, plain).otherwise("soon")
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", F.unix_micros(fn.instant(said)).alias("micros"), F.when(fn.instant(said).isNull(), fn.instant_reason(said)).alias("reason"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN true ELSE false END AS is_id FROM customer")
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, name = F.col("c_custkey") % 4, F.regexp_replace("c_name", " ", "-")
    said = F.when(kind == 0, name).when(kind == 1, F.concat(F.lit(" "), name)).when(kind == 2, F.concat(name, F.lit("﻿")))
    return table(spark, sf_dir, "customer").select("c_custkey", fn.is_identifier(F.coalesce(said, F.lit(""))).alias("is_id"))


@query("SELECT event_id, greatest(0, least(10, round_even(value, 0)))::INT AS score FROM events")
def clamped_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", fn.bounded_score(F.col("value"), 0, 10).alias("score"))


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT + 1 AS k, '{\"k\":' || (json_extract(props, '$.k')::BIGINT + 1) || '}' AS props FROM events")
def payload_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload with one field set anew, in canonical form."""
    k = F.get_json_object("props", "$.k").cast("long") + 1
    patched = children.json_form(F.concat(F.lit('{ "k" :'), k, F.lit("}")))
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.regexp_replace(patched, ": ", ":").alias("props"))


# -- files, stores and loads ------------------------------------------------------


@query("SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'click') AS clicks, sum(event_id)::BIGINT AS total FROM events GROUP BY user_id")
def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "jsonl")
    files.write_jsonl(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), path)
    files.write_jsonl(table(spark, sf_dir, "events").limit(0), path, "ignore")  # what is there stays
    read = files.read_jsonl(spark, path, "event_id long, user_id long, event_type string")
    return read.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.sum("event_id").alias("total"))


def as_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rows of the flat survey source; errors have a score out of range."""
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), "user_id").alias("response_id"), F.lit("c").alias("customer_id"), F.lit("stage").alias("journey_stage"), ts.alias("responded_at"), ts.alias("updated_at"), F.col("event_id").alias("event_version"),
        F.when(F.col("event_type") == "error", 99).otherwise(F.col("event_id") % 11).cast("long").alias("nps_score"), (F.col("event_id") % 5 + 1).cast("long").alias("csat_score"), F.col("event_type").alias("category"),
        F.lit(None).cast("string").alias("comment"), F.lit(None).cast("string").alias("wrong"), F.lit(1).alias("page"), F.lit(0).alias("place"),
    )


def loaded(spark: SparkSession, sf_dir: str) -> tuple[Store, list[dict]]:
    """Three runs over the events: all to the watermark, then with an overlap to the cut-off, then the same again."""
    store, rows = Store(spark, folder(spark, "lake")), as_survey(spark, sf_dir)
    low, high = F.expr(f"timestamp'{WATERMARK}+00:00'"), F.expr(f"timestamp'{CUTOFF}+00:00'")
    second = rows.filter((F.col("updated_at") > low - F.expr("INTERVAL 5 MINUTES")) & (F.col("updated_at") <= high))
    told = [incremental.apply(store, rows.filter(F.col("updated_at") <= low), "one"), incremental.apply(store, second, "two"), incremental.apply(store, second, "two")]
    return store, told


LOADED = f"SELECT * FROM events WHERE event_type <> 'error' AND ts <= TIMESTAMP '{CUTOFF}' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


@query(f"SELECT 'u' || user_id AS response_id, event_id AS event_version, event_id % 11 AS nps_score, event_type AS category FROM ({LOADED})")
def incremental_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded(spark, sf_dir)[0].table("responses", "fact_response").select("response_id", "event_version", "nps_score", "category")


def _run_sql(name: str, rows: str, replay: bool) -> str:
    latest = f"SELECT * FROM ({rows}) WHERE event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"
    held = f"SELECT * FROM events WHERE event_type <> 'error' AND ts <= TIMESTAMP '{CUTOFF if replay else WATERMARK}' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"
    held = f"SELECT * FROM events WHERE false" if name == "1" else held  # noqa: F541
    return f"""SELECT {name} AS run, (SELECT count(*) FROM ({rows})) AS extracted, count(*) AS valid, (SELECT count(*) FROM ({rows}) WHERE event_type = 'error') AS rejected,
      (SELECT count(*) FROM ({rows}) WHERE event_type <> 'error') - count(*) AS superseded, count(*) FILTER (t.user_id IS NULL) AS inserted, count(*) FILTER (s.ts > t.ts) AS updated,
      (SELECT strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') FROM events WHERE ts <= TIMESTAMP '{WATERMARK if name == "1" else CUTOFF}') AS watermark FROM ({latest}) s LEFT JOIN ({held}) t ON s.user_id = t.user_id"""


FIRST, SECOND = f"SELECT * FROM events WHERE ts <= TIMESTAMP '{WATERMARK}'", f"SELECT * FROM events WHERE ts > TIMESTAMP '{WATERMARK}' - INTERVAL 5 MINUTE AND ts <= TIMESTAMP '{CUTOFF}'"


@query(" UNION ALL ".join([_run_sql("1", FIRST, False), _run_sql("2", SECOND, False), _run_sql("3", SECOND, True)]))
def load_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each run reports: rows read, valid, superseded, rejected, inserted and updated, and the watermark it commits."""
    _, told = loaded(spark, sf_dir)
    rows = [(i, t["extracted_rows"], t["validation"]["valid_latest_rows_in_batch"], t["validation"]["quarantined_rows"], t["validation"]["superseded_or_replayed_rows_in_batch"], t["upsert"]["inserted"], t["upsert"]["updated"], t["committed_watermark"]) for i, t in enumerate(told, 1)]
    return spark.createDataFrame(rows, "run int, extracted long, valid long, rejected long, superseded long, inserted long, updated long, watermark string")


@query(f"SELECT 'one' AS run_id, count(*) AS kept, count(*) FILTER (event_type = 'error') AS quarantined FROM ({FIRST}) UNION ALL SELECT 'two', count(*), count(*) FILTER (event_type = 'error') FROM ({SECOND})")
def raw_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw and quarantined rows by run: a replayed run keeps them once."""
    store, _ = loaded(spark, sf_dir)
    kept = store.history("bronze", incremental.BRONZE).filter("source_entity = 'responses'").groupBy("run_id").agg(F.count("*").alias("kept"))
    bad = store.history("quarantine", incremental.QUARANTINE).filter("reason = 'invalid_nps_score'").groupBy("run_id").agg(F.count("*").alias("quarantined"))
    return kept.join(bad, "run_id", "left").fillna(0)


@query(f"SELECT row_number() OVER (ORDER BY 'u' || user_id) AS place, 'u' || user_id AS response_id, event_type AS category FROM ({LOADED})")
def gold_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published fact as one CSV file, sorted for publication, read back in its order."""
    path = folder(spark, "gold")
    files.write_gold_csv(loaded(spark, sf_dir)[0].table("responses", "fact_response"), path)
    lines = spark.read.option("header", True).csv(path).select("response_id", "category", F.monotonically_increasing_id().alias("line"))
    assert spark.read.option("header", True).csv(path).columns == EVENT_FIELDS
    return versions.ranked(lines.withColumn("all", F.lit(1)), ["all"], [F.col("line")], "place").select(F.col("place").cast("long").alias("place"), "response_id", "category")


@query("SELECT 'nation' AS name, n_nationkey::BIGINT AS key FROM nation WHERE n_nationkey > 3 UNION ALL SELECT 'region', r_regionkey::BIGINT FROM region")
def store_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables published together, then again with one of them changed; one pointer tells what holds."""
    store, nation, region = Store(spark, folder(spark, "store")), table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    store.replace("geo", {"nation": nation, "region": region.limit(0)}, mark=1)
    store.replace("geo", {"nation": store.table("geo", "nation").filter("n_nationkey > 3"), "region": region}, mark=2)
    store.register("geo", "stored_")
    return spark.sql("SELECT 'nation' AS name, cast(n_nationkey AS bigint) AS key FROM stored_nation UNION ALL SELECT 'region', cast(r_regionkey AS bigint) FROM stored_region")


@query("SELECT o_orderkey, o_orderstatus AS content FROM orders")
def retained_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries in two batches that overlap, and one of them again: each is kept once, whichever brings it."""
    store = Store(spark, folder(spark, "receipts"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("receipt_id"), F.col("o_orderstatus").alias("content"), F.col("o_orderdate"))
    middle = F.expr("timestamp_ntz'1995-06-01'")
    early, late = rows.filter(F.col("o_orderdate") < middle), rows.filter(F.coalesce(F.col("o_orderdate") >= middle - F.expr("INTERVAL 300 DAYS"), F.lit(True)))
    for name, batch in (("early", early), ("late", late), ("late", late)):
        store.retain("receipts", batch.drop("o_orderdate").withColumn("batch_id", F.lit(name)), "receipt_id", "content", "receipt_id string, content string, batch_id string", ("batch_id",))
    return store.history("receipts", "receipt_id string, content string, batch_id string").select(F.col("receipt_id").cast("long").alias("o_orderkey"), "content")


@query("SELECT 'responses' AS name, 2::BIGINT AS keys UNION ALL SELECT 'response_categories', 4 UNION ALL SELECT 'question_answers', 3 UNION ALL SELECT 'responses_wide', 2")
def table_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry of published tables and how many columns their keys have."""
    return spark.createDataFrame([(n, len(k)) for n, k in KEYS.items()], "name string, keys long")
