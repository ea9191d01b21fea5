"""Delivered snapshots: rules, conflicts, published tables and replays."""

import json
import random
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from feedloom.functions.children import tidy
from feedloom.operators import metrics, snapshots
from feedloom.operators.upsert import duplicate_keys, orphans
from feedloom.schemas import KEYS, RECEIPT
from feedloom.sources.files import read_receipts
from feedloom.sources.store import Store
from feedloom.streaming import deliveries

from .fixtures import deliveries as made

# Published hashes of the micro example's first three responses.
HASHES = {
    "R001": "3667cd8522830c469bb9192d9f1e654517f917725fc0791d7dc798ade633d414",
    "R002": "eb770b4f43011548d518f57188195942f7339db258c1cf6ddfea02ec727e99e8",
    "R003": "aa6722ceae3a3b7b5c89a86ce09d30710755e652420418805451a63a34837542",
}


@lru_cache(maxsize=1)
def made_rows():
    return made.build()


def rows():
    return made_rows()[0]


@pytest.fixture(scope="module")
def resolved(spark):
    receipts = spark.createDataFrame(rows(), RECEIPT)
    found = snapshots.resolve(snapshots.normalize(receipts.select("receipt_id", "payload")).cache())
    return {k: v.cache() for k, v in found.items()}


@pytest.fixture(scope="module")
def tables(resolved):
    return {k: v.cache() for k, v in snapshots.model(resolved["current"]).items()}


def test_every_delivery_has_its_outcome(resolved):
    want = made_rows()[1]
    got = {r.receipt_id: (r.status, r.reason) for r in resolved["audit"].collect()}
    assert {k: (got.get(k), v) for k, v in want.items() if got.get(k) != v} == {} and len(got) == len(want)
    assert {r.receipt_id for r in resolved["quarantine"].collect()} == {k for k, v in want.items() if v[0] == "quarantined"}
    # every rule is met
    assert {v[1] for v in want.values()} >= {reason for _, reason in made.WRONG} | {"payload_not_object", "response_version_conflict", "event_id_payload_conflict"}


def test_published_tables_hold_their_keys(resolved, tables):
    bodies = made.active(*made_rows())
    pairs = {(b["actionId"], b["_id"], tidy(c["category"]), tidy(c.get("subCategory") or "")) for b in bodies for c in b["categories"]}
    asked = {(b["actionId"], b["_id"], q["_id"]) for b in bodies for q in b["additionalQuestions"]}
    assert {(r.survey_id, r.response_id, r.category, r.subcategory) for r in tables["response_categories"].collect()} == pairs
    assert {(r.survey_id, r.response_id, r.question_id) for r in tables["question_answers"].collect()} == asked
    assert {k: v.count() for k, v in tables.items()} == {"responses": len(bodies), "response_categories": len(pairs), "question_answers": len(asked), "responses_wide": len(bodies)}
    for name, df in tables.items():
        assert duplicate_keys(df, KEYS[name]).isEmpty() and orphans(df, tables["responses"], KEYS["responses"]).isEmpty()


def measures(bodies, weight):
    """(rows, nps, csat) of payloads, each counted weight(body) times."""
    nps = [(int(b["review"]), weight(b)) for b in bodies if b["metric"] == "NPS"]
    csat = [(int(b["review"]), weight(b)) for b in bodies if b["metric"] == "CSAT"]
    n, c = sum(w for _, w in nps), sum(w for _, w in csat)
    return n + c, n, round(100 * (sum(w for s, w in nps if s >= 9) - sum(w for s, w in nps if s <= 6)) / n, 6), c, round(100 * sum(w for s, w in csat if s >= 4) / c, 6)


def fan(body):
    return max(1, len({(tidy(c["category"]), tidy(c.get("subCategory") or "")) for c in body["categories"]})) * max(1, len({q["_id"] for q in body["additionalQuestions"]}))


def test_metrics_at_both_grains(resolved, tables):
    bodies = made.active(*made_rows())
    assert tuple(metrics.summary(tables["responses"]).first()) == measures(bodies, lambda b: 1)
    assert tuple(metrics.summary(snapshots.exploded(resolved["current"])).first()) == measures(bodies, fan)
    none = metrics.summary(tables["responses"].limit(0)).first()
    assert (none.rows, none.nps, none.csat_top2_pct) == (0, None, None)


def test_published_example(resolved, tables):
    first = "survey_id = 'survey-demo' and response_id in ('R001', 'R002', 'R003')"
    wide = {r.response_id: r for r in tables["responses_wide"].filter(first).collect()}
    assert {k: r.payload_hash for k, r in wide.items()} == HASHES
    assert (wide["R001"].answer_wait, wide["R001"].answer_resolution, wide["R001"].category_count) == ("40", '"Não"', 3)
    assert (wide["R003"].answer_wait, wide["R003"].category_count, wide["R003"].feedback) == (None, 0, "Comentário inteiramente sintético.")
    assert wide["R001"].updated_at == "2026-08-01T12:00:00.000000Z"
    flat = snapshots.exploded(resolved["current"]).filter(first)
    assert flat.count() == 8 and flat.filter("response_id = 'R001'").count() == 6
    assert metrics.summary(tables["responses"].filter(first)).first().nps == 33.333333 and metrics.summary(flat).first().nps == -50.0
    joined = metrics.fan_out(tables["responses"].filter(first), tables["response_categories"].select("survey_id", "response_id", "category"), tables["question_answers"].select("survey_id", "response_id", "question_id"), KEYS["responses"])
    assert joined.count() == 8


def test_what_the_current_snapshots_say(resolved, tables):
    now = {r.response_id: r for r in resolved["current"].filter("survey_id = 'survey-demo' and response_id not like 'random%'").collect()}
    questions = lambda name: {q.question_id: q.value_json for q in now[name].questions}
    assert (now["late"].source_version, now["late"].score, now["back"].source_version, now["digits"].score) == (3, 2, 3, 7)
    assert questions("answers") == {"q_wait": '["b","a"]', "q_detail": '{"a":[null,{"k":1.5}],"z":"x"}', "q_none": None}
    assert questions("zero") == {"q_wait": "0", "q_wait_alt": "false"} and questions("spaces") == {"q1": '"0"'}
    assert [tuple(c) for c in now["spaces"].categories] == [("online shop", "")] and now["no stage"].journey_stage == "a stage"
    assert now["forms"].updated_at == "2026-08-01T22:30:00.123456Z" and now["forms"].created_at == "2026-08-01T11:59:30.500000Z"
    assert now["deep talk"].feedback == '{"said":["much",{"and":true}]}'
    assert now["gone"].deleted and tables["responses"].filter("response_id = 'gone'").isEmpty()
    flagged = {r.response_id for r in resolved["current"].filter("quality_status <> 'ok'").collect() if not r.response_id.startswith("random")}
    assert flagged == {"two faces", "survives"}


def test_order_and_repeated_transport_change_nothing(spark, resolved):
    other = list(rows())
    random.Random(7).shuffle(other)
    again = spark.createDataFrame(other + [(f"z{r[0]}", *r[1:]) for r in rows()], RECEIPT)
    twice = snapshots.resolve(snapshots.normalize(again.select("receipt_id", "payload")))["current"]
    assert metrics.output_digest({"c": twice}) == metrics.output_digest({"c": resolved["current"]})


def test_no_setting_of_the_session_matters(spark):
    text = json.dumps(made.snapshot("twice"))[:-1] + ', "review": 3, "review": 4}'
    for allow in ("true", "false"):
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", allow)
        got = snapshots.normalize(spark.createDataFrame([("r", text)], "receipt_id string, payload string")).first()
        assert (got.reason, got.score) == (None, 4)
    spark.conf.unset("spark.sql.variant.allowDuplicateKeys")


def test_the_first_broken_rule_is_told(spark):
    """A payload that breaks every rule, mended one rule after another."""
    body = {k: None for k in made.snapshot("x")}
    steps = [
        ({}, "invalid_identifier"), ({"_id": "x", "actionId": "s", "eventId": "e", "clientId": "c"}, "invalid_source_version"), ({"version": 1}, "invalid_metric"), ({"metric": "NPS"}, "score_out_of_range"),
        ({"review": 5}, "invalid_timestamp"), ({"updatedAt": "2026-08-01T12:00:00"}, "timestamp_without_timezone"), ({"updatedAt": "2026-08-01T12:00:00Z", "answerDate": "2026-08-02T12:00:00Z", "createdAt": "2026-08-01T12:00:00Z"}, "update_precedes_answer_or_creation"),
        ({"answerDate": "2026-08-01T12:00:00Z", "categories": [1], "additionalQuestions": None}, "missing_snapshot_children"), ({"additionalQuestions": [1]}, "invalid_category"), ({"categories": []}, "invalid_question"),
        ({"additionalQuestions": []}, "invalid_deleted_flag"), ({"deleted": False}, "expected_string"), ({"journeyStage": "x", "feedback": float("nan")}, "non_finite_value"), ({"feedback": None}, None),
    ]
    texts, want = [], []
    for fields, reason in steps:
        body = body | fields
        texts.append((f"{len(texts):02d}", json.dumps(body)))
        want.append(reason)
    got = snapshots.normalize(spark.createDataFrame(texts, "receipt_id string, payload string")).orderBy("receipt_id").collect()
    assert [r.reason for r in got] == want


def test_batches_replay_and_rollback(spark, tables, tmp_path):
    store = Store(spark, str(tmp_path / "lake"))
    lines = tmp_path / "receipts.jsonl"
    fields = ("receipt_id", "batch_id", "page", "position", "received_at")
    told = [r for r in rows() if r[5] and "{broken" not in r[5] and len(r[5]) < 4000]
    with lines.open("w", encoding="utf-8") as out:
        for r in told:
            head = dict(zip(fields, (*r[:4], r[4].isoformat()), strict=True))
            out.write(json.dumps(head, ensure_ascii=False)[:-1] + ', "payload": ' + r[5] + "}\n\n")
    seen = []
    for batch in ("early", "later", "later"):
        facts = deliveries.run_batch(store, read_receipts(spark, str(lines), batch))
        seen.append((facts["receipts"], store.table("survey", "responses").count()))
    early, current = sum(r[1] == "early" for r in told), tables["responses"].count()
    assert [n for n, _ in seen] == [early, len(told), len(told)] and seen[1][1] == seen[2][1] == current
    # the later batches resolve again what they can affect, no more
    assert store.facts("survey")["resolved"] < len(told)
    report = deliveries.export(store, str(tmp_path / "out"), ("R001", "R002", "R003"))
    assert json.loads((tmp_path / "out/reports/execution_summary.json").read_text())["table_rows"] == report["table_rows"]
    read = lambda name: spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out" / name))
    assert read("diagnostics/micro_before").count() == 8 and read("diagnostics/micro_after").count() == 3 and read("gold/responses_wide").count() == current
    assert {r.response_id: r.payload_hash for r in read("diagnostics/micro_after").collect()} == HASHES
    assert spark.read.json(str(tmp_path / "out/reports/quarantine")).count() == store.table("survey", "quarantine").count()
    assert report["invariants"] == {"audit_accounts_for_all_receipts": True, "wide_equals_response_count": True}
    assert report["digest"] == metrics.output_digest(tables)
    some = told[0][0]
    changed = read_receipts(spark, str(lines), told[0][1]).withColumn("payload", F.when(F.col("receipt_id") == some, F.lit("{}")).otherwise(F.col("payload")))
    with pytest.raises(ValueError, match="receipt_id_collision"):
        deliveries.run_batch(store, changed)
    assert deliveries.report(store)["digest"] == report["digest"]


def test_small_batches_equal_a_rebuild(spark, tmp_path):
    small = [r for r in rows() if int(r[0][1:]) < 60]
    random.Random(11).shuffle(small)
    step, whole = Store(spark, str(tmp_path / "step")), Store(spark, str(tmp_path / "whole"))
    for low in range(0, 60, 15):
        deliveries.run_batch(step, spark.createDataFrame(small[low : low + 15], RECEIPT))
    deliveries.run_batch(whole, spark.createDataFrame(small, RECEIPT), rebuild=True)
    names = (*deliveries.TABLES, "current_snapshots", "receipt_audit", "quarantine")
    digests = [metrics.output_digest({n: s.table("survey", n) for n in names}) for s in (step, whole)]
    assert digests[0] == digests[1]


def test_affected_keys_follow_shared_events(spark):
    a, b, c, d = (made.snapshot(x) for x in ("A", "B", "C", "D"))
    b |= {"eventId": a["eventId"]}
    history = snapshots.normalize(spark.createDataFrame([(str(i), json.dumps(x)) for i, x in enumerate((a, b, c))], "receipt_id string, payload string"))
    batch = snapshots.normalize(spark.createDataFrame([("9", json.dumps(d | {"eventId": a["eventId"], "_id": "A"}))], "receipt_id string, payload string"))
    assert {r.response_id for r in snapshots.affected(history.union(batch), batch).collect()} == {"A", "B"}


def test_category_metrics(tables):
    key = KEYS["responses"]
    some = tables["responses"].filter("metric = 'NPS'")
    inside = metrics.with_member(some, tables["response_categories"].filter("category = 'a'"), key)
    by = {r.category: r for r in metrics.by_member(tables["responses"], tables["response_categories"], key, "category").collect()}
    assert inside.count() == by["a"].category_responses
    assert metrics.summary(inside).first().nps == by["a"].category_nps
