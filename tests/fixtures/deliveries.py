"""Deliveries with the outcome that each must have: a table of cases, and random histories."""

import json
import random
from datetime import UTC, datetime, timedelta

CURRENT, OLD, COPY = ("selected_current", "source_version_order"), ("superseded_version", "source_version_order"), ("repeated_snapshot", "same_business_content")
GONE = ("deleted_current", "source_version_order")

# The three published responses whose hashes are checked, and the envelope fields they share.
ENVELOPE = {
    "createdAt": "2026-08-01T12:00:00Z", "answerDate": "2026-08-01T12:00:00Z", "updatedAt": "2026-08-01T12:00:00Z", "version": 1, "actionId": "survey-demo",
    "journeyStage": "support", "metric": "NPS", "review": 9, "deleted": False, "feedback": "Comentário inteiramente sintético.", "categories": [], "additionalQuestions": [],
}
PUBLISHED = {
    "R001": {
        "review": 3,
        "categories": [{"category": "Atendimento", "subCategory": "Demora"}, {"category": "Comunicação", "subCategory": "Retorno"}, {"category": "Processo", "subCategory": "Agendamento"}],
        "additionalQuestions": [{"_id": "q_wait", "text": "Tempo de espera", "review": 40}, {"_id": "q_resolution", "text": "Problema resolvido?", "answerText": "Não"}],
    },
    "R002": {
        "review": 10,
        "categories": [{"category": "Atendimento", "subCategory": "Cordialidade"}],
        "additionalQuestions": [{"_id": "q_resolution", "text": "Problema resolvido?", "answerText": "Sim"}],
    },
    "R003": {"review": 10},
}


def snapshot(name, **fields):
    return ENVELOPE | {"_id": name, "clientId": f"customer-{name}", "eventId": f"{name}/{fields.get('version', 1)}"} | fields


def asked(name, label="A question", **answer):
    return {"_id": name, "text": label, **answer}


def broken(reason):
    return ("quarantined", reason)


SPACED = {"categories": [{"category": " on​line  shop ", "subCategory": None}, {"category": "online shop"}], "additionalQuestions": [asked("q1", "﻿How  long? ", review=" 0 ")] * 2}
TIDY = {"categories": [{"category": "online shop", "subCategory": ""}], "additionalQuestions": [asked("q1", "How long?", review="0")]}

#: Response -> its deliveries in order of receipt id: (payload fields, outcome).
CASES = {
    "copy": [({}, CURRENT), ({}, COPY), ({"eventId": "copy/by another way"}, COPY)],
    "newer": [({}, OLD), ({"version": 2, "review": 1, "categories": []}, CURRENT)],
    "late": [({"version": 3, "review": 2}, CURRENT), ({"version": 1}, OLD), ({"version": 2, "review": 8}, OLD)],
    "gone": [({"categories": [{"category": "x"}]}, OLD), ({"version": 2, "deleted": True}, GONE)],
    "back": [({"version": 1}, OLD), ({"version": 2, "deleted": True}, OLD), ({"version": 3, "review": 10}, CURRENT)],
    "two faces": [({"review": 4}, CURRENT), ({"version": 2, "eventId": "f1", "review": 5}, broken("response_version_conflict")), ({"version": 2, "eventId": "f2", "review": 6}, broken("response_version_conflict"))],
    "zone": [({"updatedAt": "2026-08-02T00:30:00+02:00"}, CURRENT), ({"updatedAt": "2026-08-01T22:30:00Z", "eventId": "zone/utc"}, COPY)],
    "forms": [({"updatedAt": "20260801T223000,1234567+0000", "createdAt": "2026-08-01T12:00:00.5+00:00:30"}, CURRENT)],
    "spaces": [(SPACED, CURRENT), (TIDY | {"eventId": "spaces/tidy"}, COPY)],
    "digits": [({"review": "\t7 "}, CURRENT), ({"review": 7, "eventId": "digits/number"}, COPY), ({"review": "٧", "eventId": "digits/other script"}, COPY)],
    "answers": [({"additionalQuestions": [asked("q_wait", review="", answerText=" ", multipleValues=["b", " a "]), asked("q_detail", review={"z": " x ", "a": [" ", {"k": 1.5}]}), asked("q_none", review=[])]}, CURRENT)],
    "zero": [({"metric": "CSAT", "review": 5, "additionalQuestions": [asked("q_wait", review=0), asked("q_wait_alt", review=False)]}, CURRENT)],
    "deep talk": [({"feedback": {"said": ["  much  ", {"and": True}]}}, CURRENT)],
    "no stage": [({"journeyStage": "  a  stage "}, CURRENT)],
    "first": [({"eventId": "shared"}, broken("event_id_payload_conflict"))],
    "second": [({"eventId": "shared", "actionId": "another survey"}, broken("event_id_payload_conflict"))],
    "survives": [({"version": 1, "review": 0}, CURRENT), ({"version": 2, "review": 11}, broken("score_out_of_range"))],
}
WRONG = [
    ({"_id": None}, "invalid_identifier"), ({"_id": 5}, "invalid_identifier"), ({"actionId": ""}, "invalid_identifier"), ({"clientId": " a"}, "invalid_identifier"), ({"eventId": "a​b"}, "invalid_identifier"),
    ({"version": 0}, "invalid_source_version"), ({"version": True}, "invalid_source_version"), ({"version": "1"}, "invalid_source_version"), ({"version": 1.0}, "invalid_source_version"), ({"version": 10**30}, "invalid_source_version"),
    ({"metric": "CES"}, "invalid_metric"), ({"metric": None, "review": 99}, "invalid_metric"),
    ({"review": 11}, "score_out_of_range"), ({"review": -1}, "score_out_of_range"), ({"metric": "CSAT", "review": 0}, "score_out_of_range"), ({"review": True}, "score_out_of_range"),
    ({"review": 9.0}, "score_out_of_range"), ({"review": "nine"}, "score_out_of_range"), ({"review": "-1"}, "score_out_of_range"), ({"review": "9" * 400}, "score_out_of_range"), ({"review": 10**400}, "score_out_of_range"),
    ({"updatedAt": "soon"}, "invalid_timestamp"), ({"answerDate": 7}, "invalid_timestamp"), ({"createdAt": None}, "invalid_timestamp"), ({"createdAt": "2026-02-30T00:00:00Z"}, "invalid_timestamp"),
    ({"updatedAt": "2026-08-01T12:00:00"}, "timestamp_without_timezone"), ({"answerDate": "20260801"}, "timestamp_without_timezone"),
    ({"updatedAt": "2026-08-01T11:59:59.999999Z"}, "update_precedes_answer_or_creation"), ({"createdAt": "2026-08-01T12:00:00-00:01"}, "update_precedes_answer_or_creation"),
    ({"categories": None}, "missing_snapshot_children"), ({"additionalQuestions": {}}, "missing_snapshot_children"),
    ({"categories": ["x"]}, "invalid_category"), ({"categories": [{"category": None}]}, "expected_string"), ({"categories": [{"category": "a", "subCategory": 3}]}, "expected_string"), ({"categories": [{"category": " ​"}]}, "empty_category"),
    ({"additionalQuestions": [1]}, "invalid_question"), ({"additionalQuestions": [asked(None)]}, "invalid_identifier"), ({"additionalQuestions": [asked("q", 4)]}, "expected_string"), ({"additionalQuestions": [asked("q", "﻿ ")]}, "empty_question_label"),
    ({"additionalQuestions": [asked("q", review=1), asked("q", review=True)]}, "conflicting_question_in_snapshot"), ({"additionalQuestions": [asked("q", review=[{"x": float("nan")}])]}, "non_finite_value"),
    ({"deleted": None}, "invalid_deleted_flag"), ({"deleted": "no"}, "invalid_deleted_flag"), ({"journeyStage": 3}, "expected_string"), ({"journeyStage": None}, "expected_string"), ({"feedback": [float("inf")]}, "non_finite_value"),
]
#: Payloads as text that are no objects.
RUBBISH = [None, "", "[1]", "{broken", '"text"', "null", '{"feedback":"\\ud800x"}', '{"_id":"\\udfff"}', '{"a":' * 100_000 + "1" + "}" * 100_000, "[" * 3000 + "]" * 3000, '{"version":' + "9" * 5000 + "}"]


def random_history(rng, name):
    """Deliveries of one response: some versions, some copies, some broken ones, with their outcomes."""
    out, top = [], rng.choice([1, 1, 1, 2, 3])
    for version in range(1, top + 1):
        fields = {"version": version, "metric": rng.choice(["NPS", "CSAT"]), "clientId": f"c{rng.randrange(99)}", "journeyStage": rng.choice(["start", "use", "end"])}
        fields["review"] = rng.randint(0, 10) if fields["metric"] == "NPS" else rng.randint(1, 5)
        fields["review"] = rng.choice([fields["review"], str(fields["review"])])
        fields["categories"] = [{"category": rng.choice("abc"), "subCategory": rng.choice(["", "s"])} for _ in range(rng.randrange(4))]
        fields["additionalQuestions"] = [asked(q, review=rng.randrange(90)) for q in rng.sample(["q_wait", "q_resolution", "q_channels", "q_other"], rng.randrange(4))]
        fields["deleted"] = version == top and rng.random() < 0.1
        status = OLD if version < top else GONE if fields["deleted"] else CURRENT
        out.append((fields, status))
        out += [(fields | {"eventId": f"{name}/{version}/again{i}"}, COPY) for i in range(rng.choice([0, 0, 0, 1, 2]))]
    if rng.random() < 0.1:
        out.append(({"version": top + 1, "review": 77}, broken("score_out_of_range")))
    return out


def build(count=300, seed=11):
    """(receipt rows in random order, receipt id -> outcome)."""
    rng, told = random.Random(seed), []
    told += [(snapshot(name, **fields), CURRENT) for name, fields in PUBLISHED.items()]
    for name, deliveries in [*CASES.items(), *((f"random {i}", None) for i in range(count))]:
        told += [(snapshot(name, **fields), outcome) for fields, outcome in deliveries or random_history(rng, name)]
    told += [(snapshot(f"wrong {i}") | fields, broken(reason)) for i, (fields, reason) in enumerate(WRONG)]
    texts = [(json.dumps(body, ensure_ascii=bool(i % 2)), outcome) for i, (body, outcome) in enumerate(told)]
    texts += [(text, broken("payload_not_object")) for text in RUBBISH]
    rows, outcomes = [], {}
    for n, (text, outcome) in enumerate(texts):
        receipt = f"d{n:05d}"
        outcomes[receipt] = outcome
        rows.append((receipt, "later" if n % 4 == 3 else "early", n // 50, n % 50, datetime(2026, 9, 1, tzinfo=UTC) + timedelta(seconds=n), text))
    rng.shuffle(rows)
    return rows, outcomes


def active(rows, outcomes):
    """The parsed payloads of the current snapshots that are not deleted."""
    return [json.loads(r[5]) for r in rows if outcomes[r[0]] == CURRENT]
