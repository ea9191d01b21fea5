"""Declared schemas. Column names and order are part of the public contract."""

from __future__ import annotations

# The flat survey event, its required fields and score ranges.
EVENT = (
    "response_id string, customer_id string, journey_stage string, responded_at timestamp, updated_at timestamp, "
    "event_version bigint, nps_score bigint, csat_score bigint, category string, comment string"
)
EVENT_FIELDS = [x.split()[0] for x in EVENT.split(", ")]
REQUIRED_FIELDS = EVENT_FIELDS[:-1]
NPS_RANGE, CSAT_RANGE = (0, 10), (1, 5)

# The delivery receipt and the published survey tables.
RECEIPT = "receipt_id string, batch_id string, page int, position int, received_at timestamp, payload string"
RESPONSE_FIELDS = [
    "survey_id", "response_id", "customer_id", "source_version", "updated_at", "answered_at", "created_at",
    "metric", "score", "journey_stage", "feedback", "event_id", "payload_hash", "quality_status",
]
CATEGORY_FIELDS = ["survey_id", "response_id", "category", "subcategory", "source_version"]
QUESTION_FIELDS = ["survey_id", "response_id", "question_id", "question_text", "value_json", "source_version"]
QUESTION_COLUMNS = {
    "q_wait": "answer_wait",
    "q_resolution": "answer_resolution",
    "q_channels": "answer_channels",
    "q_wait_alt": "answer_wait_alternative",
    "q_detail": "answer_detail",
}
WIDE_FIELDS = [*RESPONSE_FIELDS, *QUESTION_COLUMNS.values(), "category_count"]
KEYS = {
    "responses": ["survey_id", "response_id"],
    "response_categories": ["survey_id", "response_id", "category", "subcategory"],
    "question_answers": ["survey_id", "response_id", "question_id"],
    "responses_wide": ["survey_id", "response_id"],
}
