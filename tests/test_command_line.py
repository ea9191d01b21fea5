"""Both parts as runs from the command line."""

import json

import pytest

from feedloom.__main__ import arguments, run
from feedloom.sources.store import Store

from .fixtures import deliveries, events


def test_loads_are_full_once_then_incremental_and_a_reset_begins_again(spark, tmp_path):
    source = events.build(60)
    server = events.Server(source)
    root, reports = str(tmp_path / "lake"), tmp_path / "reports"
    first, last = source[len(source) // 2]["updated_at"], source[-1]["updated_at"]
    ask = ["load", "--url", server.url, "--token", events.TOKEN, "--root", root, "--reports", str(reports)]
    try:
        told = run(spark, [*ask, "--as-of", first, "--as-of", last])
        assert [t["mode"] for t in told] == ["full", "incremental"]
        assert told[0]["extracted_rows"] == sum(e["updated_at"] <= first for e in source)
        assert (reports / f"full_{first[:10]}.json").exists() and (reports / "load_comparison.txt").exists()
        (again,) = run(spark, [*ask, "--as-of", last, "--reset"])
        assert again["mode"] == "full" and again["extracted_rows"] == len(source)
        assert again["analytical_rows"] == told[1]["analytical_rows"]
    finally:
        server.close()


def test_batches_of_deliveries_are_merged_in_the_order_asked(spark, tmp_path):
    rows, _ = deliveries.build(5)
    lines = tmp_path / "receipts.jsonl"
    fields = ("receipt_id", "batch_id", "page", "position", "received_at")
    with lines.open("w", encoding="utf-8") as out:
        for r in rows:
            if r[5] and "{broken" not in r[5] and len(r[5]) < 4000:
                head = dict(zip(fields, (*r[:4], r[4].isoformat()), strict=True))
                out.write(json.dumps(head)[:-1] + ', "payload": ' + r[5] + "}\n")
    root = str(tmp_path / "lake")
    ask = ["deliver", "--input", str(lines), "--root", root, "--export", str(tmp_path / "out")]
    early, later, report = run(spark, [*ask, "--batch", "early", "--batch", "later"])
    assert early["receipts"] < later["receipts"] == report["bronze_receipts"]
    assert all(report["invariants"].values()) and (tmp_path / "out/reports/execution_summary.json").exists()
    *_, whole = run(spark, [*ask, "--reset", "--rebuild"])
    assert whole["digest"] == report["digest"]


def test_a_reset_deletes_no_foreign_folder(spark, tmp_path):
    (tmp_path / "letters.txt").write_text("mine")
    with pytest.raises(SystemExit, match="not deleted"):
        run(spark, ["deliver", "--input", "none", "--root", str(tmp_path), "--reset"])
    assert (tmp_path / "letters.txt").exists() and not Store(spark, str(tmp_path)).is_own()
    assert Store(spark, str(tmp_path / "nothing")).is_own()


@pytest.mark.parametrize("wrong", [[], ["load"], ["load", "--root", "x"], ["deliver", "--root", "x"], ["else"]])
def test_arguments_that_are_missing_are_named(wrong):
    with pytest.raises(SystemExit):
        arguments().parse_args(wrong)
