"""Runs of the survey part: python -m feedloom load | deliver."""

from __future__ import annotations

import argparse
import json
import os
from datetime import UTC, datetime

from .session import session
from .sources.files import read_receipts
from .sources.paged import iso
from .sources.store import Store
from .streaming import deliveries, incremental


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="feedloom", description=__doc__)
    kinds = top.add_subparsers(dest="kind", required=True)
    load = kinds.add_parser("load", help="one run over the paginated API: full the first time, then incremental")
    load.add_argument("--url", required=True, help="the API's base address")
    load.add_argument("--token", default=os.environ.get("FEEDLOOM_TOKEN", ""), help="bearer token, else FEEDLOOM_TOKEN")
    load.add_argument("--as-of", action="append", help="cut-off instant; several give as many runs in their order; now if none")
    load.add_argument("--page-size", type=int, default=250)
    load.add_argument("--reports", help="folder of the runs' reports")
    deliver = kinds.add_parser("deliver", help="merge delivered receipts and publish the tables they give")
    deliver.add_argument("--input", required=True, help="JSON lines of receipts")
    deliver.add_argument("--batch", action="append", help="a batch id; several are merged in their order; all receipts at once if none")
    deliver.add_argument("--rebuild", action="store_true", help="resolve all responses again, not only those affected")
    deliver.add_argument("--export", help="folder of the published tables and the evidence")
    for kind in (load, deliver):
        kind.add_argument("--root", required=True, help="the store's folder")
        kind.add_argument("--reset", action="store_true", help="delete what the store holds first")
    return top


def run(spark, argv: list[str] | None = None) -> list[dict]:
    """The reports of the runs that the arguments ask for."""
    asked = arguments().parse_args(argv)
    store = Store(spark, asked.root)
    if asked.reset:
        if not store.is_own():
            raise SystemExit(f"{asked.root} holds other things than a store: not deleted")
        store.reset()
    told = []
    if asked.kind == "load":
        for as_of in asked.as_of or [iso(datetime.now(UTC))]:
            told.append(incremental.load(store, asked.url, asked.token, as_of, asked.page_size))
            if asked.reports:
                incremental.save_reports(store, told[-1], asked.reports)
        return told
    for batch in asked.batch or ["all"]:
        facts = deliveries.run_batch(store, read_receipts(spark, asked.input, batch), asked.rebuild)
        told.append({"batch": batch, **facts})
    told.append(deliveries.export(store, asked.export) if asked.export else deliveries.report(store))
    return told


if __name__ == "__main__":
    arguments().parse_args()  # wrong arguments end it before a session begins
    for report in run(session()):
        print(json.dumps(report, ensure_ascii=False, sort_keys=True, default=str))
