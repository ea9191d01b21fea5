"""A paginated HTTP API as a Spark data source, in batch and as a micro-batch stream.

format("paged_responses") with the options url, token, as_of, updated_since,
page_size, attempts. The range of update times is pushed down to the API, from the options
and from filters on updated_at (with spark.sql.python.filterPushdown.enabled). A page is a
partition, in batch and in a stream, so pages are fetched in parallel and a lost one is
fetched again; no more than one page comes to the driver.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..functions.text import read_instant
from ..schemas import EVENT, EVENT_FIELDS

FAR = "2100-01-01T00:00:00Z"
SCHEMA = EVENT + ", wrong string, page int, place int"
_INSTANTS = {"responded_at", "updated_at"}
_NUMBERS = {"event_version", "nps_score", "csat_score"}


def fetch(url: str, token: str, attempts: int = 3, pause: float = 0.25) -> dict:
    """A JSON answer; any HTTP or network error is tried again with doubled pauses."""
    request = urllib.request.Request(url, headers={"Authorization": f"Bearer {token}", "Accept": "application/json"})
    for left in range(attempts - 1, -1, -1):
        try:
            with urllib.request.urlopen(request, timeout=20) as answer:
                return json.loads(answer.read())
        except (urllib.error.URLError, TimeoutError) as error:
            if left == 0:
                raise RuntimeError(f"the API did not answer: {error}") from error
            time.sleep(pause)
            pause *= 2
    raise RuntimeError("no attempt was allowed")


def page_url(options: dict, page: int, size: int) -> str:
    query = {"page": page, "page_size": size, "as_of": options.get("as_of") or FAR}
    if options.get("updated_since"):
        query["updated_since"] = options["updated_since"]
    return f"{options['url']}/v1/responses?{urllib.parse.urlencode(query)}"


def available(url: str, token: str, as_of: str | None = None, updated_since: str | None = None) -> int:
    """How many rows a scan would read: a question for one row and the total."""
    asked = page_url({"url": url, "as_of": as_of, "updated_since": updated_since}, 1, 1)
    return int(fetch(asked, token)["pagination"]["total_records"])


def instant(text: str) -> datetime:
    return datetime.fromisoformat(text.replace("Z", "+00:00")).astimezone(UTC)


def as_row(event: dict) -> tuple:
    """An event's declared fields, and as `wrong` the names of those that are there with another type.

    A score must be a whole JSON number (true and 9.0 are none), an instant must have a
    zone; such a field is null and its row is quarantined, it fails no load.
    """
    out, wrong = [], []
    for name in EVENT_FIELDS:
        value, fits = event.get(name), True
        if value is None or value == "":
            value = None if name in _INSTANTS | _NUMBERS else value
        elif name in _INSTANTS:
            value, why = read_instant(value)
            fits = why is None
        elif name in _NUMBERS:
            if name == "event_version" and isinstance(value, str) and value.isdecimal():
                value = int(value)
            fits = type(value) is int and abs(value) < 1 << 63
            value = value if fits else None
        elif not isinstance(value, str):
            value = json.dumps(value)
        out.append(value)
        if not fits:
            wrong.append(name)
    return (*out, ",".join(wrong) or None)


class Page(InputPartition):
    def __init__(self, number: int) -> None:
        self.number = number


class PagedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = dict(options)
        self.size = int(options.get("page_size", 250))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """The API's bounds are (since, until], in whole seconds: they read no less, and Spark filters again."""
        low, high = [], []
        for f in filters:
            if getattr(f, "attribute", None) == ("updated_at",) and isinstance(getattr(f, "value", None), datetime):
                at = f.value if f.value.tzinfo else f.value.replace(tzinfo=UTC)
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    low.append(at - timedelta(seconds=1))
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    high.append(at + timedelta(seconds=1))
            yield f
        if low:
            since = self.options.get("updated_since")
            self.options["updated_since"] = iso(max([*low, instant(since)] if since else low))
        if high:
            until = self.options.get("as_of")
            self.options["as_of"] = iso(min([*high, instant(until)] if until else high))

    def partitions(self) -> list[Page]:
        total = available(self.options["url"], self.options.get("token", ""), self.options.get("as_of"), self.options.get("updated_since"))
        return [Page(n) for n in range(1, max(1, -(-total // self.size)) + 1)]

    def read(self, partition: Page) -> Iterator[tuple]:
        got = fetch(page_url(self.options, partition.number, self.size), self.options.get("token", ""), int(self.options.get("attempts", 3)))
        for place, event in enumerate(got.get("data", [])):
            yield (*as_row(event), partition.number, place)


class PagedStream(DataSourceStreamReader):
    """Offsets are update times. Every batch reads again from `overlap` minutes before the last.

    The API gives its rows in order of update, so its last page tells how far it goes.
    """

    def __init__(self, options: dict) -> None:
        self.options = dict(options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"updated_at": self.options.get("updated_since") or ""}

    def latestOffset(self) -> dict:  # noqa: N802
        reader = PagedReader(self.options)
        last = reader.partitions()[-1].number
        got = fetch(page_url(reader.options, last, reader.size), self.options.get("token", ""))
        times = [t for e in got.get("data", []) if (t := read_instant(e.get("updated_at"))[0])]
        return {"updated_at": iso(max(times) + timedelta(microseconds=999_999))} if times else self.initialOffset()

    def _reader(self, start: dict, end: dict) -> PagedReader:
        options = self.options | {"as_of": end["updated_at"], "updated_since": ""}
        if start["updated_at"]:
            options["updated_since"] = iso(instant(start["updated_at"]) - timedelta(minutes=int(self.options.get("overlap", 5))))
        return PagedReader(options)

    def partitions(self, start: dict, end: dict) -> list[Page]:
        if start["updated_at"] == end["updated_at"]:
            return []
        reader = self._reader(start, end)
        pages = reader.partitions()
        for page in pages:
            page.options = reader.options
        return pages

    def read(self, partition: Page) -> Iterator[tuple]:
        return PagedReader(partition.options).read(partition)


def iso(value: datetime) -> str:
    return value.astimezone(UTC).replace(microsecond=0).isoformat().replace("+00:00", "Z")


class PagedResponses(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_responses"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)

    def streamReader(self, schema) -> PagedStream:  # noqa: N802
        return PagedStream(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # a reader that takes filters needs it
    spark.dataSource.register(PagedResponses)
