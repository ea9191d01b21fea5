"""Text, instants and digests as column functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

INVISIBLE = "[\u200b-\u200d\ufeff]"
#: White space of either regular expression family, so that a following trim of spaces strips it all.
SPACES = "(?:[\\x1c-\\x1f]|(?U:\\s))+"
_ZONED = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})$"


def _composer():
    """Unicode composition (NFC); built on first use, as a UDF needs a session."""

    def compose(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in arrays:
            yield pa.array([None if x is None else unicodedata.normalize("NFC", x) for x in a.to_pylist()], pa.string())

    compose.__annotations__ = {"arrays": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(compose, "string")


def composed(c: Column) -> Column:
    """NFC; pure ASCII values, which are composed already, skip Python."""
    return F.coalesce(_composer()(F.when(~c.rlike(r"^\p{ASCII}*$"), c)), c)


def tidy(c: Column) -> Column:
    """Invisible characters out, each run of white space one space, both ends trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, INVISIBLE, ""), SPACES, " "))


def clean_text(c: Column) -> Column:
    return tidy(composed(c))


def is_identifier(c: Column) -> Column:
    """A string that is not empty and its own clean form; null is no identifier."""
    return F.coalesce((c != "") & (c == clean_text(c)), F.lit(False))


def read_instant(text: object) -> tuple[datetime | None, str | None]:
    """(instant, why there is none) of an ISO 8601 text with a zone, in any form that Python's own parser takes."""
    try:
        found = datetime.fromisoformat(text) if isinstance(text, str) else None
        if found is None or found.tzinfo is None:
            return None, "invalid_timestamp" if found is None else "timestamp_without_timezone"
        return found.astimezone(UTC), None
    except (ValueError, OverflowError):
        return None, "invalid_timestamp"


def _rare_forms(what: str):
    """The micros, or the reason, of texts in the forms that SQL doesn't read; built on first use."""

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in arrays:
            told = [(None, None) if x is None else read_instant(x) for x in a.to_pylist()]
            if what == "micros":
                yield pa.array([None if t is None else (t - EPOCH) // timedelta(microseconds=1) for t, _ in told], pa.int64())
            else:
                yield pa.array([why for _, why in told], pa.string())

    run.__annotations__ = {"arrays": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "long" if what == "micros" else "string")


EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def instant(c: Column) -> Column:
    """ISO 8601 text with a zone as a timestamp; null for any other text. The usual form skips Python."""
    usual = F.when(c.rlike(_ZONED), F.try_to_timestamp(c))
    return F.coalesce(usual, F.timestamp_micros(_rare_forms("micros")(F.when(usual.isNull(), c))))


def instant_reason(c: Column) -> Column:
    """Why instant() is null: no zone, or no instant at all."""
    usual = F.when(c.rlike(_ZONED), F.try_to_timestamp(c))
    why = _rare_forms("reason")(F.when(usual.isNull(), c))
    return F.when(c.isNull(), "invalid_timestamp").otherwise(why)


def iso_micros(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def iso_seconds(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def overlap_start(watermark: Column, minutes: int = 5) -> Column:
    """Where to read again from: the watermark's whole second less the overlap; null stays null."""
    return F.date_trunc("SECOND", watermark - F.expr(f"INTERVAL {int(minutes)} MINUTES"))


def json_string(c: Column) -> Column:
    """A string as JSON text; null as null."""
    quoted = F.to_json(F.struct(c.alias("v")))
    return F.when(c.isNull(), F.lit("null")).otherwise(F.substring(quoted, F.lit(6), F.length(quoted) - 6))


def json_object(fields: dict[str, Column]) -> Column:
    """Canonical JSON of fields whose values are JSON text: sorted names, no spaces."""
    parts: list[Column] = []
    for name in sorted(fields):
        parts += [F.lit(("," if parts else "{") + f'"{name}":'), fields[name]]
    return F.concat(*parts, F.lit("}"))


def digest(c: Column) -> Column:
    """SHA-256 of a text's UTF-8 bytes, as 64 hexadecimal digits."""
    return F.sha2(c.cast("binary"), 256)


def bounded_score(c: Column, low: int, high: int) -> Column:
    """The nearest whole number within [low, high]; halves go to the even one."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.bround(c).cast("int")))
