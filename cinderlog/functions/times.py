"""Timestamps and durations: one fixed shape, epoch numbers by size, and the three duration grammars."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_TIME = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?"
#: A timestamp in a line: a zone may follow at once, or a plausible offset after one space.
STAMP = DATE_TIME + r"(?:Z|[+-]\d{2}:?\d{2}| [+-](?:0\d|1[0-4]):?(?:00|15|30|45)(?=[ \]]|\z))?"
_SHAPE = r"\A\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?\s*(?:[Zz]|[+-](?:[01]\d|2[0-3]):?[0-5]\d)?\z"
_ZONE = r"([+-]\d{2}):?(\d{2})\z"


def read_timestamp(text: Column) -> Column:
    """The shape YYYY-MM-DD, T or a space, HH:MM:SS, an optional fraction and zone, read as UTC; null for all else. Digits past the sixth are dropped, a leap second reads as :59."""
    return F.transform(F.array(F.trim(text)), _read)[0]


def _read(t: Column) -> Column:
    rest = F.substring(t, 20, 100)
    fraction = F.rpad(F.substring(F.regexp_extract(rest, r"\A[.,](\d+)", 1), 1, 6), 6, "0")
    head = F.concat(F.substring(t, 1, 10), F.lit(" "), F.substring(t, 12, 6), F.when(F.substring(t, 18, 2) == "60", "59").otherwise(F.substring(t, 18, 2)), F.lit("."), fraction)
    local = F.when(t.rlike(_SHAPE), head.try_cast("timestamp_ntz"))
    hours, minutes = F.regexp_extract(rest, _ZONE, 1), F.regexp_extract(rest, _ZONE, 2)
    sign = F.when(hours.startswith("-"), -1).otherwise(1)
    east = F.when(hours == "", 0).otherwise(sign * (F.abs(hours.try_cast("int")) * 60 + minutes.try_cast("int")))
    return F.when(east == 0, local).otherwise(F.timestamp_add("MINUTE", -east, local))


def epoch_timestamp(number: Column) -> Column:
    """A Unix time whose size tells its unit: seconds, then thousandths each time."""
    size = F.abs(number.cast("double"))
    whole = number.try_cast("decimal(38,0)")
    is_whole = number.cast("string").rlike(r"\A-?\d+\z")
    scaled = F.when(size < 1e11, whole * 1_000_000).when(size < 1e14, whole * 1_000).when(size < 1e17, whole).otherwise(F.floor(whole / 1_000))
    value = number.cast("double")
    broken = F.round(F.when(size < 1e11, value * 1e6).when(size < 1e14, value * 1e3).when(size < 1e17, value).otherwise(value / 1e3))
    us = F.when(is_whole, scaled.try_cast("long")).otherwise(broken.try_cast("long"))
    return F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def rfc3339(ts: Column) -> Column:
    """UTC text with Z, and 0, 3 or 6 digits of fraction."""
    us = F.date_format(ts, "SSSSSS")
    head = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(us == "000000", F.concat(head, F.lit("Z"))).when(us.endswith("000"), F.concat(head, F.lit("."), F.substring(us, 1, 3), F.lit("Z"))).otherwise(F.concat(head, F.lit("."), us, F.lit("Z")))


def without_leap_second(text: Column) -> Column:
    return F.regexp_replace(text, r"(\d{2}:\d{2}):60", r"$1:59")


class BadDuration(ValueError):
    pass


def search_duration(text: str) -> timedelta:
    """``30s``, ``2m``, ``1h``, ``3d``: whole numbers."""
    m = re.fullmatch(r"\s*(\d+)\s*([smhd])\s*", text.lower())
    if not m:
        raise BadDuration(f"not a duration: {text!r}")
    return timedelta(**{{"s": "seconds", "m": "minutes", "h": "hours", "d": "days"}[m[2]]: int(m[1])})


def window_duration(text: str) -> timedelta:
    """``500ms``, ``1.5m``, ``2h``: fractions too, above zero."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*(ms|s|m|h)\s*", text)
    if not m or float(m[1]) <= 0:
        raise BadDuration(f"not a window: {text!r}")
    return timedelta(milliseconds=float(m[1]) * {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000}[m[2]])


def bucket_micros(text: str) -> int:
    """The width of ``\\d+(ms|s|m|h)`` in microseconds."""
    m = re.fullmatch(r"\s*(\d+)\s*(ms|s|m|h)\s*", text)
    if not m or int(m[1]) == 0:
        raise BadDuration(f"not a bucket: {text!r}")
    return int(m[1]) * {"ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000}[m[2]]


def time_bound(text: str | None, now: datetime | None = None) -> datetime | None:
    """An ISO time (no zone: UTC) or a time before ``now`` such as ``-1h``, as a zone-less UTC time."""
    if not text:
        return None
    if text.startswith("-"):
        if now is None:
            raise BadDuration("a relative time needs a 'now'")
        return (now.astimezone(UTC).replace(tzinfo=None) if now.tzinfo else now) - search_duration(text[1:])
    read = datetime.fromisoformat(re.sub(r"(\d{2}:\d{2}):60", r"\1:59", text.replace(",", ".")))
    return read.astimezone(UTC).replace(tzinfo=None) if read.tzinfo else read
