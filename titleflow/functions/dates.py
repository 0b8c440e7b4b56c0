"""Dates and times. The session time zone is UTC; ``now`` is always an argument."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

Moment = Column | dt.datetime

_DAY = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
_RFC3339 = (
    r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})\z"
)
_RFC1123 = (
    r"\A(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun), "
    r"([0-9]{2} [A-Z][a-z]{2} [0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2}) (?:([A-Z]{3,5})|([+-][0-9]{4}))\z"
)

COOLDOWN_HOURS = 6
FRESH_HOURS = 24


def moment(value: Moment) -> Column:
    """A timestamp column of a column or of a Python time, which is UTC if it has no zone."""
    if isinstance(value, Column):
        return value.cast("timestamp")
    if value.tzinfo is not None:
        value = value.astimezone(dt.timezone.utc)
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f") + "Z").cast("timestamp")


def parse_day(text: Column) -> Column:
    """``yyyy-MM-dd`` as midnight UTC; anything else is missing."""
    return F.when(text.rlike(_DAY), text.try_cast("date")).cast("timestamp")


def parse_rfc3339(text: Column) -> Column:
    return F.when(text.rlike(_RFC3339), text.try_cast("timestamp"))


def parse_stored_date(text: Column) -> Column:
    return F.coalesce(parse_rfc3339(text), parse_day(text))


def parse_feed_date(text: Column) -> Column:
    """RFC 1123 with a zone name (read as UTC) or a numeric zone; else missing."""
    clock = F.regexp_extract(text, _RFC1123, 1)
    zone = F.regexp_extract(text, _RFC1123, 3)
    offset = F.when(zone == "", "+0000").otherwise(zone)
    stamp = F.concat_ws(" ", clock, offset)
    return F.when(
        clock != "", F.try_to_timestamp(stamp, F.lit("dd MMM yyyy HH:mm:ss Z"))
    )


def rfc3339(stamp: Column) -> Column:
    return F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def epoch_time(seconds: Column) -> Column:
    """Whole seconds since 1970, fraction cut."""
    return F.timestamp_seconds(seconds.cast("bigint"))


def months_before(now: Moment, months: int) -> Column:
    """The date ``months`` back. Days past the month's end run over into the next month."""
    day = F.to_date(moment(now))
    return F.date_add(F.add_months(F.trunc(day, "MM"), -months), F.dayofmonth(day) - 1)


def younger_than(stamp: Column, now: Moment, hours: int) -> Column:
    """True where ``stamp`` lies less than ``hours`` before ``now``; false where missing."""
    age = F.unix_micros(moment(now)) - F.unix_micros(stamp)
    return F.coalesce(age < hours * 3_600_000_000, F.lit(False))


def cooldown_remaining(requested_at: Column, now: Moment) -> Column:
    """Hours until a title may be requested again, one decimal, halves rounded up."""
    elapsed = (F.unix_millis(moment(now)) - F.unix_millis(requested_at)) / F.lit(3_600_000.0)
    return F.floor((F.lit(float(COOLDOWN_HOURS)) - elapsed) * 10 + 0.5) / F.lit(10.0)


def released_before(release_date: Column, now: Moment) -> Column:
    """Known release day before today; a title released today is not out yet."""
    return release_date.isNotNull() & (F.to_date(release_date) < F.to_date(moment(now)))
