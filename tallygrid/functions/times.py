"""Time helpers. Every time is UTC and passed in; no query reads the clock."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone
from typing import Mapping

from pyspark.sql import Column, functions as F

Instant = str | datetime


def at(value: Instant) -> datetime:
    """Any accepted instant as an aware UTC datetime (naive input is taken as UTC)."""
    parsed = datetime.fromisoformat(value) if isinstance(value, str) else value
    if parsed.tzinfo is None:
        return parsed.replace(tzinfo=timezone.utc)
    return parsed.astimezone(timezone.utc)


def literal_time(value: Instant) -> Column:
    """Timestamp literal that does not depend on the zone of the driver or session."""
    since_epoch = at(value) - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return F.timestamp_micros(F.lit(since_epoch // timedelta(microseconds=1)).cast("bigint"))


def day_of(value: Instant) -> date:
    return at(value).date()


def window_bounds(period: str, as_of: Instant, periods: Mapping[str, timedelta]) -> tuple[datetime, datetime]:
    """``[start, end)`` of a named period that ends at ``as_of``; unknown names raise."""
    if period not in periods:
        raise ValueError(f"unknown period {period!r}, expected one of {', '.join(periods)}")
    end = at(as_of)
    return end - periods[period], end


def parse_time(text: Column) -> Column:
    """ISO text, or epoch seconds / milliseconds as a number; NULL if it is neither.

    Numbers above 2e10 in size are milliseconds. Text without an offset is UTC.
    """
    number = F.when(text.rlike(r"^[+-]?\d+(\.\d+)?$"), text.cast("double"))
    seconds = F.when(F.abs(number) > F.lit(2e10), number / 1000).otherwise(number)
    from_number = F.timestamp_micros(F.round(seconds * 1000000).cast("bigint"))
    iso = F.when(text.rlike(r"^\s*\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(text))
    return F.coalesce(from_number, iso)


def floor_time(moment: Column, seconds: int) -> Column:
    """Start of the UTC interval of ``seconds`` length that contains ``moment``."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(moment) / seconds) * seconds)


def iso_text(moment: Column) -> Column:
    """ISO 8601 text in UTC, with microseconds only when there are any."""
    whole = F.unix_micros(moment) % 1000000 == 0
    return F.when(whole, F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ssxxx")).otherwise(iso_micros(moment))


def iso_micros(moment: Column) -> Column:
    """ISO 8601 text in UTC, always with six digits after the second."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
