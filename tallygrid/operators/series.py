"""Stored time series: upsert, reading, paging and retention."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame, Window, functions as F

from tallygrid.fixed_values import AGGREGATE_RETENTION_DAYS, EVENT_RETENTION_DAYS, PAGE_LIMITS
from tallygrid.functions.times import Instant, at, literal_time
from tallygrid.operators.filters import browse_filter, check_limit, in_window, top_per_group

SERIES_KEY = ["client_id", "metric_name", "interval_start"]


def fold_updates(updates: DataFrame, order: str = "updated_at") -> DataFrame:
    """One row per key: the first update creates the row, the last one sets its value.

    Updates with equal ``order`` (a time, or a sequence number if the source has one) are told apart by
    their content, so the result does not depend on the order of rows.
    """
    return updates.groupBy(*SERIES_KEY).agg(
        F.min(F.struct(order, "interval_end"))["interval_end"].alias("interval_end"),
        F.max(F.struct(order, "value", "meta_data")).alias("last"),
        F.min("created_at").alias("created_at"),
        F.max("updated_at").alias("updated_at"),
    ).select(*SERIES_KEY, "interval_end", "last.value", "last.meta_data", "created_at", "updated_at")


def upsert_aggregates(
    target: DataFrame, updates: DataFrame, replace: tuple[str, ...] = ("value", "meta_data", "updated_at")
) -> DataFrame:
    """``target`` with ``updates`` applied on (tenant, metric, interval start).

    An existing row takes the ``replace`` columns and keeps the rest (created_at, interval_end);
    pass ``("value",)`` to replace the value only.
    """
    new = fold_updates(updates).withColumn("is_new", F.lit(True))
    old = target.withColumn("is_old", F.lit(True))
    joined = old.alias("old").join(new.alias("new"), SERIES_KEY, "full_outer")
    columns = [c for c in target.columns if c in new.columns and c not in SERIES_KEY]
    merged = []
    for name in columns:
        use_new = F.col("new.is_new") if name in replace else F.col("old.is_old").isNull()
        merged.append(F.when(use_new, F.col(f"new.{name}")).otherwise(F.col(f"old.{name}")).alias(name))
    return joined.select(*SERIES_KEY, *merged)


def _points(aggregates: DataFrame, metric: str, start: Instant, end: Instant, client_id: str | None) -> DataFrame:
    """Points of one metric with ``start < interval_start < end``; a point at ``start`` is out."""
    keep = (
        (F.col("metric_name") == metric)
        & (F.col("interval_start") > literal_time(start))
        & (F.col("interval_start") < literal_time(end))
    )
    if "interval_date" in aggregates.columns:
        keep = F.col("interval_date").between(F.lit(at(start).date()), F.lit(at(end).date())) & keep
    if client_id is not None:
        keep = (F.col("client_id") == client_id) & keep
    return aggregates.filter(keep).select(
        "client_id", F.col("interval_start").alias("timestamp"), "value", "meta_data"
    )


def time_series(
    aggregates: DataFrame,
    metric: str,
    end: Instant,
    start: Instant | None = None,
    client_id: str | None = None,
    limit: int = 1000,
    ordered: bool = True,
) -> DataFrame:
    """The first ``limit`` points in time order, per tenant; the default range is one hour. For all tenants, the
    rows come sorted unless ``ordered`` is off (a caller that goes on with them needs no global sort)."""
    check_limit("limit", limit, PAGE_LIMITS)
    begin = at(end) - timedelta(hours=1) if start is None else start
    points = _points(aggregates, metric, begin, end, client_id)
    if client_id is not None:
        return points.orderBy("timestamp").limit(limit)
    first = top_per_group(points, ["client_id"], [F.asc("timestamp")], limit).drop("rank")
    return first.orderBy("client_id", "timestamp") if ordered else first


def encode_cursor(timestamp: Instant) -> str:
    payload = json.dumps({"timestamp": at(timestamp).isoformat()})
    return base64.b64encode(payload.encode()).decode()


def decode_cursor(cursor: str | None) -> Instant | None:
    """The instant in a cursor, or None when it cannot be read."""
    if not cursor:
        return None
    try:
        return at(json.loads(base64.b64decode(cursor))["timestamp"])
    except (ValueError, KeyError, TypeError, AttributeError):
        return None


@dataclass(frozen=True)
class SeriesPage:
    items: list
    next_cursor: str | None
    has_next: bool

    @property
    def count(self) -> int:
        return len(self.items)


def series_page_rows(
    aggregates: DataFrame,
    metric: str,
    client_id: str,
    end: Instant,
    start: Instant | None = None,
    cursor: str | None = None,
    limit: int = 100,
) -> DataFrame:
    """The page and one row beyond it. A readable cursor replaces ``start``."""
    check_limit("limit", limit, PAGE_LIMITS)
    begin = decode_cursor(cursor) or (at(end) - timedelta(hours=1) if start is None else start)
    return _points(aggregates, metric, begin, end, client_id).orderBy("timestamp").limit(limit + 1)


def time_series_page(aggregates: DataFrame, metric: str, client_id: str, end: Instant, **page) -> SeriesPage:
    """One keyset page, at most 1000 rows, with the cursor of the next one."""
    limit = page.get("limit", 100)
    micros = F.unix_micros("timestamp").alias("micros")
    rows = series_page_rows(aggregates, metric, client_id, end, **page).select("*", micros).collect()
    items, has_next = rows[:limit], len(rows) > limit
    cursor = None
    if has_next:
        cursor = encode_cursor(at("1970-01-01") + timedelta(microseconds=items[-1]["micros"]))
    return SeriesPage(items, cursor, has_next)



def events_page(
    df: DataFrame,
    end: Instant,
    start: Instant | None = None,
    client_id: str | None = None,
    event_name: str | None = None,
    user_id: str | None = None,
    page: int = 1,
    page_size: int = 100,
) -> DataFrame:
    """One page of events, newest first; ties by falling id. The default range is 24 hours.

    The page is located by event counts per minute first and only its own minutes are sorted, so
    no task keeps ``offset`` rows. Locating runs one small job when the query is built.
    """
    check_limit("page_size", page_size, PAGE_LIMITS)
    if page < 1:
        raise ValueError("page starts at 1")
    rows = _page_source(df, end, start, client_id, event_name, user_id)
    rows, offset = _locate(rows, (page - 1) * page_size, page_size)
    newest = rows.orderBy(F.desc("event_time"), F.desc("id"))
    return newest.offset(offset).limit(page_size)


def _page_source(df, end, start, client_id, event_name, user_id) -> DataFrame:
    begin = at(end) - timedelta(hours=24) if start is None else start
    return browse_filter(in_window(df, begin, end, client_id), event_name, user_id)


def _locate(rows: DataFrame, offset: int, size: int) -> tuple[DataFrame, int]:
    """Rows of the minutes that hold ranks offset+1 .. offset+size, and the rest of the offset."""
    minute = F.floor(F.unix_seconds("event_time") / 60)
    counts = rows.groupBy(minute.alias("minute")).agg(F.count("*").alias("n"))
    # one row per minute of the asked range: bounded by the calendar, not by the events
    newer = F.sum("n").over(Window.orderBy(F.desc("minute"))) - F.col("n")
    located = counts.withColumn("newer", newer).filter(
        (F.col("newer") + F.col("n") > offset) & (F.col("newer") < offset + size)
    )
    span = located.agg(
        F.min("minute").alias("low"), F.max("minute").alias("high"), F.min("newer").alias("skipped")
    ).first()
    if span["low"] is None:
        return rows.limit(0), 0
    low, high = (F.timestamp_seconds(F.lit(m * 60)) for m in (span["low"], span["high"] + 1))
    inside = rows.filter((F.col("event_time") >= low) & (F.col("event_time") < high))
    return inside, offset - span["skipped"]


def events_page_info(
    df: DataFrame,
    end: Instant,
    start: Instant | None = None,
    client_id: str | None = None,
    event_name: str | None = None,
    user_id: str | None = None,
    page: int = 1,
    page_size: int = 100,
) -> DataFrame:
    """One row: total, page, page_size, total_pages, has_next, has_prev."""
    check_limit("page_size", page_size, PAGE_LIMITS)
    total = _page_source(df, end, start, client_id, event_name, user_id).agg(F.count("*").alias("total"))
    pages = F.ceil(F.col("total") / page_size)
    return total.select(
        "total",
        F.lit(page).alias("page"),
        F.lit(page_size).alias("page_size"),
        pages.alias("total_pages"),
        (F.lit(page) < pages).alias("has_next"),
        F.lit(page > 1).alias("has_prev"),
    )


def prune_aggregates(aggregates: DataFrame, as_of: Instant, days: int = AGGREGATE_RETENTION_DAYS) -> DataFrame:
    """Rows that retention keeps; a row exactly at the cut-off stays."""
    return _prune(aggregates, "interval_start", "interval_date", as_of, days)


def prune_events(events: DataFrame, as_of: Instant, days: int = EVENT_RETENTION_DAYS) -> DataFrame:
    """Events that retention keeps; an event exactly at the cut-off stays."""
    return _prune(events, "event_time", "event_date", as_of, days)


def _prune(df: DataFrame, column: str, date_column: str, as_of: Instant, days: int) -> DataFrame:
    cutoff = at(as_of) - timedelta(days=days)
    if date_column in df.columns:
        df = df.filter(F.col(date_column) >= F.lit(cutoff.date()))
    return df.filter(F.col(column) >= literal_time(cutoff))
