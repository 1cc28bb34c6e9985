"""Minute and hour roll-ups of the event table."""

from __future__ import annotations

from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallygrid.functions.times import Instant, at, floor_time, literal_time
from tallygrid.operators.filters import active_keys, in_window
from tallygrid.operators.metrics import rank_names

MINUTE, HOUR = 60, 3600


def _intervals(tick: Instant, seconds: int, count: int):
    """Bounds of the ``count`` whole intervals that ended at or before ``tick``."""
    moment = at(tick)
    end = moment - timedelta(seconds=moment.timestamp() % seconds)
    return end - timedelta(seconds=seconds * count), end


def _tenant_grid(registry: DataFrame, start: Instant, end: Instant, seconds: int) -> DataFrame:
    """Every active tenant at every interval start, so idle tenants get zero rows."""
    step = F.expr(f"INTERVAL {seconds} SECONDS")
    starts = F.sequence(literal_time(start), literal_time(end) - step, step)
    return active_keys(registry).select(F.col("id").alias("client_id"), F.explode(starts).alias("interval_start"))


def _with_interval(df: DataFrame, start: Instant, end: Instant, seconds: int) -> DataFrame:
    return in_window(df, start, end).withColumn("interval_start", floor_time(F.col("event_time"), seconds))


def _as_aggregates(wide: DataFrame, metrics: list[tuple[str, Column, Column]], seconds: int, at_time: Column) -> DataFrame:
    """One aggregate row per metric from one row per (tenant, interval)."""
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("metric_name"), value.cast("double").alias("value"), meta.alias("meta_data"))
            for name, value, meta in metrics
        ]
    )
    return wide.select("client_id", "interval_start", F.inline(rows)).select(
        "client_id",
        "metric_name",
        "interval_start",
        (F.col("interval_start") + F.expr(f"INTERVAL {seconds} SECONDS")).alias("interval_end"),
        "value",
        "meta_data",
        at_time.alias("created_at"),
        at_time.alias("updated_at"),
    )


def _count_meta() -> Column:
    return F.to_json(F.struct("count"))


def rollup_minute(df: DataFrame, registry: DataFrame, tick: Instant, intervals: int = 1) -> DataFrame:
    """The whole minutes just before ``tick`` for every active tenant, zeros included."""
    start, end = _intervals(tick, MINUTE, intervals)
    keys = ["client_id", "interval_start"]
    counted = _with_interval(df, start, end, MINUTE).groupBy(*keys).agg(
        F.count("*").alias("count"), F.count_distinct("user_id").alias("users")
    )
    grid = _tenant_grid(registry, start, end, MINUTE).join(counted, keys, "left").fillna(0, ["count", "users"])
    return minute_rows(grid, literal_time(tick))


def minute_rows(wide: DataFrame, at_time: Column) -> DataFrame:
    """Series rows of minutes with their ``count`` and ``users``."""
    rate = F.round(F.col("count") / F.lit(1.0), 2)
    return _as_aggregates(
        wide,
        [("events_per_minute", rate, _count_meta()), ("active_users_1m", F.col("users"), F.lit("{}"))],
        MINUTE,
        at_time,
    )


def rollup_hour(df: DataFrame, registry: DataFrame, tick: Instant, intervals: int = 1) -> DataFrame:
    """The whole hours just before ``tick`` for every active tenant, zeros included.

    The hourly value is the rounded per-minute rate times sixty, so one event gives 1.2.
    """
    start, end = _intervals(tick, HOUR, intervals)
    keys = ["client_id", "interval_start"]
    rows = _with_interval(df, start, end, HOUR)
    names = rank_names(rows.groupBy(*keys, "event_name").agg(F.count("*").alias("count")), keys, 10)
    # distinct users come as one row a user
    people = rows.filter("user_id IS NOT NULL").groupBy(*keys, "user_id").agg(F.lit(1).alias("one")).groupBy(*keys).agg(F.count("*").alias("users"))
    grid = _tenant_grid(registry, start, end, HOUR)
    return hour_rows(together(grid, rows.groupBy(*keys).agg(F.count("*").alias("count")), people, names), literal_time(tick))


def together(grid: DataFrame, counts: DataFrame, users: DataFrame, names: DataFrame) -> DataFrame:
    """Per interval of the grid its ``count``, ``users`` and ``ten`` ranked names, zeros included, by one shuffle."""
    keys = ["client_id", "interval_start"]
    entry = "struct<rank: int, event_name: string, count: bigint, percentage: double>"
    types = {"asked": "boolean", "count": "bigint", "users": "bigint", "name": entry}

    def part(rows: DataFrame, name: str, value: Column) -> DataFrame:
        return rows.select(*keys, *[(value if c == name else F.lit(None)).cast(kind).alias(c) for c, kind in types.items()])

    parts = [
        part(grid, "asked", F.lit(True)), part(counts, "count", F.col("count")), part(users, "users", F.col("users")),
        part(names, "name", F.struct("rank", "event_name", "count", "percentage")),
    ]
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(
        F.max("asked").alias("asked"), F.coalesce(F.sum("count"), F.lit(0)).alias("count"), F.coalesce(F.sum("users"), F.lit(0)).alias("users"),
        F.sort_array(F.collect_list("name")).alias("ten"),  # at most ten
    ).where("asked")


def hour_rows(wide: DataFrame, at_time: Column) -> DataFrame:
    """Series rows of hours with their ``count``, ``users`` and ``ten`` ranked names."""
    listed = F.transform("ten", lambda e: F.struct(e["event_name"], e["count"], e["percentage"]))
    return _as_aggregates(
        wide,
        [
            ("events_per_hour", F.round(F.col("count") / F.lit(60.0), 2) * 60, _count_meta()),
            ("active_users_1h", F.col("users"), F.lit("{}")),
            ("top_events_1h", F.size("ten"), F.to_json(F.struct(listed.alias("events")))),
        ],
        HOUR,
        at_time,
    )


BACKFILL_UNITS = (
    (MINUTE, timedelta(hours=6), "events_per_minute", "active_users_1m"),
    (HOUR, timedelta(days=30), "events_per_hour", "active_users_1h"),
)


def rollup_backfill(df: DataFrame, as_of: Instant) -> DataFrame:
    """Non-empty minutes of the last 6 hours and hours of the last 30 days.

    Values are the plain count and distinct users, meta is null; the lower bound is strict.
    """
    parts = None
    nothing = F.lit(None).cast("string")
    for seconds, reach, count_metric, user_metric in BACKFILL_UNITS:
        since = at(as_of) - reach
        recent = df.filter(F.col("event_time") > literal_time(since))
        if "event_date" in df.columns:
            recent = recent.filter(F.col("event_date") >= F.lit(since.date()))
        counted = recent.groupBy(
            "client_id", floor_time(F.col("event_time"), seconds).alias("interval_start")
        ).agg(F.count("*").alias("count"), F.count_distinct("user_id").alias("users"))
        part = _as_aggregates(
            counted,
            [(count_metric, F.col("count"), nothing), (user_metric, F.col("users"), nothing)],
            seconds,
            literal_time(as_of),
        )
        parts = part if parts is None else parts.unionByName(part)
    return parts
