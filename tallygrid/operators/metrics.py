"""Event metrics over all tenants at once.

Hot tenants are safe throughout: every ``groupBy`` here has map-side partial aggregation, the
distinct counts are first collapsed on ``(tenant, ..., user)``, and ranks are cut to n rows per
map task before their shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallygrid.fixed_values import (
    BREAKDOWN_LIMITS,
    BREAKDOWN_PROPERTIES,
    FUNNEL_STEPS,
    OVERVIEW_PERIODS,
    TOP_EVENTS_LIMITS,
)
from tallygrid.functions.times import Instant, at, literal_time, window_bounds
from tallygrid.operators.filters import (
    active_keys,
    browse_filter,
    check_limit,
    in_window,
    known_users,
    top_per_group,
    with_idle_tenants,
)


def _rate(count: Column, start: Instant, end: Instant) -> Column:
    minutes = (at(end) - at(start)).total_seconds() / 60
    return F.round(count / F.lit(minutes), 2) if minutes > 0 else F.lit(0.0)


def _percent(part: Column, whole: Column) -> Column:
    return F.round(part / whole * 100, 2)


def event_rate(df: DataFrame, start: Instant, end: Instant, registry: DataFrame | None = None) -> DataFrame:
    """Events and events per minute per tenant: client_id, count, rate, bounds."""
    counted = in_window(df, start, end).groupBy("client_id").agg(F.count("*").alias("count"))
    counted = with_idle_tenants(counted, registry, {"count": F.lit(0).cast("bigint")})
    return counted.select(
        "client_id",
        "count",
        _rate(F.col("count"), start, end).alias("rate"),
        literal_time(start).alias("interval_start"),
        literal_time(end).alias("interval_end"),
    )


def active_users(
    df: DataFrame,
    start: Instant,
    end: Instant,
    registry: DataFrame | None = None,
    approximate: bool = False,
) -> DataFrame:
    """Distinct known users per tenant; exact unless ``approximate`` is asked for."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    users = in_window(df, start, end).groupBy("client_id").agg(count("user_id").alias("active_users"))
    return with_idle_tenants(users, registry, {"active_users": F.lit(0).cast("bigint")})


def _name_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys, "event_name").agg(F.count("*").alias("count"))


def rank_names(counts: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Top ``n`` names per group; the percentage is of the returned rows only."""
    ranked = top_per_group(counts, keys, [F.desc("count"), F.asc("event_name")], n)
    returned = F.sum("count").over(Window.partitionBy(*keys))
    return ranked.withColumn("percentage", _percent(F.col("count"), returned))


def top_events(df: DataFrame, start: Instant, end: Instant, n: int = 10) -> DataFrame:
    """Most frequent event names per tenant: client_id, event_name, count, rank, percentage."""
    check_limit("n", n, TOP_EVENTS_LIMITS)
    return rank_names(_name_counts(in_window(df, start, end), "client_id"), ["client_id"], n)


def event_type_count(df: DataFrame, start: Instant, end: Instant) -> DataFrame:
    """Distinct event names per tenant."""
    return (
        in_window(df, start, end)
        .groupBy("client_id")
        .agg(F.count_distinct("event_name").alias("unique_event_types"))
    )


def overview(
    df: DataFrame, period: str = "last_hour", *, as_of: Instant, registry: DataFrame | None = None
) -> DataFrame:
    """Dashboard head line per tenant.

    Totals, type count and top five all come from one (tenant, name) aggregation, whose shuffle
    is reused; only the distinct users need a second, narrow pass over the window.
    """
    start, end = window_bounds(period, as_of, OVERVIEW_PERIODS)
    window = in_window(df, start, end)
    names = _name_counts(window, "client_id")
    totals = names.groupBy("client_id").agg(
        F.sum("count").alias("total_events"), F.count("*").alias("unique_event_types")
    )
    users = window.groupBy("client_id").agg(F.count_distinct("user_id").alias("active_users"))
    five = (
        rank_names(names, ["client_id"], 5)
        .groupBy("client_id")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "event_name", "count", "percentage"))).alias("five"))
    )
    zero = F.lit(0).cast("bigint")
    joined = totals.join(users, "client_id").join(five, "client_id")
    joined = with_idle_tenants(
        joined,
        registry,
        {
            "total_events": zero,
            "unique_event_types": zero,
            "active_users": zero,
            "five": F.expr("array()").cast(joined.schema["five"].dataType),
        },
    )
    return joined.select(
        "client_id",
        F.lit(period).alias("period"),
        "total_events",
        _rate(F.col("total_events"), start, end).alias("events_per_minute"),
        "active_users",
        "unique_event_types",
        F.transform(
            "five", lambda e: F.struct(e["event_name"], e["count"], e["percentage"])
        ).alias("top_events"),
        literal_time(start).alias("start_time"),
        literal_time(end).alias("end_time"),
    )


def breakdown_properties() -> list[str]:
    """Names accepted by ``breakdown``, sorted."""
    return sorted(BREAKDOWN_PROPERTIES)


def breakdowns(
    df: DataFrame,
    props: Sequence[str],
    start: Instant,
    end: Instant,
    event_name: str | None = None,
    n: int = 12,
    allowed: Sequence[str] = BREAKDOWN_PROPERTIES,
) -> DataFrame:
    """Several property breakdowns in one scan and one shuffle.

    The JSON text is parsed once per row whatever the number of properties. Rows without a
    property are left out of its breakdown; percentage and total cover the returned rows only.
    """
    for prop in props:
        if prop not in allowed:
            raise ValueError(f"property {prop!r} is not available for breakdown")
    check_limit("n", n, BREAKDOWN_LIMITS)
    rows = browse_filter(in_window(df, start, end), event_name=event_name)
    fields = [f"label_{i}" for i in range(len(props))]
    parsed = rows.select("client_id", "user_id", F.json_tuple("properties", *props).alias(*fields))
    pairs = [column for prop, field in zip(props, fields) for column in (F.lit(prop), F.col(field))]
    labelled = parsed.select("client_id", "user_id", F.stack(F.lit(len(props)), *pairs).alias("property", "label")).filter(
        F.col("label").isNotNull()
    )
    counted = labelled.groupBy("client_id", "property", "label").agg(
        F.count("*").alias("count"), F.count_distinct("user_id").alias("users")
    )
    keys = ["client_id", "property"]
    ranked = top_per_group(counted, keys, [F.desc("count"), F.asc("label")], n)
    returned = F.sum("count").over(Window.partitionBy(*keys))
    return ranked.select(
        "client_id", "property", "rank", "label", "count", "users",
        _percent(F.col("count"), returned).alias("percentage"),
        returned.alias("total"),
    )


def breakdown(
    df: DataFrame,
    prop: str,
    start: Instant,
    end: Instant,
    event_name: str | None = None,
    n: int = 12,
    allowed: Sequence[str] = BREAKDOWN_PROPERTIES,
) -> DataFrame:
    """Events grouped by one JSON property: label, count, users, percentage, total."""
    return breakdowns(df, [prop], start, end, event_name, n, allowed)


def funnel(
    df: DataFrame,
    steps: Sequence[str],
    start: Instant,
    end: Instant,
    registry: DataFrame | None = None,
) -> DataFrame:
    """Distinct users who reached each step and every step before it, in any time order.

    One pass: a bit per step and user, then one count per prefix of steps. No user id leaves
    the executors. Tenants without any user on any step appear (as zeros) if a registry is given.
    """
    check_limit("number of steps", len(steps), FUNNEL_STEPS)
    bit = F.lit(0)
    for i, step in enumerate(steps):
        bit = bit.bitwiseOR(F.when(F.col("event_name") == step, 1 << i).otherwise(0))
    touched = known_users(in_window(df, start, end)).filter(F.col("event_name").isin(*set(steps)))
    per_user = touched.groupBy("client_id", "user_id").agg(F.bit_or(bit).alias("reached"))

    reached = []
    for i in range(len(steps)):
        prefix = (1 << (i + 1)) - 1
        reached.append(F.count_if(F.col("reached").bitwiseAND(F.lit(prefix)) == prefix).alias(f"users_{i}"))
    per_tenant = per_user.groupBy("client_id").agg(*reached)
    zero = F.lit(0).cast("bigint")
    per_tenant = with_idle_tenants(per_tenant, registry, {f"users_{i}": zero for i in range(len(steps))})

    first, last = F.col("users_0"), F.col(f"users_{len(steps) - 1}")
    share = lambda part, whole: F.when(whole > 0, _percent(part, whole)).otherwise(0.0)
    rows = []
    for i, step in enumerate(steps):
        users = F.col(f"users_{i}")
        before = F.col(f"users_{i - 1}") if i else None
        rows.append(
            F.struct(
                F.lit(i + 1).alias("step_number"),
                F.lit(step).alias("step"),
                users.alias("users"),
                share(users, first).alias("conversion_from_start"),
                (share(users, before) if i else F.lit(100.0)).alias("conversion_from_previous"),
                (before - users if i else zero).alias("dropped"),
                share(last, first).alias("overall_conversion"),
            )
        )
    return per_tenant.select("client_id", F.inline(F.array(*rows)))


def dataset_summary(df: DataFrame, as_of: Instant) -> DataFrame:
    """Whole-table figures as rows (section, name, value), names by falling count."""
    recent = F.col("event_time") > literal_time(as_of) - F.expr("INTERVAL 1 HOUR")
    names = df.groupBy("event_name").agg(F.count("*").alias("count"), F.count_if(recent).alias("recent"))
    scalars = names.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("total"), F.coalesce(F.sum("recent"), F.lit(0)).alias("recent")
    ).selectExpr("stack(2, 'events_total', total, 'last_hour', recent) AS (section, value)")
    users = df.agg(F.count_distinct("user_id").alias("value")).select(F.lit("unique_users").alias("section"), "value")
    figures = scalars.unionByName(users).select("section", F.lit("").alias("name"), "value")
    per_name = names.select(
        F.lit("event_name").alias("section"), F.col("event_name").alias("name"), F.col("count").alias("value")
    )
    return figures.unionByName(per_name).orderBy("section", F.desc("value"), "name")


def platform_counts(events: DataFrame, registry: DataFrame, rules: DataFrame) -> DataFrame:
    """One row: all events, active tenants, enabled rules."""
    parts = [
        ("total_events", events),
        ("active_clients", active_keys(registry)),
        ("active_alerts", rules.filter(F.col("enabled"))),
    ]
    counted = None
    for name, frame in parts:
        one = frame.agg(F.count("*").alias("n")).select(F.lit(name).alias("figure"), "n")
        counted = one if counted is None else counted.unionByName(one)
    return counted.agg(*[F.max(F.when(F.col("figure") == name, F.col("n"))).alias(name) for name, _ in parts])


def share_of_total(
    items: DataFrame,
    keys: Sequence[str] = ("client_id",),
    total: str | None = None,
    keep: int | None = None,
) -> DataFrame:
    """Adds ``share``: count as a percentage of the group's total, one decimal.

    ``total`` names a column that already holds the total; a missing or zero total falls back
    to the sum of the items, and an empty sum to 1. ``keep`` first cuts each group to its
    largest items.
    """
    keys = list(keys)
    if keep is not None:
        items = top_per_group(items, keys, [F.desc("count"), F.asc("label")], keep, "position").drop("position")
    # sums are joined back rather than windowed, so no group has to fit one task
    sums = items.groupBy(*keys).agg(F.sum("count").alias("items_sum"))
    given = F.nullif(F.col(total), F.lit(0)) if total else F.lit(None).cast("bigint")
    whole = F.coalesce(given, F.nullif(F.col("items_sum"), F.lit(0)), F.lit(1))
    return items.join(sums, keys).withColumn("share", F.round(F.col("count") / whole * 100, 1)).drop("items_sum")


def last_seen(events: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(client_id, last_used) of a load of events, folded into what was known ``before`` it."""
    seen = events.select("client_id", F.col("received_at").alias("last_used"))
    rows = seen if before is None else seen.unionByName(before.select("client_id", "last_used"))
    return rows.groupBy("client_id").agg(F.max("last_used").alias("last_used"))


def key_usage(events: DataFrame, registry: DataFrame, day: Instant, seen: DataFrame | None = None) -> DataFrame:
    """Per key: events received on ``day`` and the time of the last one.

    The day's count reads that day only. ``seen`` is a table kept up per load with ``last_seen``; without
    it the time of the last event is taken from the whole history (two columns).
    """
    start = at(day).replace(hour=0, minute=0, second=0, microsecond=0)
    today = in_window(events, start, start + timedelta(days=1), column="received_at")
    used = today.groupBy("client_id").agg(F.count("*").alias("requests_today"))
    seen = last_seen(events) if seen is None else seen
    named = registry.withColumn("client_id", F.col("id"))
    return named.join(used, "client_id", "left").join(seen, "client_id", "left").select(
        "id",
        "client_name",
        "rate_limit",
        F.coalesce("requests_today", F.lit(0)).alias("requests_today"),
        "last_used",
    )
