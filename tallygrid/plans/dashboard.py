"""Everything one dashboard page shows, as one long frame over all tenants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tallygrid.fixed_values import DASHBOARD_PROPERTIES, OVERVIEW_PERIODS, SERIES_FOR_PERIOD
from tallygrid.functions.times import Instant, window_bounds
from tallygrid.operators.metrics import breakdowns, overview
from tallygrid.operators.series import time_series

PANEL_COLUMNS = ["client_id", "panel", "position", "label", "value", "users", "percentage"]


def dashboard_bundle(
    events: DataFrame,
    aggregates: DataFrame,
    period: str = "last_24h",
    *,
    as_of: Instant,
    props: Sequence[str] = DASHBOARD_PROPERTIES,
    allowed: Sequence[str] | None = None,
    registry: DataFrame | None = None,
) -> DataFrame:
    """Rows (client_id, panel, position, label, value, users, percentage); given the registry, idle tenants too.

    Panels: ``overview`` (four figures), ``top_events``, ``series`` in the granularity that fits
    the period, and one panel per property (six values each, all from a single scan).
    """
    start, end = window_bounds(period, as_of, OVERVIEW_PERIODS)
    head = overview(events, period, as_of=as_of, registry=registry)
    none_long, none_double = F.lit(None).cast("bigint"), F.lit(None).cast("double")

    figures = head.select(
        "client_id",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(i + 1).alias("position"), F.lit(name).alias("label"),
                             F.col(name).cast("double").alias("value"))
                    for i, name in enumerate(
                        ("total_events", "events_per_minute", "active_users", "unique_event_types")
                    )
                ]
            )
        ),
    ).select("client_id", F.lit("overview").alias("panel"), "position", "label", "value",
             none_long.alias("users"), none_double.alias("percentage"))

    top = head.select("client_id", F.posexplode("top_events").alias("place", "event")).select(
        "client_id", F.lit("top_events").alias("panel"), (F.col("place") + 1).alias("position"),
        F.col("event.event_name").alias("label"), F.col("event.count").cast("double").alias("value"),
        none_long.alias("users"), F.col("event.percentage").alias("percentage"),
    )

    points = time_series(aggregates, SERIES_FOR_PERIOD[period], end, start, ordered=False).select(
        "client_id", F.lit("series").alias("panel"), F.lit(None).cast("int").alias("position"),
        F.date_format("timestamp", "yyyy-MM-dd HH:mm").alias("label"), F.coalesce("value", F.lit(0.0)).alias("value"),
        none_long.alias("users"), none_double.alias("percentage"),
    )

    extra = {} if allowed is None else {"allowed": allowed}
    shares = breakdowns(events, props, start, end, n=6, **extra).select(
        "client_id", F.col("property").alias("panel"), F.col("rank").alias("position"), "label",
        F.col("count").cast("double").alias("value"), "users", "percentage",
    )
    return figures.unionByName(top).unionByName(points).unionByName(shares).select(*PANEL_COLUMNS)
