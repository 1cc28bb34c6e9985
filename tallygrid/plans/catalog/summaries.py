"""Sketches, sessions and trailing counts."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from tallygrid.functions.jsonprops import json_property
from tallygrid.operators import metrics, sessions, sketches, trailing
from tallygrid.plans.catalog.common import AS_OF, query
from tallygrid.session import new_run_dir
from tallygrid.sources import adapter
from tallygrid.sources.storage import with_interval_date

T = f"TIMESTAMP '{AS_OF}'"
MONTH, WEEK = "2024-01-01", "2024-01-24"
IN_WEEK = f"event_time >= TIMESTAMP '{WEEK}' AND event_time < {T}"


def _stored(summaries, label):
    """Summaries written by day and read back, as a roll-up job would leave them."""
    path = new_run_dir(summaries.sparkSession, label)
    with_interval_date(summaries).write.partitionBy("interval_date").parquet(path)
    return summaries.sparkSession.read.parquet(path)


def _on_time_and_late(spark, sf):
    events = adapter.events(spark, sf)
    late = F.col("id").cast("long") % 10 == 3
    return events.where(~late), events.where(late)


@query("sketch_active_users", f"SELECT client_id, count(DISTINCT user_id) AS exact_users, true AS within FROM ev WHERE {IN_WEEK} GROUP BY client_id")
def sketch_active_users(spark, sf):
    """Users of a week from hourly sketches, those of late events merged in; within 5 % of the exact count."""
    parts = [_stored(sketches.user_sketches(part, MONTH, AS_OF), "sketches") for part in _on_time_and_late(spark, sf)]
    estimated = sketches.users_over(_stored(sketches.merge_user_sketches(*parts), "sketches"), WEEK, AS_OF)
    exact = metrics.active_users(adapter.events(spark, sf), WEEK, AS_OF).withColumnRenamed("active_users", "exact_users")
    error = F.abs(F.col("active_users") - F.col("exact_users"))
    return exact.join(estimated, "client_id", "left").select("client_id", "exact_users", (error <= F.greatest(F.lit(1.0), 0.05 * F.col("exact_users"))).alias("within"))


@query("sketch_top_events", f"""
SELECT client_id, CAST(row_number() OVER (PARTITION BY client_id ORDER BY count(*) DESC, event_name) AS INTEGER) AS rank, event_name AS name,
       count(*) AS at_least, count(*) AS at_most, CAST(sum(count(*)) OVER (PARTITION BY client_id) AS BIGINT) AS total
FROM ev WHERE {IN_WEEK} GROUP BY client_id, event_name""")
def sketch_top_events(spark, sf):
    """Names of a week from hourly summaries; exact, as there are fewer names than a summary keeps."""
    on_time, late = _on_time_and_late(spark, sf)
    stored = _stored(sketches.name_summaries(on_time, MONTH, AS_OF).unionByName(sketches.name_summaries(late, MONTH, AS_OF)), "names")
    return sketches.top_names_over(stored, WEEK, AS_OF)


@query("sketch_top_users", f"""
SELECT client_id, count(*) AS total, true AS bounds_hold, true AS none_missing, true AS error_small FROM ev WHERE {IN_WEEK} GROUP BY client_id""")
def sketch_top_users(spark, sf):
    """Busiest users of a week from summaries of 16 names a day: true counts lie between the bounds, users above the error are all there."""
    events, kept = adapter.events(spark, sf), 16
    stored = _stored(sketches.name_summaries(events, MONTH, AS_OF, 86_400, kept, "user_id"), "names")
    merged = sketches.merge_name_summaries(stored.where(F.col("interval_start") >= F.lit(WEEK).cast("timestamp")), ["client_id"], kept)
    true = events.where((F.col("event_time") >= F.lit(WEEK).cast("timestamp")) & (F.col("event_time") < F.lit(AS_OF).cast("timestamp")))
    true = true.groupBy("client_id", F.col("user_id").alias("name")).agg(F.count("*").alias("true"))
    listed = merged.select("client_id", F.inline("names"))
    judged = true.join(listed, ["client_id", "name"], "left").join(merged.select("client_id", "error", "total"), "client_id")
    low = F.coalesce("count", F.lit(0))
    return judged.groupBy("client_id", "total").agg(
        F.min((low <= F.col("true")) & (F.col("true") <= low + F.col("error"))).alias("bounds_hold"),
        F.min((F.col("true") <= F.col("error")) | F.col("count").isNotNull()).alias("none_missing"),
        F.max(F.col("error") * (kept + 1) <= F.col("total")).alias("error_small"),
    )


SHARES = (0.5, 0.95, 0.99)


@query("sketch_quantiles", f"""
SELECT client_id, count(*) AS n, share, true AS within
FROM ev, (SELECT unnest([0.5, 0.95, 0.99])::DOUBLE AS share) WHERE {IN_WEEK} AND json_extract_string(properties, '$.k') IS NOT NULL GROUP BY client_id, share""")
def sketch_quantiles(spark, sf):
    """Quantiles of a property over a week from hourly sketches; ranks within 2 % of those asked for."""
    events = adapter.events(spark, sf)
    value = json_property(F.col("properties"), "k").cast("double")
    found = sketches.quantiles_over(_stored(sketches.quantile_sketches(events, value, MONTH, AS_OF), "quantiles"), WEEK, AS_OF, SHARES)
    values = events.where((F.col("event_time") >= F.lit(WEEK).cast("timestamp")) & (F.col("event_time") < F.lit(AS_OF).cast("timestamp"))).select("client_id", value.alias("x"))
    ranks = values.join(found.withColumnRenamed("value", "v"), "client_id").groupBy("client_id", "n", "share").agg(
        (F.count_if(F.col("x") < F.col("v")) / F.count("x")).alias("below"), (F.count_if(F.col("x") <= F.col("v")) / F.count("x")).alias("upto")
    )
    return ranks.select("client_id", "n", "share", ((F.col("below") <= F.col("share") + 0.02) & (F.col("upto") >= F.col("share") - 0.02)).alias("within"))


SESSIONS = """
, spaced AS (SELECT client_id, user_id, event_time, event_name,
                    coalesce(event_time > lag(event_time) OVER (PARTITION BY client_id, user_id ORDER BY event_time) + INTERVAL 30 MINUTE, true) AS opens
             FROM ev WHERE user_id IS NOT NULL),
islands AS (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY client_id, user_id ORDER BY event_time) AS island FROM spaced),
found AS (SELECT client_id, user_id, min(event_time) AS session_start, max(event_time) AS session_end, count(*) AS events,
                 CAST(count(DISTINCT event_name) AS INTEGER) AS names FROM islands GROUP BY client_id, user_id, island)
"""


@query("user_sessions", SESSIONS + "SELECT * FROM found")
def user_sessions(spark, sf):
    return sessions.sessions(adapter.events(spark, sf))


@query("session_figures", SESSIONS + """
SELECT client_id, count(*) AS sessions, sum(events)::BIGINT AS events, sum(floor(epoch(session_end)) - floor(epoch(session_start)))::BIGINT AS seconds,
       count(*) FILTER (events = 1) AS bounced FROM found GROUP BY client_id""")
def session_figures(spark, sf):
    return sessions.session_figures(sessions.sessions(adapter.events(spark, sf)))


@query("trailing_users", f"""
, ticks AS (SELECT unnest(generate_series({T} - INTERVAL 14 DAY, {T}, INTERVAL 6 HOUR)) AS as_of),
spans AS (SELECT * FROM (VALUES ('1h', INTERVAL 1 HOUR), ('24h', INTERVAL 24 HOUR), ('7d', INTERVAL 7 DAY)) v("window", reach)),
tenants AS (SELECT DISTINCT client_id FROM ev WHERE event_time >= {T} - INTERVAL 21 DAY AND event_time < {T})
SELECT t.client_id, k.as_of, s."window", count(DISTINCT user_id) AS users
FROM tenants t CROSS JOIN ticks k CROSS JOIN spans s
LEFT JOIN ev ON ev.client_id = t.client_id AND event_time >= k.as_of - s.reach AND event_time < k.as_of GROUP BY ALL""")
def trailing_users(spark, sf):
    """Users of the last hour, day and week at every sixth hour of two weeks, from one sweep by minutes."""
    windows = {"1h": timedelta(hours=1), "24h": timedelta(days=1), "7d": timedelta(days=7)}
    return trailing.trailing_users(adapter.events(spark, sf), trailing.trailing_grid("2024-01-17", AS_OF, timedelta(hours=6)), windows)
