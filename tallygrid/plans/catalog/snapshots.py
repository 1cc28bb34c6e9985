"""Versioned event and series tables: loads, reloads, compaction, retention, earlier versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tallygrid.operators import rollups
from tallygrid.plans.catalog.common import AS_OF, query
from tallygrid.plans.catalog.series import HOUR_SQL, MONTH_HOURS, T, stored
from tallygrid.session import new_run_dir
from tallygrid.sources import adapter
from tallygrid.sources.snapshots import EventLog, SeriesLog

CLOSED = "2024-01-20"
NEWEST_DAY = "CAST(event_time AS DATE)"


def _fresh(events: DataFrame) -> DataFrame:
    """What a reload of tenant 2 brings."""
    return events.filter("client_id = '2' AND event_name = 'view'").withColumns({"id": F.concat(F.lit("new-"), "id"), "event_name": F.lit("reloaded")})


@query("snapshot_reload_compact", f"""
SELECT id, client_id, event_name, {NEWEST_DAY} AS event_date,
       CASE WHEN event_time < TIMESTAMP '{CLOSED}' THEN 'compact-' || {NEWEST_DAY}::VARCHAR WHEN event_name = 'view' THEN 'views' ELSE 'others' END AS load_id
FROM ev WHERE client_id <> '2'
UNION ALL
SELECT 'new-' || id, client_id, 'reloaded', {NEWEST_DAY},
       CASE WHEN event_time < TIMESTAMP '{CLOSED}' THEN 'compact-' || {NEWEST_DAY}::VARCHAR ELSE 'reload' END
FROM ev WHERE client_id = '2' AND event_name = 'view'""")
def snapshot_reload_compact(spark, sf):
    """Two loads, then compaction and the reload of one tenant, both twice."""
    log, events = EventLog(spark, new_run_dir(spark, "events")), adapter.events(spark, sf)
    log.append(events.filter("event_name = 'view'"), "views")
    log.append(events.filter("event_name <> 'view'"), "others")
    for _ in range(2):
        log.compact(CLOSED)
        log.reload_tenants(_fresh(events), ["2"], "reload")
    log.compact(CLOSED)
    return log.read().select("id", "client_id", "event_name", "event_date", "load_id")


def _files_by_day(rows: DataFrame, name: str) -> DataFrame:
    named = rows.withColumn("file", F.input_file_name())
    return named.groupBy("event_date").agg(F.count("*").alias(f"{name}_rows"), F.sort_array(F.collect_set("file")).alias(f"{name}_files"))


@query("snapshot_untouched_days", f"""
SELECT {NEWEST_DAY} AS event_date, count(*) + count(*) FILTER (late) AS n, count(*) FILTER (late) = 0 AS same_files, 1 AS loads
FROM (SELECT *, event_name = 'click' AND event_time >= TIMESTAMP '2024-01-10' AND event_time < TIMESTAMP '2024-01-12' AS late FROM ev)
WHERE event_time < TIMESTAMP '{CLOSED}' GROUP BY ALL""")
def snapshot_untouched_days(spark, sf):
    """Late events reach two days; after compaction the other days' files are the ones from before."""
    log, events = EventLog(spark, new_run_dir(spark, "events")), adapter.events(spark, sf)
    before = log.append(events, "all")
    late = events.filter("event_name = 'click' AND event_time >= TIMESTAMP '2024-01-10' AND event_time < TIMESTAMP '2024-01-12'")
    log.append(late.withColumn("id", F.concat(F.lit("late-"), "id")), "late")
    log.compact(CLOSED)
    after = log.compact(CLOSED)  # nothing left to do
    loads = log.read(after).groupBy("event_date").agg(F.countDistinct("load_id").cast("int").alias("loads"))
    both = _files_by_day(log.read(before), "old").join(_files_by_day(log.read(after), "new"), "event_date").join(loads, "event_date")
    same = (F.col("old_files") == F.col("new_files")).alias("same_files")
    return both.where(F.col("event_date") < CLOSED).select("event_date", F.col("new_rows").alias("n"), same, "loads")


@query("snapshot_versions", """
SELECT version, client_id, count(*) AS n
FROM (SELECT 1 AS version, client_id FROM ev WHERE event_name = 'view'
      UNION ALL SELECT 2, client_id FROM ev
      UNION ALL SELECT 3, client_id FROM ev WHERE client_id <> '2' OR event_name = 'view'
      UNION ALL SELECT 4, client_id FROM ev WHERE (client_id <> '2' OR event_name = 'view') AND event_name <> 'click')
GROUP BY ALL""")
def snapshot_versions(spark, sf):
    """Every version can be read: a load, another, a reload, the second load again without its clicks."""
    log, events = EventLog(spark, new_run_dir(spark, "events")), adapter.events(spark, sf)
    others = events.filter("event_name <> 'view'")
    log.append(events.filter("event_name = 'view'"), "views")
    log.append(others, "others")
    log.reload_tenants(_fresh(events), ["2"], "reload")
    log.append(others.filter("event_name <> 'click' AND client_id <> '2'"), "others")
    parts = [log.read(version).groupBy("client_id").agg(F.count("*").alias("n")).withColumn("version", F.lit(version)) for version in range(1, 5)]
    return reduce(DataFrame.unionByName, parts)


@query("snapshot_prune", f"SELECT *, {NEWEST_DAY} AS event_date, 'all' AS load_id FROM ev WHERE event_time >= {T} - INTERVAL 252 HOUR AND event_time < TIMESTAMP '2024-01-27'")
def snapshot_prune(spark, sf):
    """Retention at noon, read up to a day: only segments of these days are opened."""
    log = EventLog(spark, new_run_dir(spark, "events"))
    log.append(adapter.events(spark, sf), "all")
    log.prune("2024-01-30 12:00:00", days=10)
    return log.read(end="2024-01-26")


@query("series_log_merge", HOUR_SQL + """
SELECT coalesce(r.client_id, agg.client_id) AS client_id, coalesce(r.metric_name, agg.metric_name) AS metric_name,
       coalesce(r.interval_start, agg.interval_start) AS interval_start,
       CASE WHEN r.client_id IS NOT NULL THEN r.value ELSE agg.value END AS value
FROM agg FULL JOIN rolled r ON agg.client_id = r.client_id AND agg.metric_name = r.metric_name
     AND agg.interval_start = r.interval_start""", ("act", "agg"))
def series_log_merge(spark, sf):
    log = SeriesLog(spark, new_run_dir(spark, "series"))
    log.merge(stored(spark, sf), "stored")
    log.merge(rollups.rollup_hour(adapter.events(spark, sf), adapter.registry(spark, sf), AS_OF, MONTH_HOURS), "hours")
    return log.read().select("client_id", "metric_name", "interval_start", "value")


@query("series_log_compact", HOUR_SQL + f"""
SELECT coalesce(r.client_id, agg.client_id) AS client_id, coalesce(r.metric_name, agg.metric_name) AS metric_name,
       coalesce(r.interval_start, agg.interval_start) AS interval_start, coalesce(agg.interval_end, r.interval_end) AS interval_end,
       CASE WHEN r.client_id IS NOT NULL THEN r.value + 1 ELSE agg.value END AS value,
       CASE WHEN r.client_id IS NOT NULL THEN r.meta_data ELSE agg.meta_data END AS meta_data,
       CASE WHEN agg.client_id IS NOT NULL THEN {T} ELSE TIMESTAMP '2024-02-01' END AS created_at,
       CASE WHEN r.client_id IS NOT NULL THEN TIMESTAMP '2024-02-01' ELSE {T} END AS updated_at,
       CAST(coalesce(r.interval_start, agg.interval_start) AS DATE) AS interval_date
FROM agg FULL JOIN rolled r ON agg.client_id = r.client_id AND agg.metric_name = r.metric_name
     AND agg.interval_start = r.interval_start""", ("act", "agg"))
def series_log_compact(spark, sf):
    """Hourly deltas in four parts, one of them twice, then new values alone, with compaction between."""
    log = SeriesLog(spark, new_run_dir(spark, "series"))
    log.merge(stored(spark, sf), "stored")
    rolled = rollups.rollup_hour(adapter.events(spark, sf), adapter.registry(spark, sf), AS_OF, MONTH_HOURS)
    stamp = F.lit("2024-02-01").cast("timestamp")
    rolled = rolled.withColumns({"created_at": stamp, "updated_at": stamp})
    for part in (0, 1, 2, 1, 3):
        log.merge(rolled.where(F.hour("interval_start") % 4 == part), f"hours-{part}")
    log.compact()
    log.merge(rolled.withColumn("value", F.col("value") + 1).withColumns({"meta_data": F.lit("unused"), "updated_at": F.lit("2024-02-02").cast("timestamp")}), "values", ("value",))
    log.compact(merge_at=2, size_ratio=100)
    return log.read()


@query("series_log_prune", f"SELECT client_id, metric_name, interval_start, value FROM agg WHERE interval_start >= {T} - INTERVAL 252 HOUR", ("agg",))
def series_log_prune(spark, sf):
    log = SeriesLog(spark, new_run_dir(spark, "series"))
    log.merge(stored(spark, sf), "stored")
    log.merge(stored(spark, sf).limit(0), "nothing")
    log.prune("2024-01-30 12:00:00", days=10)
    return log.read().select("client_id", "metric_name", "interval_start", "value")
