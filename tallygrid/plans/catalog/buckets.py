"""Roll-ups kept by signed changes: late loads, repeats, loads that shrink, compaction, a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrid.operators import rollups
from tallygrid.operators.filters import in_window
from tallygrid.plans.catalog.common import AS_OF, query
from tallygrid.plans.catalog.series import HOUR_SQL, MONTH_HOURS
from tallygrid.plans.catalog.streams import feed
from tallygrid.session import new_run_dir
from tallygrid.sources import adapter
from tallygrid.sources.buckets import BucketLog, fold_late
from tallygrid.sources.snapshots import SeriesLog
from tallygrid.streaming import jobs

MONTH = "2024-01-01"
COLUMNS = ["client_id", "metric_name", "interval_start", "interval_end", "value", "meta_data"]
ALL_HOURS = HOUR_SQL + "SELECT * FROM rolled"


def _parts(spark, sf, parts):
    """The month's events in ``parts`` loads, dealt by id."""
    events, number = in_window(adapter.events(spark, sf), MONTH, AS_OF), F.col("id").cast("long") % parts
    return [events.where(number == part) for part in range(parts)]


@query("late_rollups", ALL_HOURS, ("act",))
def late_rollups(spark, sf):
    """Hours of the loads on time, then two late loads, the first of them twice: the series of a full roll-up."""
    *on_time, late, later = _parts(spark, sf, 5)
    log, series, registry = BucketLog(spark, new_run_dir(spark, "buckets")), SeriesLog(spark, new_run_dir(spark, "series")), adapter.registry(spark, sf)
    early = on_time[0].unionByName(on_time[1]).unionByName(on_time[2])
    log.apply(early, "on-time")
    series.merge(rollups.rollup_hour(early, registry, AS_OF, MONTH_HOURS), "on-time")
    for events, load_id in ((late, "late"), (later, "later"), (late, "late")):
        fold_late(log, series, events, load_id, registry, AS_OF)
    return series.read().select(*COLUMNS)


KEPT_MINUTES = """
SELECT client_id, 'events_per_minute' AS metric_name, date_trunc('minute', event_time) AS interval_start,
       date_trunc('minute', event_time) + INTERVAL 1 MINUTE AS interval_end, round(count(*)::DOUBLE, 2) AS value, '{"count":' || count(*) || '}' AS meta_data
FROM kept GROUP BY ALL
UNION ALL
SELECT client_id, 'active_users_1m', date_trunc('minute', event_time), date_trunc('minute', event_time) + INTERVAL 1 MINUTE,
       count(DISTINCT user_id)::DOUBLE, '{}' FROM kept GROUP BY ALL"""


@query("late_rollups_withdrawn", f"""
, kept AS (SELECT * FROM ev WHERE event_time >= TIMESTAMP '{MONTH}' AND event_time < TIMESTAMP '{AS_OF}'
           AND CAST(id AS BIGINT) % 4 <> 3 AND NOT (CAST(id AS BIGINT) % 4 = 1 AND event_name = 'click')){KEPT_MINUTES}""")
def late_rollups_withdrawn(spark, sf):
    """Minutes of four loads; two are added up, one comes again without its clicks, one is taken back."""
    parts = _parts(spark, sf, 4)
    log = BucketLog(spark, new_run_dir(spark, "buckets"), rollups.MINUTE)
    for number, events in enumerate(parts):
        log.apply(events, f"load-{number}")
    log.compact(merge_at=2, size_ratio=100, spared={"load-1", "load-3"})
    log.apply(parts[1].where("event_name <> 'click'"), "load-1")
    log.apply(parts[3].limit(0), "load-3")
    log.compact(merge_at=2, size_ratio=100)
    return log.rollup(AS_OF).select(*COLUMNS)


@query("stream_late_rollups", HOUR_SQL + "SELECT * FROM rolled WHERE (client_id, interval_start) IN (SELECT (client_id, interval_start) FROM names)", ("act",))
def stream_late_rollups(spark, sf):
    """Hours from a stream without a watermark: whatever comes late is in."""
    log, series, checkpoint = (new_run_dir(spark, label) for label in ("buckets", "series", "checkpoint"))
    registry = adapter.registry(spark, sf)
    feed(spark, sf, lambda events: jobs.stream_late_rollups(events, log, series, registry, AS_OF, checkpoint, compact_every=2))
    return SeriesLog(spark, series).read().select(*COLUMNS)
