"""Roll-ups, stored series, paging, retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrid.operators import rollups, series
from tallygrid.plans import tick
from tallygrid.plans.catalog.common import AS_OF, query
from tallygrid.session import new_run_dir
from tallygrid.sources import adapter, exports, readers, storage

T = f"TIMESTAMP '{AS_OF}'"
DAY_MINUTES, MONTH_HOURS = 1440, 720


def stored(spark, sf):
    """The series table as the backfill would leave it."""
    return rollups.rollup_backfill(adapter.events(spark, sf), AS_OF)


def _without_stamps(df):
    return df.drop("created_at", "updated_at")


@query("rollup_minute", f"""
, grid AS (SELECT client_id, unnest(generate_series({T} - INTERVAL 1 DAY, {T} - INTERVAL 1 MINUTE, INTERVAL 1 MINUTE))
                  AS interval_start FROM act),
counted AS (SELECT client_id, date_trunc('minute', event_time) AS interval_start, count(*) AS n,
            count(DISTINCT user_id) AS users FROM ev WHERE event_time >= {T} - INTERVAL 1 DAY AND event_time < {T} GROUP BY ALL),
wide AS (SELECT client_id, interval_start, coalesce(n, 0) AS n, coalesce(users, 0) AS users
         FROM grid LEFT JOIN counted USING (client_id, interval_start))
SELECT client_id, 'events_per_minute' AS metric_name, interval_start, interval_start + INTERVAL 1 MINUTE AS interval_end,
       round(n::DOUBLE, 2) AS value, '{{"count":' || n || '}}' AS meta_data FROM wide
UNION ALL SELECT client_id, 'active_users_1m', interval_start, interval_start + INTERVAL 1 MINUTE, users::DOUBLE, '{{}}' FROM wide
""", ("act",))
def rollup_minute(spark, sf):
    rows = rollups.rollup_minute(adapter.events(spark, sf), adapter.registry(spark, sf), AS_OF, DAY_MINUTES)
    return _without_stamps(rows)


HOUR_SQL = f"""
, grid AS (SELECT client_id, unnest(generate_series({T} - INTERVAL 30 DAY, {T} - INTERVAL 1 HOUR, INTERVAL 1 HOUR))
                  AS interval_start FROM act),
names AS (SELECT client_id, date_trunc('hour', event_time) AS interval_start, event_name, count(*) AS n
          FROM ev WHERE event_time >= {T} - INTERVAL 30 DAY AND event_time < {T} GROUP BY ALL),
ten AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client_id, interval_start ORDER BY n DESC, event_name) AS r
        FROM names) WHERE r <= 10),
listed AS (SELECT client_id, interval_start, count(*) AS shown, string_agg('{{"event_name":"' || event_name || '","count":' || n
           || ',"percentage":' || round(n / total * 100, 2) || '}}', ',' ORDER BY r) AS items
           FROM (SELECT *, sum(n) OVER (PARTITION BY client_id, interval_start) AS total FROM ten) GROUP BY ALL),
counted AS (SELECT client_id, date_trunc('hour', event_time) AS interval_start, count(*) AS n,
            count(DISTINCT user_id) AS users FROM ev GROUP BY ALL),
wide AS (SELECT client_id, interval_start, coalesce(n, 0) AS n, coalesce(users, 0) AS users, coalesce(shown, 0) AS shown,
         coalesce(items, '') AS items
         FROM grid LEFT JOIN counted USING (client_id, interval_start) LEFT JOIN listed USING (client_id, interval_start)),
rolled AS (
SELECT client_id, 'events_per_hour' AS metric_name, interval_start, interval_start + INTERVAL 1 HOUR AS interval_end,
       round(n / 60.0::DOUBLE, 2) * 60 AS value, '{{"count":' || n || '}}' AS meta_data FROM wide
UNION ALL SELECT client_id, 'active_users_1h', interval_start, interval_start + INTERVAL 1 HOUR, users::DOUBLE, '{{}}' FROM wide
UNION ALL SELECT client_id, 'top_events_1h', interval_start, interval_start + INTERVAL 1 HOUR, shown::DOUBLE,
       '{{"events":[' || items || ']}}' FROM wide)
"""


@query("rollup_hour", HOUR_SQL + "SELECT * FROM rolled", ("act",))
def rollup_hour(spark, sf):
    rows = rollups.rollup_hour(adapter.events(spark, sf), adapter.registry(spark, sf), AS_OF, MONTH_HOURS)
    return _without_stamps(rows)


@query("rollup_backfill", "SELECT * FROM agg", ("agg",))
def rollup_backfill(spark, sf):
    return _without_stamps(stored(spark, sf))


@query("upsert", HOUR_SQL + f"""
SELECT coalesce(r.client_id, agg.client_id) AS client_id, coalesce(r.metric_name, agg.metric_name) AS metric_name,
       coalesce(r.interval_start, agg.interval_start) AS interval_start, coalesce(agg.interval_end, r.interval_end) AS interval_end,
       CASE WHEN r.client_id IS NOT NULL THEN r.value ELSE agg.value END AS value,
       CASE WHEN r.client_id IS NOT NULL THEN r.meta_data ELSE agg.meta_data END AS meta_data,
       CASE WHEN agg.client_id IS NOT NULL THEN {T} ELSE TIMESTAMP '2024-02-01' END AS created_at,
       CASE WHEN r.client_id IS NOT NULL THEN TIMESTAMP '2024-02-01' ELSE {T} END AS updated_at
FROM agg FULL JOIN rolled r ON agg.client_id = r.client_id AND agg.metric_name = r.metric_name
     AND agg.interval_start = r.interval_start""", ("act", "agg"))
def upsert(spark, sf):
    rolled = rollups.rollup_hour(adapter.events(spark, sf), adapter.registry(spark, sf), AS_OF, MONTH_HOURS)
    stamp = F.lit("2024-02-01").cast("timestamp")
    return series.upsert_aggregates(stored(spark, sf), rolled.withColumns({"created_at": stamp, "updated_at": stamp}))


@query("time_series", f"""
SELECT client_id, timestamp, value, meta_data FROM (
  SELECT client_id, interval_start AS timestamp, value, meta_data,
         row_number() OVER (PARTITION BY client_id ORDER BY interval_start) AS r
  FROM agg WHERE metric_name = 'events_per_hour' AND interval_start > {T} - INTERVAL 7 DAY AND interval_start < {T})
WHERE r <= 1000""", ("agg",))
def time_series(spark, sf):
    return series.time_series(stored(spark, sf), "events_per_hour", AS_OF, "2024-01-24 00:00:00")


CURSOR_TIME = "2024-01-20 05:00:00"


@query("series_page", f"""
SELECT client_id, interval_start AS timestamp, value, meta_data FROM agg
WHERE client_id = '1' AND metric_name = 'active_users_1h' AND interval_start > TIMESTAMP '{CURSOR_TIME}' AND interval_start < {T}
ORDER BY interval_start LIMIT 101""", ("agg",))
def series_page(spark, sf):
    cursor = series.encode_cursor(CURSOR_TIME)
    return series.series_page_rows(
        stored(spark, sf), "active_users_1h", "1", AS_OF, start="2024-01-01", cursor=cursor, limit=100
    )


def page_sql(where: str, offset: int, size: int) -> str:
    return f"SELECT * FROM ev WHERE {where} ORDER BY event_time DESC, id DESC LIMIT {size} OFFSET {offset}"


@query("events_page", page_sql(f"event_time >= {T} - INTERVAL 24 HOUR AND event_time < {T} AND event_name = 'click'", 50, 50))
def events_page(spark, sf):
    return series.events_page(adapter.events(spark, sf), AS_OF, event_name="click", page=2, page_size=50)


@query("events_page_deep", page_sql(f"event_time >= TIMESTAMP '2024-01-01' AND event_time < {T}", 6000, 1000))
def events_page_deep(spark, sf):
    return series.events_page(adapter.events(spark, sf), AS_OF, start="2024-01-01", page=7, page_size=1000)


@query("events_page_info", f"""
SELECT n AS total, CAST(3 AS INTEGER) AS page, CAST(100 AS INTEGER) AS page_size, CAST(ceil(n / 100.0) AS BIGINT) AS total_pages,
       3 < ceil(n / 100.0) AS has_next, true AS has_prev
FROM (SELECT count(*) AS n FROM ev WHERE event_time >= TIMESTAMP '2024-01-01' AND event_time < {T} AND client_id = '2')""")
def events_page_info(spark, sf):
    return series.events_page_info(adapter.events(spark, sf), AS_OF, start="2024-01-01", client_id="2", page=3)


@query("prune_aggregates", f"SELECT * FROM agg WHERE interval_start >= {T} - INTERVAL 10 DAY", ("agg",))
def prune_aggregates(spark, sf):
    return _without_stamps(series.prune_aggregates(stored(spark, sf), AS_OF, days=10))


@query("prune_events", f"SELECT * FROM ev WHERE event_time >= {T} - INTERVAL 10 DAY")
def prune_events(spark, sf):
    return series.prune_events(adapter.events(spark, sf), AS_OF, days=10)


@query("append_events", "SELECT *, CAST(event_time AS DATE) AS event_date, 'first' AS load_id FROM ev")
def append_events(spark, sf):
    path = new_run_dir(spark, "events")
    storage.append_events(adapter.events(spark, sf), path, "first")
    # the same load again: nothing is doubled
    storage.append_events(adapter.events(spark, sf), path, "first")
    return readers.read_stored_events(spark, path)


@query("merge_aggregates", HOUR_SQL + """
SELECT coalesce(r.client_id, agg.client_id) AS client_id, coalesce(r.metric_name, agg.metric_name) AS metric_name,
       coalesce(r.interval_start, agg.interval_start) AS interval_start,
       CASE WHEN r.client_id IS NOT NULL THEN r.value ELSE agg.value END AS value
FROM agg FULL JOIN rolled r ON agg.client_id = r.client_id AND agg.metric_name = r.metric_name
     AND agg.interval_start = r.interval_start""", ("act", "agg"))
def merge_aggregates(spark, sf):
    path = new_run_dir(spark, "aggregates")
    storage.write_aggregates(stored(spark, sf), path)
    rolled = rollups.rollup_hour(adapter.events(spark, sf), adapter.registry(spark, sf), AS_OF, MONTH_HOURS)
    storage.merge_aggregates(spark, path, rolled)
    return readers.read_aggregates(spark, path).select("client_id", "metric_name", "interval_start", "value")


@query("prune_aggregate_table", f"SELECT client_id, metric_name, interval_start, value FROM agg WHERE interval_start >= {T} - INTERVAL 252 HOUR", ("agg",))
def prune_aggregate_table(spark, sf):
    path = new_run_dir(spark, "aggregates")
    storage.write_aggregates(stored(spark, sf), path)
    # noon, so that the day of the cut-off is rewritten in part
    storage.prune_aggregate_table(spark, path, "2024-01-30 12:00:00", days=10)
    return readers.read_aggregates(spark, path).select("client_id", "metric_name", "interval_start", "value")


@query("run_rollups", HOUR_SQL + f"""
, last AS (SELECT act.client_id, count(id) AS n, count(DISTINCT user_id) AS users
           FROM act LEFT JOIN ev ON ev.client_id = act.client_id AND event_time >= {T} - INTERVAL 1 MINUTE AND event_time < {T} GROUP BY ALL)
SELECT client_id, metric_name, interval_start, value FROM rolled
UNION ALL SELECT client_id, 'events_per_minute', {T} - INTERVAL 1 MINUTE, n::DOUBLE FROM last
UNION ALL SELECT client_id, 'active_users_1m', {T} - INTERVAL 1 MINUTE, users::DOUBLE FROM last""", ("act",))
def run_rollups(spark, sf):
    """A scheduled tick that ran twice over the same horizon."""
    path = new_run_dir(spark, "aggregates")
    for _ in range(2):
        tick.run_rollups(spark, adapter.events(spark, sf), adapter.registry(spark, sf), path, AS_OF, minutes=1, hours=MONTH_HOURS)
    return readers.read_aggregates(spark, path).select("client_id", "metric_name", "interval_start", "value")


@query("prune_event_table", f"""SELECT *, CAST(event_time AS DATE) AS event_date,
       CASE WHEN event_name = 'view' THEN 'views' ELSE 'others' END AS load_id FROM ev WHERE event_time >= {T} - INTERVAL 252 HOUR""")
def prune_event_table(spark, sf):
    path = new_run_dir(spark, "events")
    events = adapter.events(spark, sf)
    storage.append_events(events.filter("event_name = 'view'"), path, "views")
    storage.append_events(events.filter("event_name <> 'view'"), path, "others")
    # noon, so that the day of the cut-off is rewritten in part
    storage.prune_event_table(spark, path, "2024-01-30 12:00:00", days=10)
    return readers.read_stored_events(spark, path)


@query("replace_tenant_events", """
SELECT id, client_id, event_name FROM ev WHERE client_id <> '2'
UNION ALL SELECT 'new-' || id, client_id, 'reloaded' FROM ev WHERE client_id = '2' AND event_name = 'view'""")
def replace_tenant_events(spark, sf):
    old, new = new_run_dir(spark, "events"), new_run_dir(spark, "events")
    events = adapter.events(spark, sf)
    storage.append_events(events, old)
    fresh = events.filter("client_id = '2' AND event_name = 'view'").withColumns(
        {"id": F.concat(F.lit("new-"), "id"), "event_name": F.lit("reloaded")}
    )
    storage.replace_tenant_events(fresh, old, new, ["2"])
    return readers.read_stored_events(spark, new).select("id", "client_id", "event_name")


@query("replace_tenant_repeated", """
SELECT id, client_id, event_name, 'first' AS load_id FROM ev WHERE client_id <> '2'
UNION ALL SELECT 'new-' || id, client_id, 'reloaded', 'reload' FROM ev WHERE client_id = '2' AND event_name = 'view'""")
def replace_tenant_repeated(spark, sf):
    """A tenant reload that ran twice into the same new version, after which the first load is still known by its id."""
    old, new = new_run_dir(spark, "events"), new_run_dir(spark, "events")
    events = adapter.events(spark, sf)
    storage.append_events(events, old, "first")
    fresh = events.filter("client_id = '2' AND event_name = 'view'").withColumns(
        {"id": F.concat(F.lit("new-"), "id"), "event_name": F.lit("reloaded")}
    )
    tenants = events.filter("client_id = '2'").select("client_id")
    for _ in range(2):
        storage.replace_tenant_events(fresh, old, new, tenants)
    return readers.read_stored_events(spark, new).select("id", "client_id", "event_name", "load_id")


@query("append_events_repeated", "SELECT *, CAST(event_time AS DATE) AS event_date, 'second' AS load_id FROM ev WHERE event_name = 'click' AND event_time >= TIMESTAMP '2024-01-20'")
def append_events_repeated(spark, sf):
    """A load that is repeated with fewer days, and another that is repeated empty."""
    path = new_run_dir(spark, "events")
    events = adapter.events(spark, sf)
    clicks = events.filter("event_name = 'click'")
    storage.append_events(events, path, "first")
    storage.append_events(clicks, path, "second")
    storage.append_events(clicks.filter("event_time >= TIMESTAMP '2024-01-20'"), path, "second")
    storage.append_events(events.limit(0), path, "first")
    return readers.read_stored_events(spark, path)


@query("compact_events", """
SELECT *, CAST(event_time AS DATE) AS event_date,
       CASE WHEN event_time < TIMESTAMP '2024-01-20' THEN 'compact-' || CAST(CAST(event_time AS DATE) AS VARCHAR)
            WHEN event_name = 'view' THEN 'views' ELSE 'others' END AS load_id FROM ev""")
def compact_events(spark, sf):
    path, compacted = new_run_dir(spark, "events"), new_run_dir(spark, "events")
    events = adapter.events(spark, sf)
    storage.append_events(events.filter("event_name = 'view'"), path, "views")
    storage.append_events(events.filter("event_name <> 'view'"), path, "others")
    for _ in range(2):  # a repeat gives the same version
        storage.compact_events(spark, path, compacted, "2024-01-20")
    return readers.read_stored_events(spark, compacted)


STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


@query("export_events_csv", f"""
SELECT id AS "ID", event_name AS "Event Name", user_id AS "User ID", {STAMP.format('event_time')} AS "Event Time",
       {STAMP.format('received_at')} AS "Received At", properties AS "Properties" FROM ev""")
def export_events_csv(spark, sf):
    path = new_run_dir(spark, "export")
    exports.export_events_csv(adapter.events(spark, sf), path)
    columns = "`ID` STRING, `Event Name` STRING, `User ID` STRING, `Event Time` STRING, `Received At` STRING, `Properties` STRING"
    return spark.read.schema(columns).option("header", True).option("escape", '"').csv(path)


@query("export_feed_csv", f"""
SELECT {STAMP.format('received_at')} AS "Timestamp", event_name AS "Event Name", user_id AS "User ID",
       properties AS "Properties" FROM ev""")
def export_feed_csv(spark, sf):
    path = new_run_dir(spark, "export")
    exports.export_feed_csv(adapter.events(spark, sf), path)
    columns = "`Timestamp` STRING, `Event Name` STRING, `User ID` STRING, `Properties` STRING"
    return spark.read.schema(columns).option("header", True).option("escape", '"').csv(path)
