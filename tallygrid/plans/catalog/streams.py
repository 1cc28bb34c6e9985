"""Streaming jobs, each fed in three runs that share one checkpoint, and read back as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tallygrid.functions.times import literal_time
from tallygrid.operators import ingest, ratelimit
from tallygrid.plans.catalog.common import AS_OF, query
from tallygrid.plans.catalog.live import ACCEPTED, EACH, EACH_SECOND, HOUR, INCOMING, SUBSCRIBED, subscription_state
from tallygrid.plans.catalog.summaries import SESSIONS
from tallygrid.session import new_run_dir
from tallygrid.sources import adapter, readers
from tallygrid.sources.snapshots import SeriesLog
from tallygrid.streaming import jobs

T = f"TIMESTAMP '{AS_OF}'"
CUTS = ("2024-01-11", "2024-01-21 07:30:00")
EVENT_DDL = (
    "id STRING, client_id STRING, user_id STRING, event_name STRING, properties STRING, "
    "event_time TIMESTAMP, received_at TIMESTAMP"
)

SESSION_DDL = "client_id STRING, user_id STRING, session_start TIMESTAMP, session_end TIMESTAMP, events BIGINT, names INT"


def feed(spark: SparkSession, sf: str, run: Callable[[DataFrame], StreamingQuery], path: str | None = None) -> None:
    """Three arrivals of events in time order; after each the job is resumed and drained."""
    path = path or new_run_dir(spark, "arrivals")
    events = adapter.events(spark, sf)
    first, second = (literal_time(cut) for cut in CUTS)
    time = F.col("event_time")
    for arrived in (time < first, (time >= first) & (time < second), time >= second):
        events.filter(arrived).write.mode("append").parquet(path)
        run(spark.readStream.schema(EVENT_DDL).parquet(path)).awaitTermination()


def _dirs(spark: SparkSession, *names: str) -> list[str]:
    return [new_run_dir(spark, name) for name in names]


CLOSED = "(SELECT max(event_time) FROM ev) - INTERVAL 10 MINUTE"


def series_sql(unit: str, metric: str, value: str, meta: str) -> str:
    return f"""
, placed AS (SELECT *, date_trunc('{unit}', event_time) AS interval_start FROM ev)
SELECT client_id, '{metric}' AS metric_name, interval_start, interval_start + INTERVAL 1 {unit} AS interval_end,
       {value} AS value, {meta} AS meta_data
FROM placed WHERE interval_start + INTERVAL 1 {unit} <= {CLOSED} GROUP BY client_id, interval_start"""


def _rolled(spark, sf, shape: Callable[[DataFrame], DataFrame]) -> DataFrame:
    table, checkpoint = _dirs(spark, "aggregates", "checkpoint")
    feed(spark, sf, lambda events: jobs.stream_upsert(shape(events), table, checkpoint))
    return readers.read_aggregates(spark, table).drop("created_at", "updated_at", "interval_date")


@query("stream_rollup", series_sql("hour", "events_per_hour", "round(count(*) / 60.0::DOUBLE, 2) * 60", "'{\"count\":' || count(*) || '}'"))
def stream_rollup(spark, sf):
    return _rolled(spark, sf, lambda events: jobs.stream_rollup(events, 60))


@query("stream_active_users", series_sql("hour", "active_users_1h", "count(DISTINCT user_id)::DOUBLE", "'{}'"))
def stream_active_users(spark, sf):
    return _rolled(spark, sf, lambda events: jobs.stream_active_users(events, 60))


@query("stream_upsert", series_sql("minute", "events_per_minute", "count(*)::DOUBLE", "'{\"count\":' || count(*) || '}'"))
def stream_upsert(spark, sf):
    return _rolled(spark, sf, lambda events: jobs.stream_rollup(events, 1))


@query("stream_series_log", series_sql("hour", "events_per_hour", "round(count(*) / 60.0::DOUBLE, 2) * 60", "'{\"count\":' || count(*) || '}'"))
def stream_series_log(spark, sf):
    table, checkpoint = _dirs(spark, "series", "checkpoint")
    feed(spark, sf, lambda events: jobs.stream_series_log(jobs.stream_rollup(events, 60), table, checkpoint, compact_every=2))
    return SeriesLog(spark, table).read().drop("created_at", "updated_at", "interval_date")


@query("stream_sessions", SESSIONS + f"SELECT * FROM found WHERE session_end + INTERVAL 30 MINUTE <= {CLOSED}")
def stream_sessions(spark, sf):
    table, checkpoint = _dirs(spark, "sessions", "checkpoint")
    feed(spark, sf, lambda events: jobs.stream_sessions(events, table, checkpoint))
    return spark.read.schema(SESSION_DDL).parquet(table).drop("batch")


@query("stream_ingest", INCOMING.format(reject="false") + ACCEPTED.split("CASE WHEN n % 31")[0] + """
CASE WHEN n % 31 <> 0 THEN ts END AS event_time FROM seen WHERE len(reasons) = 0""")
def stream_ingest(spark, sf):
    arrivals, table, quarantine, checkpoint = _dirs(spark, "arrivals", "events", "quarantine", "checkpoint")
    lines = adapter.envelopes(adapter.events(spark, sf)).repartition(6, "value")
    lines.write.text(arrivals)
    stream = readers.read_lines(spark, arrivals, streaming=True, max_files=3)
    jobs.stream_ingest(
        stream, adapter.registry(spark, sf), table, quarantine, checkpoint, ingest.SKIP_EVENT
    ).awaitTermination()
    # a missing event time becomes the time of receipt, which only the clock knows
    known = F.when(F.col("event_time") != F.col("received_at"), F.col("event_time"))
    stored = readers.read_stored_events(spark, table)
    return stored.select("client_id", "user_id", "event_name", "properties", known.alias("event_time"))


@query("stream_ingest_two_jobs", INCOMING.format(reject="false") + ACCEPTED.split("CASE WHEN n % 31")[0] + """
CASE WHEN n % 31 <> 0 THEN ts END AS event_time FROM seen, (VALUES (1), (2)) twice(job) WHERE len(reasons) = 0""")
def stream_ingest_two_jobs(spark, sf):
    """Two jobs with checkpoints of their own store the same lines into one table: neither takes the other's place."""
    arrivals, table, quarantine = _dirs(spark, "arrivals", "events", "quarantine")
    adapter.envelopes(adapter.events(spark, sf)).repartition(4, "value").write.text(arrivals)
    for checkpoint in _dirs(spark, "checkpoint", "checkpoint"):
        stream = readers.read_lines(spark, arrivals, streaming=True, max_files=2)
        jobs.stream_ingest(stream, adapter.registry(spark, sf), table, quarantine, checkpoint, ingest.SKIP_EVENT).awaitTermination()
    known = F.when(F.col("event_time") != F.col("received_at"), F.col("event_time"))
    stored = readers.read_stored_events(spark, table)
    return stored.select("client_id", "user_id", "event_name", "properties", known.alias("event_time"))


@query("stream_quarantine", INCOMING.format(reject="true") + """
SELECT array_to_string(reasons, '; ') AS reason, count(*) AS events FROM seen WHERE len(reasons) > 0 GROUP BY ALL""")
def stream_quarantine(spark, sf):
    arrivals, table, quarantine, checkpoint = _dirs(spark, "arrivals", "events", "quarantine", "checkpoint")
    adapter.envelopes(adapter.events(spark, sf)).repartition(6, "value").write.text(arrivals)
    stream = readers.read_lines(spark, arrivals, streaming=True, max_files=3)
    jobs.stream_ingest(stream, adapter.registry(spark, sf), table, quarantine, checkpoint).awaitTermination()
    refused = spark.read.parquet(quarantine)
    return refused.groupBy(F.array_join("reasons", "; ").alias("reason")).agg(F.count("*").alias("events"))


@query("stream_admit", EACH + "SELECT * FROM admitted", recursive=True)
def stream_admit(spark, sf):
    decisions, entries, checkpoint = _dirs(spark, "decisions", "entries", "checkpoint")
    limits = adapter.registry(spark, sf)
    feed(spark, sf, lambda events: jobs.stream_admit(
        adapter.requests(events), limits, decisions, entries, checkpoint, window=HOUR
    ))
    return spark.read.parquet(decisions).drop("batch")


@query("stream_admit_distinct_second", EACH_SECOND + "SELECT * FROM admitted", recursive=True)
def stream_admit_distinct_second(spark, sf):
    decisions, entries, checkpoint = _dirs(spark, "decisions", "entries", "checkpoint")
    limits = adapter.registry(spark, sf)
    feed(spark, sf, lambda events: jobs.stream_admit(
        adapter.requests(events), limits, decisions, entries, checkpoint, HOUR, ratelimit.DISTINCT_SECOND
    ))
    return spark.read.parquet(decisions).drop("batch")


@query("stream_admit_wrong_clock", EACH + """SELECT * FROM admitted
UNION ALL SELECT 'wrong', 4102444800, -1, true, 1, 100, 99, 4102448400""", recursive=True)
def stream_admit_wrong_clock(spark, sf):
    """The same decisions when one more key has a clock far in the future."""
    decisions, entries, checkpoint = _dirs(spark, "decisions", "entries", "checkpoint")
    limits = adapter.registry(spark, sf).select("id", F.col("rate_limit").cast("int").alias("rate_limit"))
    limits = limits.unionByName(spark.createDataFrame([("wrong", 100)], "id string, rate_limit int"))

    def run(events: DataFrame) -> StreamingQuery:
        requests = adapter.requests(events)
        ahead = requests.filter(F.col("seq") == 0).select(F.lit("wrong").alias("client_id"), F.lit(4_102_444_800).cast("bigint").alias("epoch"), F.lit(-1).cast("bigint").alias("seq"))
        return jobs.stream_admit(requests.unionByName(ahead), limits, decisions, entries, checkpoint, window=HOUR)

    feed(spark, sf, run)
    return spark.read.parquet(decisions).drop("batch")


@query("stream_fanout", SUBSCRIBED + """
SELECT connection_id, client_id, channel, id AS event_id FROM ev JOIN subscribed USING (client_id) WHERE channel = 'events'""")
def stream_fanout(spark, sf):
    path, checkpoint = _dirs(spark, "feed", "checkpoint")
    feed(spark, sf, lambda events: jobs.stream_fanout(events, path, checkpoint))
    read = jobs.read_feed(spark, path, subscription_state(spark, sf))
    return read.select("connection_id", "client_id", "channel", F.col("id").alias("event_id"))


@query("stream_tail", """
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY client_id ORDER BY received_at DESC, id DESC) AS INTEGER) AS position,
                      count(*) OVER (PARTITION BY client_id) AS total FROM ev) WHERE position <= 500""")
def stream_tail(spark, sf):
    path, checkpoint = _dirs(spark, "tail", "checkpoint")
    feed(spark, sf, lambda events: jobs.stream_tail(events, path, checkpoint, 500))
    return jobs.read_state(spark, path)


ALERTED = f"""
, hourly AS (SELECT client_id, date_trunc('hour', event_time) AS s, count(*) AS c, count(DISTINCT user_id) AS users,
             count(*) FILTER (event_time >= date_trunc('hour', event_time) + INTERVAL 59 MINUTE) AS last_minute FROM ev GROUP BY ALL),
closed AS (SELECT client_id, s, round(c / 60.0::DOUBLE, 2) * 60 AS value FROM hourly WHERE s + INTERVAL 1 HOUR <= {CLOSED}),
moments AS (SELECT t, row_number() OVER (ORDER BY t) AS n FROM (SELECT DISTINCT s + INTERVAL 1 HOUR AS t FROM closed)),
asked AS (SELECT rules.*, n, t, CASE "window" WHEN '5m' THEN INTERVAL 10 MINUTE WHEN '1h' THEN INTERVAL 2 HOUR ELSE INTERVAL 2 MINUTE END AS reach
          FROM rules JOIN act USING (client_id), moments WHERE enabled),
met AS (
    SELECT a.id, a.client_id, severity, cooldown_seconds, last_triggered, n, t,
           CASE WHEN metric = 'events_per_hour' AND c.s >= t - reach THEN c.value WHEN metric = 'events_per_minute' THEN coalesce(last_minute, 0)::DOUBLE
                WHEN metric = 'active_users_1h' THEN coalesce(users, 0)::DOUBLE ELSE 0.0::DOUBLE END AS v,
           CASE operator WHEN '>' THEN v > threshold WHEN '<' THEN v < threshold WHEN '>=' THEN v >= threshold WHEN '<=' THEN v <= threshold
                WHEN '==' THEN abs(v - threshold) < 0.01 WHEN '!=' THEN abs(v - threshold) >= 0.01 ELSE false END AS met
    FROM asked a ASOF LEFT JOIN closed c ON a.client_id = c.client_id AND a.t > c.s
    LEFT JOIN hourly h ON h.client_id = a.client_id AND h.s = a.t - INTERVAL 1 HOUR),
walk AS (
    SELECT id, client_id, severity, n, t, met AND coalesce(date_diff('second', last_triggered, t) >= cooldown_seconds, true) AS fires,
           CASE WHEN met AND coalesce(date_diff('second', last_triggered, t) >= cooldown_seconds, true) THEN t ELSE last_triggered END AS last
    FROM met WHERE n = 1
    UNION ALL
    SELECT m.id, m.client_id, m.severity, m.n, m.t, m.met AND coalesce(date_diff('second', w.last, m.t) >= m.cooldown_seconds, true),
           CASE WHEN m.met AND coalesce(date_diff('second', w.last, m.t) >= m.cooldown_seconds, true) THEN m.t ELSE w.last END
    FROM walk w JOIN met m ON m.id = w.id AND m.n = w.n + 1)
SELECT id AS alert_id, client_id, severity, count(*) AS firings, max(t) AS last_triggered FROM walk WHERE fires GROUP BY ALL"""


@query("stream_alerts", ALERTED, ("rules", "act"), recursive=True)
def stream_alerts(spark, sf):
    rules, table, history, sent, checkpoint, arrivals = _dirs(spark, "rules", "aggregates", "history", "sent", "checkpoint", "arrivals")
    jobs.seed_state(adapter.rules(spark, sf), rules)
    registry = adapter.registry(spark, sf)

    def run(events: DataFrame) -> StreamingQuery:
        here = spark.read.schema(EVENT_DDL).parquet(arrivals)
        return jobs.stream_alerts(jobs.stream_rollup(events, 60), registry, rules, table, history, sent, checkpoint, events=here)

    feed(spark, sf, run, arrivals)
    fired = spark.read.parquet(history)
    return fired.groupBy("alert_id", "client_id", "severity").agg(
        F.count("*").alias("firings"), F.max("triggered_at").alias("last_triggered")
    )
