"""Ingest checks, live feed and rate decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrid.operators import alerts, fanout, ingest, ratelimit, rollups
from tallygrid.plans.catalog.common import AS_OF, query
from tallygrid.session import new_run_dir
from tallygrid.sources import adapter, readers

T = f"TIMESTAMP '{AS_OF}'"
HOUR = 3600
RECEIVED = "TIMESTAMP '2024-02-01'"

# --- rate decisions ---------------------------------------------------------------------


def admit_sql(grain: int, rule: str, current: str, keep: str) -> str:
    """Request by request, carrying the list of admitted entries of each key."""
    return f"""
, r AS (SELECT ev.client_id, epoch(received_at)::BIGINT // {grain} * {grain} AS epoch, CAST(ev.id AS BIGINT) AS seq,
        CAST(rate_limit AS BIGINT) AS lim,
        row_number() OVER (PARTITION BY ev.client_id ORDER BY epoch(received_at)::BIGINT // {grain} * {grain}, CAST(ev.id AS BIGINT)) AS n
        FROM (SELECT * REPLACE (date_trunc('second', received_at) AS received_at) FROM ev) ev JOIN reg ON reg.id = ev.client_id),
walk AS (
    SELECT client_id, n, epoch, seq, lim, [epoch] AS entries, true AS allowed, CAST(1 AS BIGINT) AS current FROM r WHERE n = 1
    UNION ALL
    SELECT s.client_id, s.n, s.epoch, s.seq, s.lim, CASE WHEN {rule} THEN {keep} ELSE kept END, {rule}, {current}
    FROM (SELECT r.*, list_filter(walk.entries, lambda x: x > r.epoch - {HOUR}) AS kept
          FROM walk JOIN r ON r.client_id = walk.client_id AND r.n = walk.n + 1) s)
, admitted AS (SELECT client_id, epoch, seq, allowed, current, lim AS "limit", greatest(0, lim - current) AS remaining,
        epoch + {HOUR} AS reset_at FROM walk)
"""


EACH = admit_sql(1, "len(kept) < lim", "CASE WHEN len(kept) < lim THEN len(kept) + 1 ELSE len(kept) END", "list_append(kept, s.epoch)")
BURST = admit_sql(
    600, "len(kept) < lim", "CASE WHEN len(kept) < lim THEN len(kept) + 1 ELSE len(kept) END", "list_append(kept, s.epoch)"
)
SECONDS = admit_sql(
    600, "len(kept) < lim", "CASE WHEN len(kept) < lim THEN len(kept) + 1 ELSE len(kept) END",
    "list_distinct(list_append(kept, s.epoch))",
)


EACH_SECOND = admit_sql(
    1, "len(kept) < lim", "CASE WHEN len(kept) < lim THEN len(kept) + 1 ELSE len(kept) END", "list_distinct(list_append(kept, s.epoch))"
)


def _requests(spark, sf, grain: int = 1):
    log = adapter.requests(adapter.events(spark, sf))
    return log.withColumn("epoch", F.floor(F.col("epoch") / grain) * grain) if grain > 1 else log


@query("admit", EACH + "SELECT * FROM admitted", recursive=True)
def admit(spark, sf):
    return ratelimit.admit(_requests(spark, sf), adapter.registry(spark, sf), window=HOUR)


@query("admit_bursts", BURST + "SELECT * FROM admitted", recursive=True)
def admit_bursts(spark, sf):
    return ratelimit.admit(_requests(spark, sf, 600), adapter.registry(spark, sf), window=HOUR)


@query("admit_distinct_second", SECONDS + "SELECT * FROM admitted", recursive=True)
def admit_distinct_second(spark, sf):
    return ratelimit.admit(
        _requests(spark, sf, 600), adapter.registry(spark, sf), window=HOUR, mode=ratelimit.DISTINCT_SECOND
    )


@query("attempt_rate", f"""
, seconds AS (SELECT client_id, epoch(date_trunc('second', received_at))::BIGINT AS epoch, count(*) AS attempts FROM ev GROUP BY ALL)
SELECT *, CAST(sum(attempts) OVER (PARTITION BY client_id ORDER BY epoch RANGE BETWEEN {HOUR - 1} PRECEDING AND CURRENT ROW) AS BIGINT)
       AS in_window FROM seconds""")
def attempt_rate(spark, sf):
    return ratelimit.attempt_rate(_requests(spark, sf), window=HOUR)


@query("attempt_rate_per_request", """
SELECT client_id, epoch(date_trunc('second', received_at))::BIGINT AS epoch, CAST(id AS BIGINT) AS seq, count(*) OVER (
       PARTITION BY client_id ORDER BY epoch(date_trunc('second', received_at))::BIGINT RANGE BETWEEN 59 PRECEDING AND CURRENT ROW)
       AS in_window FROM ev""")
def attempt_rate_per_request(spark, sf):
    return ratelimit.attempt_rate(_requests(spark, sf), per_request=True)


@query("limit_notices", EACH + 'SELECT client_id, "limit", reset_at FROM admitted WHERE NOT allowed', recursive=True)
def limit_notices(spark, sf):
    return ratelimit.limit_notices(admit(spark, sf))


# --- ingest -----------------------------------------------------------------------------

INCOMING = """
, items AS (SELECT event_id AS n, event_id // 10 AS batch, event_type, user_id, props, ts FROM events),
faulty AS (SELECT *, 'key-' || batch % 6 AS api_key, CAST(batch % 6 AS VARCHAR) AS owner,
    CASE WHEN batch % 37 = 0 THEN 'malformed JSON' WHEN batch % 41 = 0 THEN 'batch must have 1 to 1000 events' END AS whole,
    list_filter([CASE WHEN n % 17 = 0 THEN 'event_name must have 1 to 255 characters' END,
                 CASE WHEN n % 19 = 0 THEN 'user_id must be text' END,
                 CASE WHEN n % 29 = 0 THEN 'properties must be an object' END,
                 CASE WHEN n % 23 = 0 THEN 'event_time is not a time' END], lambda x: x IS NOT NULL) AS faults FROM items),
spoiled AS (SELECT *, bool_or(len(faults) > 0) OVER (PARTITION BY batch) AS bad_batch FROM faulty),
judged AS (SELECT *, CASE WHEN whole IS NOT NULL THEN [whole]
                          WHEN {reject} AND bad_batch AND len(faults) = 0 THEN ['another event of the batch is not valid']
                          ELSE faults END
              || CASE WHEN coalesce(whole, '') <> 'malformed JSON' AND batch % 6 IN (3, 5) THEN ['unknown or revoked key'] ELSE [] END
              AS reasons FROM spoiled),
seen AS (SELECT * FROM judged WHERE whole IS NULL
         UNION ALL SELECT * FROM (SELECT * FROM judged WHERE whole IS NOT NULL QUALIFY row_number() OVER (PARTITION BY batch) = 1))
"""
ACCEPTED = f"""
SELECT owner AS client_id, CAST(user_id AS VARCHAR) AS user_id, event_type AS event_name, replace(props, ' ', '') AS properties,
       CASE WHEN n % 31 = 0 THEN {RECEIVED} ELSE ts END AS event_time, {RECEIVED} AS received_at
FROM seen WHERE len(reasons) = 0"""
REPORT = """
SELECT CASE WHEN len(reasons) = 0 THEN 'processed' ELSE 'failed' END AS status, array_to_string(reasons, '; ') AS reason,
       count(*) AS events FROM seen GROUP BY ALL"""


def _checked(spark, sf, policy):
    lines = adapter.envelopes(adapter.events(spark, sf))
    return ingest.check_batches(
        lines, adapter.registry(spark, sf), policy, received_at=F.lit("2024-02-01").cast("timestamp")
    )


@query("ingest_skip_event", INCOMING.format(reject="false") + ACCEPTED)
def ingest_skip_event(spark, sf):
    return ingest.accepted(_checked(spark, sf, ingest.SKIP_EVENT)).drop("id")


@query("ingest_reject_batch", INCOMING.format(reject="true") + ACCEPTED)
def ingest_reject_batch(spark, sf):
    return ingest.accepted(_checked(spark, sf, ingest.REJECT_BATCH)).drop("id")


@query("ingest_report", INCOMING.format(reject="false") + REPORT)
def ingest_report(spark, sf):
    return ingest.ingest_report(_checked(spark, sf, ingest.SKIP_EVENT))


@query("ingest_report_reject_batch", INCOMING.format(reject="true") + REPORT)
def ingest_report_reject_batch(spark, sf):
    return ingest.ingest_report(_checked(spark, sf, ingest.REJECT_BATCH))


@query("validate", INCOMING.format(reject="false") + """
SELECT api_key, event_type AS event_name, CAST(user_id AS VARCHAR) AS user_id, CASE WHEN n % 31 <> 0 THEN ts END AS event_time
FROM seen WHERE whole IS NULL AND len(faults) = 0""")
def validate(spark, sf):
    batches = ingest.parse_batches(adapter.envelopes(adapter.events(spark, sf)))
    good, _ = ingest.validate_events(ingest.explode_batches(batches, ingest.SKIP_EVENT))
    return good.select("api_key", "event_name", "user_id", "event_time")


@query("attribute", """
SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 6 NOT IN (3, 5) THEN CAST(event_id % 6 AS VARCHAR) END AS client_id
FROM events""")
def attribute(spark, sf):
    keyed = adapter.events(spark, sf).select(
        "id", F.concat(F.lit(" key-"), (F.col("id").cast("bigint") % 6).cast("string")).alias("api_key")
    )
    known, unknown = ingest.attribute_clients(keyed, adapter.registry(spark, sf))
    return known.unionByName(unknown, allowMissingColumns=True).select("id", "client_id")


@query("structural_check", """
SELECT CASE WHEN event_id % 31 <> 0 THEN CAST(event_id AS VARCHAR) END AS id,
       array_to_string(CASE WHEN event_id % 31 = 0 THEN ['malformed JSON'] ELSE list_filter([
           CASE WHEN event_id % 17 = 0 THEN 'client_id is missing' END, CASE WHEN event_id % 19 = 0 THEN 'event_name is missing' END,
           CASE WHEN event_id % 23 = 0 THEN 'event_time is missing or not a time' END,
           CASE WHEN event_id % 29 = 0 THEN 'received_at is missing or not a time' END], lambda x: x IS NOT NULL) END, '; ') AS faults,
       CASE WHEN event_id % 17 <> 0 AND event_id % 19 <> 0 AND event_id % 23 <> 0 AND event_id % 29 <> 0 AND event_id % 31 <> 0
            THEN ts END AS event_time FROM events""")
def structural_check(spark, sf):
    path = new_run_dir(spark, "queued")
    adapter.queued_events(adapter.events(spark, sf)).write.text(path)
    good, rejected = ingest.structural_check(readers.read_events(spark, path))
    return good.select("id", F.lit("").alias("faults"), "event_time").unionByName(
        rejected.select("id", F.array_join("reasons", "; ").alias("faults"), F.lit(None).cast("timestamp").alias("event_time"))
    )


# --- live feed --------------------------------------------------------------------------

ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00'"
EVENT_JSON = f"""'{{"id":"' || id || '","client_id":"' || client_id || '","user_id":"' || user_id || '","event_name":"' || event_name
    || '","properties":' || replace(properties, ' ', '') || ',"event_time":"' || {ISO.format('event_time')}
    || '","received_at":"' || {ISO.format('received_at')} || '"}}'"""


@query("fanout_events", f"""
SELECT client_id, 'events' AS channel, '{{"client_id":"' || client_id || '","event":' || {EVENT_JSON} || '}}' AS message FROM ev""")
def fanout_events(spark, sf):
    return fanout.fanout_events(adapter.events(spark, sf), even=True)


@query("fanout_delivered", f"""
SELECT client_id, 'events' AS channel, '{{"type":"event","data":' || {EVENT_JSON} || ',"timestamp":"' || {ISO.format('received_at')}
       || '"}}' AS message FROM ev""")
def fanout_delivered(spark, sf):
    return fanout.fanout_events(adapter.events(spark, sf), delivered=True, even=True)


@query("fanout_metrics", """
SELECT client_id, 'metrics' AS channel, '{"type":"metric","metric":"' || metric_name || '","value":' || value || ',"metadata":{}}'
       AS message FROM agg""", ("agg",))
def fanout_metrics(spark, sf):
    return fanout.fanout_metrics(rollups.rollup_backfill(adapter.events(spark, sf), AS_OF))


# as a JSON object the context's members come in sorted order, and numbers without needless zeros
NUMBER = "regexp_replace(CAST({0} AS VARCHAR), '\\.0$', '')"
CONTEXT = f"""'{{"alert_id":"' || id || '","alert_name":"' || name || '","current_value":' || {NUMBER.format("current_value")}
       || ',"operator":"' || operator || '","reason":"' || reason || '","should_trigger":true,"threshold":' || {NUMBER.format("threshold")} || '}}'"""


@query("fanout_alerts", """
SELECT client_id, 'alerts' AS channel, '{"type":"alert","alert_id":"' || id || '","alert_name":"' || name || '","severity":"'
       || severity || '","message":"' || message || '","context":' || """ + CONTEXT + """ || ',"triggered_at":"2024-01-31T00:00:00+00:00","timestamp":"2024-01-31T00:00:00+00:00"}' AS message
FROM fired WHERE websocket""", ("agg", "rules", "valued", "met", "decided", "fired"))
def fanout_alerts(spark, sf):
    events = adapter.events(spark, sf)
    decided = alerts.evaluate_rules(adapter.rules(spark, sf), rollups.rollup_backfill(events, AS_OF), events, AS_OF)
    history, updated = alerts.fire_rules(decided, AS_OF)
    return fanout.fanout_alerts(alerts.notification_rows(history, updated))


@query("fanout_alerts_published", """
SELECT client_id, 'alerts' AS channel, '{"client_id":"' || client_id || '","alert":{"type":"alert","alert_id":"' || id || '","alert_name":"' || name
       || '","severity":"' || severity || '","message":"' || message || '","context":' || """ + CONTEXT + """
       || ',"triggered_at":"2024-01-31T00:00:00+00:00","timestamp":"2024-01-31T00:00:00+00:00"}}' AS message
FROM fired WHERE websocket""", ("agg", "rules", "valued", "met", "decided", "fired"))
def fanout_alerts_published(spark, sf):
    events = adapter.events(spark, sf)
    decided = alerts.evaluate_rules(adapter.rules(spark, sf), rollups.rollup_backfill(events, AS_OF), events, AS_OF)
    history, updated = alerts.fire_rules(decided, AS_OF)
    return fanout.fanout_alerts(alerts.notification_rows(history, updated), delivered=False)


@query("fanout_metrics_published", """
SELECT client_id, 'metrics' AS channel, '{"client_id":"' || client_id || '","metric":"' || metric_name || '","value":' || value || ',"metadata":{}}'
       AS message FROM agg""", ("agg",))
def fanout_metrics_published(spark, sf):
    return fanout.fanout_metrics(rollups.rollup_backfill(adapter.events(spark, sf), AS_OF), delivered=False)


@query("fanout_notices_published", EACH + """
SELECT client_id, 'rate_limit' AS channel, '{"client_id":"' || client_id || '","limit":' || "limit" || ',"reset_at":' || reset_at || '}'
       AS message FROM admitted WHERE NOT allowed""", recursive=True)
def fanout_notices_published(spark, sf):
    return fanout.fanout_notices(limit_notices(spark, sf), delivered=False)


@query("fanout_notices", EACH + """
SELECT client_id, 'events' AS channel, '{"type":"rate_limit_exceeded","limit":' || "limit" || ',"reset_at":' || reset_at || '}'
       AS message FROM admitted WHERE NOT allowed""", recursive=True)
def fanout_notices(spark, sf):
    return fanout.fanout_notices(limit_notices(spark, sf))


SUBSCRIBED = """
, commands AS (SELECT p_partkey AS seq, 'conn-' || p_partkey % 101 AS connection_id, p_partkey % 3 = 0 AS adds,
               (CASE p_partkey % 5 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN ['events'] WHEN 2 THEN ['alerts', 'metrics']
                WHEN 3 THEN ['events', 'alerts'] ELSE ['metrics'] END) AS channels FROM part),
sets AS (SELECT connection_id, max(seq) AS since, arg_max(channels, seq) AS channels FROM commands
         WHERE adds AND len(channels) > 0 GROUP BY connection_id),
current AS (SELECT 'conn-' || s_suppkey AS connection_id, CAST(s_suppkey % 5 AS VARCHAR) AS client_id, coalesce(since, -1) AS since,
            unnest(coalesce(channels, ['events', 'metrics', 'alerts'])) AS channel
            FROM supplier LEFT JOIN sets ON sets.connection_id = 'conn-' || s_suppkey),
subscribed AS (SELECT connection_id, client_id, channel FROM current c WHERE NOT EXISTS (
    SELECT 1 FROM commands m WHERE m.connection_id = c.connection_id AND NOT adds AND m.seq > c.since
    AND list_contains(m.channels, c.channel)))
"""


@query("subscription_state", SUBSCRIBED + "SELECT * FROM subscribed")
def subscription_state(spark, sf):
    return fanout.subscription_state(adapter.connections(spark, sf), adapter.connection_commands(spark, sf))


@query("route", SUBSCRIBED + """
SELECT connection_id, client_id, channel, id AS event_id FROM ev JOIN subscribed USING (client_id) WHERE channel = 'events'""")
def route(spark, sf):
    messages = adapter.events(spark, sf).select("client_id", F.lit("events").alias("channel"), F.col("id").alias("event_id"))
    return fanout.route_messages(messages, subscription_state(spark, sf))


@query("live_tail", """
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY client_id ORDER BY received_at DESC, id DESC) AS INTEGER) AS position,
                      count(*) OVER (PARTITION BY client_id) AS total FROM ev) WHERE position <= 500""")
def live_tail(spark, sf):
    return fanout.live_tail(adapter.events(spark, sf), 500)
