"""Alert rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrid.operators import alerts, rollups
from tallygrid.plans.catalog.common import AS_OF, query
from tallygrid.plans.tick import run_alerts
from tallygrid.sources import adapter

T = f"TIMESTAMP '{AS_OF}'"
VIEWS = ("agg", "rules", "valued", "met", "decided")


def _inputs(spark, sf):
    events = adapter.events(spark, sf)
    return adapter.rules(spark, sf), rollups.rollup_backfill(events, AS_OF), events


@query("current_metric", "SELECT id, client_id, metric, current_value FROM valued", VIEWS[:3])
def current_metric(spark, sf):
    found = alerts.current_metric(*_inputs(spark, sf), AS_OF)
    return found.select("id", "client_id", F.col("expression.metric").alias("metric"), "current_value")


@query("evaluate_rules", """
SELECT id AS alert_id, name AS alert_name, client_id, fires AS should_trigger, current_value, threshold, operator, reason,
       CAST(NULL AS VARCHAR) AS error,
       CASE WHEN metric IN ('events_per_hour', 'active_users_1h', 'top_events_1h') AND "window" <> '1h'
            THEN 'hourly metric, but the lookback is shorter than an hour' END AS warning
FROM decided""", VIEWS)
def evaluate_rules(spark, sf):
    return alerts.evaluate_rules(*_inputs(spark, sf), AS_OF).drop("rule")


@query("fire_rules", f"""
SELECT history_id AS id, id AS alert_id, client_id, {T} AS triggered_at, severity, message, context,
       false AS notification_sent FROM fired""", VIEWS + ("fired",))
def fire_rules(spark, sf):
    history, _ = alerts.fire_rules(alerts.evaluate_rules(*_inputs(spark, sf), AS_OF), AS_OF)
    return history


@query("evaluate_all", f"""
, due AS (SELECT id, fires AND enabled AND client_id IN (SELECT client_id FROM act) AS fires FROM decided)
SELECT rules.id, client_id, enabled, CASE WHEN fires THEN {T} ELSE last_triggered END AS last_triggered,
       CAST(trigger_count + CASE WHEN fires THEN 1 ELSE 0 END AS INTEGER) AS trigger_count
FROM rules JOIN due USING (id)""", VIEWS + ("act",))
def evaluate_all(spark, sf):
    rules, stored, events = _inputs(spark, sf)
    _, _, updated = alerts.evaluate_all(rules, adapter.registry(spark, sf), stored, events, AS_OF)
    return updated.select("id", "client_id", "enabled", "last_triggered", "trigger_count")


@query("notifications", f"""
SELECT history_id, id AS alert_id, name AS alert_name, client_id, severity, message, context, {T} AS triggered_at,
       'websocket' AS channel, CAST(NULL AS VARCHAR) AS address FROM fired WHERE websocket
UNION ALL
SELECT history_id, id, name, client_id, severity, message, context, {T}, 'email', unnest(email) FROM fired
""", VIEWS + ("fired",))
def notifications(spark, sf):
    rules, stored, events = _inputs(spark, sf)
    history, updated = alerts.fire_rules(alerts.evaluate_rules(rules, stored, events, AS_OF), AS_OF)
    return alerts.notification_rows(history, updated)


@query("alert_run", """
SELECT history_id AS id, id AS alert_id, message, websocket OR len(email) > 0 AS notification_sent
FROM fired WHERE enabled AND client_id IN (SELECT client_id FROM act)""", VIEWS + ("fired", "act"))
def alert_run(spark, sf):
    rules, stored, events = _inputs(spark, sf)
    run = run_alerts(rules, adapter.registry(spark, sf), stored, events, AS_OF)
    return run.history.select("id", "alert_id", "message", "notification_sent")


@query("history_top", """
SELECT * FROM (
  SELECT id, 'rule-' || (CAST(user_id AS BIGINT) % 50) AS alert_id, client_id, event_time AS triggered_at, event_name AS severity,
         CAST(row_number() OVER (PARTITION BY CAST(user_id AS BIGINT) % 50 ORDER BY event_time DESC, id DESC) AS INTEGER) AS rank
  FROM ev WHERE event_name = 'error') WHERE rank <= 5""")
def history_top(spark, sf):
    history = adapter.events(spark, sf).filter("event_name = 'error'").select(
        "id",
        F.concat(F.lit("rule-"), (F.col("user_id").cast("bigint") % 50).cast("string")).alias("alert_id"),
        "client_id",
        F.col("event_time").alias("triggered_at"),
        F.col("event_name").alias("severity"),
    )
    return alerts.alert_history(history, n=5)


@query("validate_rules", """
, given AS (SELECT c_custkey AS k, c_custkey * 7 % 301 AS name_length,
            (['>', '<', '~', NULL])[c_custkey % 4 + 1] AS operator, (['info', 'fatal', NULL])[c_custkey % 3 + 1] AS severity,
            CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal END AS threshold, c_custkey * 3 % 4000 AS cooldown FROM customer)
SELECT 'rule-' || k AS id, array_to_string(list_filter([
    CASE WHEN name_length NOT BETWEEN 1 AND 255 THEN 'name must have 1 to 255 characters' END,
    CASE WHEN coalesce(operator NOT IN ('>', '<'), true) THEN 'operator is unknown' END,
    CASE WHEN threshold IS NULL THEN 'threshold must be a number' END,
    CASE WHEN severity = 'fatal' THEN 'severity is unknown' END,
    CASE WHEN cooldown > 3600 THEN 'cooldown must be 0 to 3600 seconds' END], lambda x: x IS NOT NULL), '; ') AS faults,
    CASE WHEN name_length BETWEEN 1 AND 255 AND operator IN ('>', '<') AND threshold IS NOT NULL
         AND coalesce(severity, 'info') <> 'fatal' AND cooldown <= 3600 THEN coalesce(severity, 'info') END AS severity
FROM given""")
def validate_rules(spark, sf):
    customer, key = spark.read.parquet(f"{sf}/customer.parquet"), F.col("c_custkey")
    pick = lambda *values: F.element_at(
        F.array(*[F.lit(v).cast("string") for v in values]), (key % len(values) + 1).cast("int")
    )
    given = customer.select(
        F.concat(F.lit("rule-"), key.cast("string")).alias("id"),
        F.repeat(F.lit("x"), (key * 7 % 301).cast("int")).alias("name"),
        F.lit(None).cast("string").alias("description"),
        F.struct(
            F.lit("events_per_minute").alias("metric"),
            pick(">", "<", "~", None).alias("operator"),
            F.when(key % 11 != 0, F.col("c_acctbal")).alias("threshold"),
            F.lit(None).cast("string").alias("window"),
        ).alias("expression"),
        pick("info", "fatal", None).alias("severity"),
        F.lit(None).cast("boolean").alias("enabled"),
        F.lit(None).cast("struct<websocket:boolean,email:array<string>>").alias("notification_channels"),
        (key * 3 % 4000).cast("int").alias("cooldown_seconds"),
    )
    good, rejected = alerts.validate_rules(given)
    return good.select("id", F.lit("").alias("faults"), "severity").unionByName(
        rejected.select("id", F.array_join("reasons", "; ").alias("faults"), F.lit(None).cast("string").alias("severity"))
    )


def order_changes(spark, sf):
    """A rule change log out of the orders: one change per order."""
    key = F.col("o_orderkey")
    kind = key % 11
    whole = F.struct(
        F.lit("events_per_hour").alias("metric"),
        F.when(key % 2 == 0, F.lit(">")).otherwise(F.lit("<")).alias("operator"),
        F.round(F.col("o_totalprice") / 1000, 1).alias("threshold"),
        F.lit(None).cast("string").alias("window"),
    )
    carries = kind.between(1, 7)
    return spark.read.parquet(f"{sf}/orders.parquet").select(
        key.cast("bigint").alias("seq"),
        F.timestamp_seconds(F.lit(1700000000) + key).alias("changed_at"),
        F.when(kind == 0, "delete").when(kind <= 2, "create").when(kind <= 7, "patch").when(kind <= 9, "enable")
        .otherwise("disable").alias("action"),
        F.concat(F.lit("rule-"), (F.col("o_custkey") + 300 * (key % 2)).cast("string")).alias("id"),
        (F.col("o_custkey") % 5).cast("string").alias("client_id"),
        F.when(carries & ((kind <= 2) | (key % 3 == 0)), F.concat(F.lit("n"), key.cast("string"))).alias("name"),
        F.lit(None).cast("string").alias("description"),
        F.when(carries & (key % 13 != 0) & ((kind <= 2) | (key % 4 == 0)), whole).alias("expression"),
        F.when(carries & (key % 5 == 0), "critical").alias("severity"),
        F.when(carries & (key % 17 == 0), F.lit(False)).alias("enabled"),
        F.lit(None).cast("struct<websocket:boolean,email:array<string>>").alias("notification_channels"),
        F.when(carries & (key % 3 == 1), (key % 4000).cast("int")).alias("cooldown_seconds"),
    )


@query("rule_changes", """
, raw AS (SELECT o_orderkey AS k, o_orderkey % 11 AS kind, 'rule-' || (o_custkey + 300 * (o_orderkey % 2)) AS id,
          CAST(o_custkey % 5 AS VARCHAR) AS client_id, o_totalprice FROM orders),
log AS (SELECT k AS seq, kind, id, client_id, to_timestamp(1700000000 + k)::TIMESTAMP AS changed_at,
        CASE WHEN kind BETWEEN 1 AND 7 AND (kind <= 2 OR k % 3 = 0) THEN 'n' || k END AS name,
        CASE WHEN kind BETWEEN 1 AND 7 AND k % 13 <> 0 AND (kind <= 2 OR k % 4 = 0) THEN round(o_totalprice / 1000, 1) END AS threshold,
        CASE WHEN kind BETWEEN 1 AND 7 AND k % 5 = 0 THEN 'critical' END AS severity,
        CASE WHEN kind BETWEEN 1 AND 7 AND k % 17 = 0 THEN false WHEN kind IN (8, 9) THEN true WHEN kind = 10 THEN false END AS enabled,
        CASE WHEN kind BETWEEN 1 AND 7 AND k % 3 = 1 THEN k % 4000 END AS cooldown FROM raw),
valid AS (SELECT * FROM log WHERE NOT (kind BETWEEN 1 AND 7 AND coalesce(cooldown, 0) > 3600)
          AND NOT (kind IN (1, 2) AND threshold IS NULL)),
state AS (SELECT v.*, r.id IS NOT NULL AS existed, max(CASE WHEN kind = 0 THEN seq END) OVER (PARTITION BY v.id) AS gone
          FROM valid v LEFT JOIN rules r ON r.id = v.id),
alive AS (SELECT *, existed AND gone IS NULL AS from_start,
          min(CASE WHEN kind IN (1, 2) THEN seq END) OVER (PARTITION BY id) AS born
          FROM state WHERE gone IS NULL OR seq > gone),
lived AS (SELECT * FROM alive WHERE CASE WHEN from_start THEN kind NOT IN (1, 2) ELSE seq = born OR (seq > born AND kind NOT IN (1, 2)) END),
net AS (SELECT id, bool_or(NOT from_start) AS made, arg_min(client_id, seq) AS client_id, max(changed_at) AS last_change,
        arg_max(name, seq) FILTER (name IS NOT NULL) AS name, arg_max(threshold, seq) FILTER (threshold IS NOT NULL) AS threshold,
        arg_max(CASE WHEN seq % 2 = 0 THEN '>' ELSE '<' END, seq) FILTER (threshold IS NOT NULL) AS operator,
        arg_max(severity, seq) FILTER (severity IS NOT NULL) AS severity, arg_max(enabled, seq) FILTER (enabled IS NOT NULL) AS enabled,
        arg_max(cooldown, seq) FILTER (cooldown IS NOT NULL) AS cooldown FROM lived GROUP BY id),
gone AS (SELECT DISTINCT id FROM valid WHERE kind = 0)
SELECT r.id, r.client_id, coalesce(n.name, r.name) AS name,
       CASE WHEN n.threshold IS NULL THEN r.metric ELSE 'events_per_hour' END AS metric, coalesce(n.operator, r.operator) AS operator,
       coalesce(n.threshold, r.threshold) AS threshold, CASE WHEN n.threshold IS NULL THEN r."window" ELSE '1m' END AS "window",
       coalesce(n.severity, r.severity) AS severity, coalesce(n.enabled, r.enabled) AS enabled,
       CAST(coalesce(n.cooldown, r.cooldown_seconds) AS INTEGER) AS cooldown_seconds,
       coalesce(n.last_change, TIMESTAMP '2023-12-01') AS updated_at
FROM rules r LEFT JOIN net n USING (id) WHERE r.id NOT IN (SELECT id FROM gone)
UNION ALL
SELECT id, client_id, name, 'events_per_hour', operator, threshold, '1m', coalesce(severity, 'info'), coalesce(enabled, true),
       CAST(coalesce(cooldown, 300) AS INTEGER), last_change FROM net WHERE made""", ("rules",))
def rule_changes(spark, sf):
    changed = alerts.apply_rule_changes(adapter.rules(spark, sf), order_changes(spark, sf))
    return changed.select(
        "id", "client_id", "name", "expression.metric", "expression.operator", "expression.threshold",
        "expression.window", "severity", "enabled", "cooldown_seconds", "updated_at",
    )
