"""Registration and the SQL views shared by the checks."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tallygrid.session import configure
from tallygrid.sources.adapter import AS_OF

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# the adapter's tables in SQL, in order of dependence
VIEWS = {
    "ev": """
        SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id % 4 AS VARCHAR) AS client_id,
               CAST(user_id AS VARCHAR) AS user_id, event_type AS event_name, props AS properties,
               ts AS event_time, ts AS received_at
        FROM events""",
    "reg": """
        SELECT CAST(r_regionkey AS VARCHAR) AS id, r_name AS client_name,
               sha256('key-' || CAST(r_regionkey AS VARCHAR)) AS key_hash,
               'owner-' || CAST(r_regionkey % 2 AS VARCHAR) AS user_id,
               CAST(r_regionkey + 2 AS INTEGER) AS rate_limit, r_regionkey <> 3 AS is_active
        FROM region""",
    "act": "SELECT id AS client_id FROM reg WHERE is_active",
    "agg": f"""
        SELECT client_id, 'events_per_minute' AS metric_name, date_trunc('minute', event_time) AS interval_start,
               date_trunc('minute', event_time) + INTERVAL 1 MINUTE AS interval_end,
               CAST(count(*) AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS meta_data
        FROM ev WHERE event_time > TIMESTAMP '{AS_OF}' - INTERVAL 6 HOUR GROUP BY ALL
        UNION ALL
        SELECT client_id, 'active_users_1m', date_trunc('minute', event_time),
               date_trunc('minute', event_time) + INTERVAL 1 MINUTE, CAST(count(DISTINCT user_id) AS DOUBLE), NULL
        FROM ev WHERE event_time > TIMESTAMP '{AS_OF}' - INTERVAL 6 HOUR GROUP BY ALL
        UNION ALL
        SELECT client_id, 'events_per_hour', date_trunc('hour', event_time),
               date_trunc('hour', event_time) + INTERVAL 1 HOUR, CAST(count(*) AS DOUBLE), NULL
        FROM ev WHERE event_time > TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY GROUP BY ALL
        UNION ALL
        SELECT client_id, 'active_users_1h', date_trunc('hour', event_time),
               date_trunc('hour', event_time) + INTERVAL 1 HOUR, CAST(count(DISTINCT user_id) AS DOUBLE), NULL
        FROM ev WHERE event_time > TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY GROUP BY ALL""",
    "rules": f"""
        SELECT 'rule-' || c_custkey AS id, CAST(c_custkey % 5 AS VARCHAR) AS client_id, c_name AS name,
               (['events_per_minute', 'active_users_1h', 'events_per_hour', 'unknown'])[c_nationkey % 4 + 1] AS metric,
               (['>', '<', '>=', '<=', '==', '!='])[c_custkey % 6 + 1] AS operator,
               floor(c_acctbal / 100) / 10 AS threshold, (['1m', '5m', '1h'])[c_custkey // 2 % 3 + 1] AS "window",
               (['info', 'warning', 'error', 'critical'])[c_custkey % 4 + 1] AS severity, c_custkey % 7 <> 0 AS enabled,
               CASE WHEN c_custkey % 5 <> 4 THEN TIMESTAMP '{AS_OF}' - to_seconds(c_custkey % 1200) END AS last_triggered,
               CAST(c_custkey % 4 AS INTEGER) AS trigger_count, c_custkey % 3 <> 1 AS websocket,
               CASE WHEN c_custkey % 2 = 0 THEN ['a' || c_custkey || '@example.com', 'ops@example.com'] ELSE [] END AS email,
               CAST(c_custkey * 37 % 3601 AS INTEGER) AS cooldown_seconds
        FROM customer""",
    "valued": f"""
        SELECT rules.*, CASE WHEN stored_at >= TIMESTAMP '{AS_OF}' - CASE rules."window" WHEN '5m' THEN INTERVAL 10 MINUTE
                                  WHEN '1h' THEN INTERVAL 2 HOUR ELSE INTERVAL 2 MINUTE END THEN coalesce(stored_value, 0.0::DOUBLE)
               WHEN metric = 'events_per_minute' THEN round(coalesce(minute_events, 0)::DOUBLE, 2)
               WHEN metric = 'active_users_1h' THEN coalesce(hour_users, 0)::DOUBLE ELSE 0.0::DOUBLE END AS current_value
        FROM rules
        LEFT JOIN (SELECT client_id, metric_name AS metric, max(interval_start) AS stored_at,
                          arg_max(value, interval_start) AS stored_value
                   FROM agg WHERE interval_start >= TIMESTAMP '{AS_OF}' - INTERVAL 2 HOUR
                   AND interval_start < TIMESTAMP '{AS_OF}' GROUP BY ALL) s USING (client_id, metric)
        LEFT JOIN (SELECT client_id, count(*) FILTER (event_time >= TIMESTAMP '{AS_OF}' - INTERVAL 1 MINUTE) AS minute_events,
                          count(DISTINCT user_id) AS hour_users
                   FROM ev WHERE event_time >= TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR AND event_time < TIMESTAMP '{AS_OF}'
                   GROUP BY client_id) l USING (client_id)""",
    "met": """
        SELECT *, CASE operator WHEN '>' THEN current_value > threshold WHEN '<' THEN current_value < threshold
                  WHEN '>=' THEN current_value >= threshold WHEN '<=' THEN current_value <= threshold
                  WHEN '==' THEN abs(current_value - threshold) < 0.01
                  WHEN '!=' THEN abs(current_value - threshold) >= 0.01 ELSE false END AS met FROM valued""",
    "decided": f"""
        SELECT *, met AND coalesce(date_diff('second', last_triggered, TIMESTAMP '{AS_OF}') >= cooldown_seconds, true) AS fires,
               CASE WHEN NOT met THEN 'Condition not met' WHEN last_triggered IS NULL THEN 'Condition met'
                    WHEN date_diff('second', last_triggered, TIMESTAMP '{AS_OF}') >= cooldown_seconds
                        THEN 'Condition met, cooldown expired'
                    ELSE 'In cooldown (last triggered ' || date_diff('second', last_triggered, TIMESTAMP '{AS_OF}') || 's ago)'
               END AS reason FROM met""",
    "fired": f"""
        SELECT md5(id || '|' || epoch_us(TIMESTAMP '{AS_OF}')) AS history_id, *,
               printf('Alert ''%s'' triggered: %s %s %s (current: %.2f)', name, metric, operator, threshold::VARCHAR, current_value)
                   AS message,
               '{{"alert_id":"' || id || '","alert_name":"' || name || '","should_trigger":true,"current_value":' || current_value
                   || ',"threshold":' || threshold || ',"operator":"' || operator || '","reason":"' || reason || '"}}' AS context
        FROM decided WHERE fires""",
}


def with_views(body: str, *names: str, recursive: bool = False) -> str:
    """``body`` after the named views (and ``ev`` / ``reg``, on which the others rest)."""
    wanted = [v for v in VIEWS if v in names or v in ("ev", "reg")]
    views = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in wanted)
    return f"WITH {'RECURSIVE ' if recursive else ''}{views}{body if body.lstrip().startswith(',') else chr(10) + body}"


def plain_times(df: DataFrame) -> DataFrame:
    """Timestamps as UTC wall-clock values, the way the checking SQL has them."""
    return df.select(
        *[
            F.col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def query(name: str, sql: str | None = None, views: tuple[str, ...] = (), recursive: bool = False):
    """Register a query, and its SQL if the result can be stated in SQL."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        @wraps(build)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain_times(build(configure(spark), sf_dir))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = with_views(sql, *views, recursive=recursive)
        return build

    return register
