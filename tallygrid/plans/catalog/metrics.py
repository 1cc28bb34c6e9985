"""Event metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrid.fixed_values import ACTIVE_USER_PERIODS, EXPLORE_PERIODS
from tallygrid.functions import compare_alert, compare_exact, json_property, split_steps, window_bounds
from tallygrid.operators import metrics, rollups
from tallygrid.operators.filters import browse_filter, in_window, known_users, list_keys, list_rules
from tallygrid.plans.catalog.common import AS_OF, query
from tallygrid.plans.dashboard import dashboard_bundle
from tallygrid.sources import adapter

T = f"TIMESTAMP '{AS_OF}'"
DAY = f"event_time >= {T} - INTERVAL 24 HOUR AND event_time < {T}"
WEEK = f"event_time >= {T} - INTERVAL 7 DAY AND event_time < {T}"
MONTH = f"event_time >= {T} - INTERVAL 30 DAY AND event_time < {T}"
STEPS = "view, click, signup, purchase"
TEST_PROPERTIES = ("k",)


def _bounds(period: str):
    return window_bounds(period, AS_OF, EXPLORE_PERIODS)


@query("event_rate", f"""
SELECT act.client_id, count(ev.id) AS count, round(count(ev.id) / 1440.0::DOUBLE, 2) AS rate,
       {T} - INTERVAL 24 HOUR AS interval_start, {T} AS interval_end
FROM act LEFT JOIN ev ON ev.client_id = act.client_id AND {DAY} GROUP BY act.client_id
""", ("act",))
def event_rate(spark, sf):
    return metrics.event_rate(adapter.events(spark, sf), *_bounds("last_24h"), adapter.registry(spark, sf))


@query("active_users", f"""
SELECT act.client_id, count(DISTINCT ev.user_id) AS active_users
FROM act LEFT JOIN ev ON ev.client_id = act.client_id AND {WEEK} GROUP BY act.client_id
""", ("act",))
def active_users(spark, sf):
    bounds = window_bounds("7d", AS_OF, ACTIVE_USER_PERIODS)
    return metrics.active_users(adapter.events(spark, sf), *bounds, adapter.registry(spark, sf))


TOP_SQL = """
, counted AS (SELECT client_id, event_name, count(*) AS count FROM ev WHERE {where} GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY client_id ORDER BY count DESC, event_name) AS INTEGER) AS rank
           FROM counted),
top AS (SELECT *, round(count / sum(count) OVER (PARTITION BY client_id) * 100, 2) AS percentage
        FROM ranked WHERE rank <= {n})
"""


@query("top_events", TOP_SQL.format(where=WEEK, n=3) + "SELECT * FROM top")
def top_events(spark, sf):
    return metrics.top_events(adapter.events(spark, sf), *_bounds("last_7d"), n=3)


@query("event_type_count", f"""
SELECT client_id, count(DISTINCT event_name) AS unique_event_types FROM ev WHERE {DAY} GROUP BY client_id""")
def event_type_count(spark, sf):
    return metrics.event_type_count(adapter.events(spark, sf), *_bounds("last_24h"))


def overview_query(period: str):
    def build(spark, sf):
        found = metrics.overview(
            adapter.events(spark, sf), period, as_of=AS_OF, registry=adapter.registry(spark, sf)
        )
        # the nested list as text, so that the comparison needs no nested types
        line = lambda e: F.concat_ws(":", e["event_name"], e["count"].cast("string"), e["percentage"].cast("string"))
        return found.withColumn("top_events", F.array_join(F.transform("top_events", line), ";"))

    return build


def overview_sql(period: str, interval: str, minutes: int) -> str:
    window = f"event_time >= {T} - INTERVAL {interval} AND event_time < {T}"
    return TOP_SQL.format(where=window, n=5) + f""",
lists AS (SELECT client_id, string_agg(event_name || ':' || count || ':' || percentage, ';' ORDER BY rank) AS five
          FROM top GROUP BY client_id),
totals AS (SELECT client_id, count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT event_name) AS types
           FROM ev WHERE {window} GROUP BY client_id)
SELECT client_id, '{period}' AS period, coalesce(n, 0) AS total_events,
       round(coalesce(n, 0) / {minutes}.0::DOUBLE, 2) AS events_per_minute, coalesce(users, 0) AS active_users,
       coalesce(types, 0) AS unique_event_types, coalesce(five, '') AS top_events,
       {T} - INTERVAL {interval} AS start_time, {T} AS end_time
FROM act LEFT JOIN totals USING (client_id) LEFT JOIN lists USING (client_id)
"""


query("overview_last_hour", overview_sql("last_hour", "1 HOUR", 60), ("act",))(overview_query("last_hour"))
query("overview", overview_sql("last_24h", "24 HOUR", 1440), ("act",))(overview_query("last_24h"))
query("overview_last_7d", overview_sql("last_7d", "7 DAY", 10080), ("act",))(overview_query("last_7d"))


BREAKDOWN_SQL = """
, counted AS (SELECT client_id, properties->>'k' AS label, count(*) AS count, count(DISTINCT user_id) AS users
              FROM ev WHERE {where} AND properties->>'k' IS NOT NULL GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY client_id ORDER BY count DESC, label) AS INTEGER) AS rank
           FROM counted),
top AS (SELECT client_id, 'k' AS property, rank, label, count, users,
               round(count / sum(count) OVER (PARTITION BY client_id) * 100, 2) AS percentage,
               CAST(sum(count) OVER (PARTITION BY client_id) AS BIGINT) AS total
        FROM ranked WHERE rank <= {n})
"""


@query("breakdown", BREAKDOWN_SQL.format(where=WEEK, n=12) + "SELECT * FROM top")
def breakdown(spark, sf):
    return metrics.breakdown(adapter.events(spark, sf), "k", *_bounds("last_7d"), allowed=TEST_PROPERTIES)


@query("breakdown_one_event", BREAKDOWN_SQL.format(where=f"{MONTH} AND event_name = 'click'", n=50) + "SELECT * FROM top")
def breakdown_one_event(spark, sf):
    return metrics.breakdown(
        adapter.events(spark, sf), "k", *_bounds("last_30d"), event_name="click", n=50, allowed=TEST_PROPERTIES
    )


@query("share", BREAKDOWN_SQL.format(where=WEEK, n=12) + """
SELECT *, round(CAST(count AS DOUBLE) / total * 100, 1) AS share FROM top WHERE rank <= 8""")
def share(spark, sf):
    items = breakdown(spark, sf)
    return metrics.share_of_total(items, ["client_id", "property"], total="total", keep=8)


def funnel_sql(where: str) -> str:
    flags = ", ".join(
        f"bool_or(event_name = '{s}') AS f{i}" for i, s in enumerate(split_steps(STEPS))
    )
    counts = ", ".join(
        "count(*) FILTER (" + " AND ".join(f"f{j}" for j in range(i + 1)) + f") AS n{i}" for i in range(4)
    )
    rows = " UNION ALL ".join(
        f"""SELECT client_id, CAST({i + 1} AS INTEGER) AS step_number, '{s}' AS step, coalesce(n{i}, 0) AS users,
            CASE WHEN n0 > 0 THEN round(n{i}::DOUBLE / n0 * 100, 2) ELSE 0.0::DOUBLE END AS conversion_from_start,
            {'100.0::DOUBLE' if i == 0 else f'CASE WHEN n{i - 1} > 0 THEN round(n{i}::DOUBLE / n{i - 1} * 100, 2) ELSE 0.0::DOUBLE END'}
                AS conversion_from_previous,
            {'0::BIGINT' if i == 0 else f'coalesce(n{i - 1} - n{i}, 0)'} AS dropped,
            CASE WHEN n0 > 0 THEN round(n3::DOUBLE / n0 * 100, 2) ELSE 0.0::DOUBLE END AS overall_conversion
            FROM totals"""
        for i, s in enumerate(split_steps(STEPS))
    )
    return f"""
, flags AS (SELECT client_id, user_id, {flags} FROM ev WHERE {where} AND user_id IS NOT NULL GROUP BY ALL),
counts AS (SELECT client_id, {counts} FROM flags GROUP BY client_id),
totals AS (SELECT * FROM act LEFT JOIN counts USING (client_id))
{rows}"""


@query("funnel", funnel_sql(DAY), ("act",))
def funnel(spark, sf):
    return metrics.funnel(
        adapter.events(spark, sf), split_steps(STEPS), *_bounds("last_24h"), adapter.registry(spark, sf)
    )


@query("funnel_last_30d", funnel_sql(MONTH), ("act",))
def funnel_last_30d(spark, sf):
    return metrics.funnel(
        adapter.events(spark, sf), split_steps(STEPS), *_bounds("last_30d"), adapter.registry(spark, sf)
    )


@query("dataset_summary", f"""
SELECT 'events_total' AS section, '' AS name, count(*) AS value FROM ev
UNION ALL SELECT 'last_hour', '', count(*) FILTER (event_time > {T} - INTERVAL 1 HOUR) FROM ev
UNION ALL SELECT 'unique_users', '', count(DISTINCT user_id) FROM ev
UNION ALL SELECT 'event_name', event_name, count(*) FROM ev GROUP BY event_name""")
def dataset_summary(spark, sf):
    return metrics.dataset_summary(adapter.events(spark, sf), AS_OF)


@query("platform_counts", """
SELECT (SELECT count(*) FROM ev) AS total_events, (SELECT count(*) FROM act) AS active_clients,
       (SELECT count(*) FROM customer WHERE c_custkey % 7 <> 0) AS active_alerts""", ("act",))
def platform_counts(spark, sf):
    return metrics.platform_counts(adapter.events(spark, sf), adapter.registry(spark, sf), adapter.rules(spark, sf))


@query("key_usage", f"""
SELECT reg.id, client_name, rate_limit,
       count(*) FILTER (received_at >= {T} - INTERVAL 1 DAY AND received_at < {T}) AS requests_today,
       max(received_at) AS last_used
FROM reg LEFT JOIN ev ON ev.client_id = reg.id GROUP BY ALL""")
def key_usage(spark, sf):
    return metrics.key_usage(adapter.events(spark, sf), adapter.registry(spark, sf), "2024-01-30")


@query("key_usage_kept", f"""
SELECT reg.id, client_name, rate_limit,
       count(*) FILTER (received_at >= {T} - INTERVAL 1 DAY AND received_at < {T}) AS requests_today,
       max(received_at) AS last_used
FROM reg LEFT JOIN ev ON ev.client_id = reg.id GROUP BY ALL""")
def key_usage_kept(spark, sf):
    """The same figures with a last-seen table kept up over two loads."""
    events = adapter.events(spark, sf)
    early = F.col("received_at") < F.to_timestamp(F.lit("2024-01-15"))
    seen = metrics.last_seen(events.filter(~early), metrics.last_seen(events.filter(early)))
    return metrics.key_usage(events, adapter.registry(spark, sf), "2024-01-30", seen)


@query("dashboard_bundle", TOP_SQL.format(where=DAY, n=5) + BREAKDOWN_SQL.format(where=DAY, n=6).replace(
    "counted AS", "label_counts AS").replace("ranked AS", "label_ranks AS").replace("top AS", "labels AS").replace(
    "FROM counted", "FROM label_counts").replace("FROM ranked", "FROM label_ranks") + f"""
, totals AS (SELECT client_id, count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT event_name) AS types
             FROM ev WHERE {DAY} GROUP BY client_id),
figures AS (
    SELECT client_id, 1 AS position, 'total_events' AS label, CAST(n AS DOUBLE) AS value FROM totals
    UNION ALL SELECT client_id, 2, 'events_per_minute', round(n / 1440.0::DOUBLE, 2) FROM totals
    UNION ALL SELECT client_id, 3, 'active_users', CAST(users AS DOUBLE) FROM totals
    UNION ALL SELECT client_id, 4, 'unique_event_types', CAST(types AS DOUBLE) FROM totals)
SELECT client_id, 'overview' AS panel, CAST(position AS INTEGER) AS position, label, value,
       CAST(NULL AS BIGINT) AS users, CAST(NULL AS DOUBLE) AS percentage FROM figures
UNION ALL SELECT client_id, 'top_events', rank, event_name, CAST(count AS DOUBLE), NULL, percentage FROM top
UNION ALL SELECT client_id, 'series', NULL, strftime(interval_start, '%Y-%m-%d %H:%M'), value, NULL, NULL
          FROM agg WHERE metric_name = 'events_per_hour' AND interval_start > {T} - INTERVAL 24 HOUR AND interval_start < {T}
UNION ALL SELECT client_id, property, rank, label, CAST(count AS DOUBLE), users, percentage FROM labels""", ("agg",))
def bundle(spark, sf):
    events = adapter.events(spark, sf)
    stored = rollups.rollup_backfill(events, AS_OF)
    return dashboard_bundle(events, stored, "last_24h", as_of=AS_OF, props=TEST_PROPERTIES, allowed=TEST_PROPERTIES)


@query("in_window", f"SELECT * FROM ev WHERE event_time >= TIMESTAMP '2024-01-10' AND event_time < TIMESTAMP '2024-01-12'")
def window_rows(spark, sf):
    return in_window(adapter.events(spark, sf), "2024-01-10", "2024-01-12")


@query("browse_filter", "SELECT * FROM ev WHERE event_name = 'purchase' AND user_id = '7'")
def browse(spark, sf):
    return known_users(browse_filter(adapter.events(spark, sf), "purchase", "7"))


@query("json_property", "SELECT id, properties->>'k' AS k, properties->>'missing' AS missing FROM ev")
def properties(spark, sf):
    text = F.col("properties")
    return adapter.events(spark, sf).select("id", json_property(text, "k").alias("k"), json_property(text, "missing").alias("missing"))


# every event's k is compared with its user number by one of seven operators
COMPARE_SQL = """
, pairs AS (SELECT id, CAST(properties->>'k' AS DOUBLE) AS value, CAST(user_id AS DOUBLE) AS threshold,
            (['>', '<', '>=', '<=', '==', '!=', '~'])[CAST(id AS BIGINT) % 7 + 1] AS operator FROM ev)
SELECT id, operator,
  CASE operator WHEN '>' THEN value > threshold WHEN '<' THEN value < threshold WHEN '>=' THEN value >= threshold
       WHEN '<=' THEN value <= threshold WHEN '==' THEN value = threshold ELSE false END AS exact,
  CASE operator WHEN '>' THEN value > threshold WHEN '<' THEN value < threshold WHEN '>=' THEN value >= threshold
       WHEN '<=' THEN value <= threshold WHEN '==' THEN abs(value - threshold) < 0.01
       WHEN '!=' THEN abs(value - threshold) >= 0.01 ELSE false END AS tolerant
FROM pairs"""


@query("compare_conditions", COMPARE_SQL)
def compare_conditions(spark, sf):
    operators = F.array(*[F.lit(op) for op in (">", "<", ">=", "<=", "==", "!=", "~")])
    pairs = adapter.events(spark, sf).select(
        "id",
        json_property(F.col("properties"), "k").cast("double").alias("value"),
        F.col("user_id").cast("double").alias("threshold"),
        F.element_at(operators, (F.col("id").cast("bigint") % 7 + 1).cast("int")).alias("operator"),
    )
    sides = F.col("value"), F.col("operator"), F.col("threshold")
    return pairs.select("id", "operator", compare_exact(*sides).alias("exact"), compare_alert(*sides).alias("tolerant"))


@query("list_keys", "SELECT id, client_name, rate_limit, is_active FROM reg WHERE user_id = 'owner-0'")
def keys(spark, sf):
    return list_keys(adapter.registry(spark, sf), "owner-0").select("id", "client_name", "rate_limit", "is_active")


@query("list_rules", """
SELECT 'rule-' || c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 5 = 2 AND c_custkey % 7 <> 0""")
def rules_of_tenant(spark, sf):
    return list_rules(adapter.rules(spark, sf), "2", enabled=True).select("id", "name")
