"""Explicit schemas (DDL) of every table; nothing is inferred."""

EVENTS = (
    "id STRING, client_id STRING NOT NULL, user_id STRING, event_name STRING NOT NULL, "
    "properties STRING, event_time TIMESTAMP NOT NULL, received_at TIMESTAMP NOT NULL"
)
EVENTS_STORED = (
    "id STRING, client_id STRING, user_id STRING, event_name STRING, properties STRING, "
    "event_time TIMESTAMP, received_at TIMESTAMP, event_date DATE, load_id STRING"
)
# one queued event as text; times stay text until structural_check
QUEUED_EVENT = (
    "id STRING, client_id STRING, user_id STRING, event_name STRING, properties STRING, "
    "event_time STRING, received_at STRING"
)
AGGREGATES = (
    "client_id STRING, metric_name STRING, interval_start TIMESTAMP, interval_end TIMESTAMP, "
    "value DOUBLE, meta_data STRING, created_at TIMESTAMP, updated_at TIMESTAMP"
)
RULES = (
    "id STRING, client_id STRING, name STRING, description STRING, "
    "expression STRUCT<metric: STRING, operator: STRING, threshold: DOUBLE, window: STRING>, "
    "severity STRING, enabled BOOLEAN, last_triggered TIMESTAMP, trigger_count INT, "
    "notification_channels STRUCT<websocket: BOOLEAN, email: ARRAY<STRING>>, "
    "cooldown_seconds INT, created_at TIMESTAMP, updated_at TIMESTAMP"
)
RULE_CHANGES = (
    "seq BIGINT, changed_at TIMESTAMP, action STRING, id STRING, client_id STRING, name STRING, "
    "description STRING, "
    "expression STRUCT<metric: STRING, operator: STRING, threshold: DOUBLE, window: STRING>, "
    "severity STRING, enabled BOOLEAN, "
    "notification_channels STRUCT<websocket: BOOLEAN, email: ARRAY<STRING>>, cooldown_seconds INT"
)
ALERT_HISTORY = (
    "id STRING, alert_id STRING, client_id STRING, triggered_at TIMESTAMP, severity STRING, "
    "message STRING, context STRING, notification_sent BOOLEAN"
)
REGISTRY = (
    "id STRING, client_name STRING, key_hash STRING, user_id STRING, rate_limit INT, "
    "is_active BOOLEAN, created_at TIMESTAMP"
)
REQUESTS = ("client_id STRING, epoch BIGINT, seq BIGINT")
SUBSCRIPTIONS = ("connection_id STRING, client_id STRING, channel STRING")

EVENT_COLUMNS = ["id", "client_id", "user_id", "event_name", "properties", "event_time", "received_at"]
