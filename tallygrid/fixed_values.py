"""Fixed values.

Everything in this module is part of the published behaviour (names, limits, defaults and
texts that callers see), so it must not be changed to suit the implementation.
"""

from __future__ import annotations

from datetime import timedelta

# --- fixed values: named periods -------------------------------------------------------
OVERVIEW_PERIODS = {
    "last_hour": timedelta(hours=1),
    "last_24h": timedelta(hours=24),
    "last_7d": timedelta(days=7),
}
ACTIVE_USER_PERIODS = {
    "1h": timedelta(hours=1),
    "24h": timedelta(hours=24),
    "7d": timedelta(days=7),
}
EXPLORE_PERIODS = {
    "last_hour": timedelta(hours=1),
    "last_24h": timedelta(hours=24),
    "last_7d": timedelta(days=7),
    "last_30d": timedelta(days=30),
}
SERIES_FOR_PERIOD = {
    "last_hour": "events_per_minute",
    "last_24h": "events_per_hour",
    "last_7d": "events_per_hour",
}

# --- fixed values: properties that may be grouped on -----------------------------------
BREAKDOWN_PROPERTIES = (
    "device", "browser", "os", "country", "city", "plan", "path",
    "referrer", "utm_source", "utm_campaign", "feature", "surface",
    "error_type", "severity", "endpoint", "method", "status_code",
    "billing_period", "payment_method", "reason", "role", "format",
)
DASHBOARD_PROPERTIES = ("device", "country", "plan")

# --- fixed values: limits and defaults -------------------------------------------------
MAX_NAME_LENGTH = 255
MAX_DESCRIPTION_LENGTH = 1000
MAX_PROPERTIES_LENGTH = 100000
MAX_BATCH_EVENTS = 1000
FUNNEL_STEPS = (2, 8)
TOP_EVENTS_LIMITS = (1, 100)
BREAKDOWN_LIMITS = (1, 50)
PAGE_LIMITS = (1, 1000)
HISTORY_LIMITS = (1, 500)
LIVE_TAIL_SIZE = 10000
SHARE_ITEMS = 8
AGGREGATE_RETENTION_DAYS = 30
EVENT_RETENTION_DAYS = 90
RATE_WINDOW_SECONDS = 60
DEFAULT_RATE_LIMIT = 1000

# --- fixed values: alert rules ---------------------------------------------------------
ALERT_OPERATORS = (">", "<", ">=", "<=", "==", "!=")
ALERT_SEVERITIES = ("info", "warning", "error", "critical")
ALERT_TOLERANCE = 0.01
ALERT_DEFAULT_WINDOW = "1m"
ALERT_DEFAULT_SEVERITY = "info"
ALERT_DEFAULT_COOLDOWN = 300
ALERT_MAX_COOLDOWN = 3600
ALERT_LOOKBACK = {
    "1m": timedelta(minutes=2),
    "5m": timedelta(minutes=10),
    "1h": timedelta(hours=2),
}
ALERT_DEFAULT_LOOKBACK = timedelta(minutes=2)
REASON_MET = "Condition met"
REASON_NOT_MET = "Condition not met"
REASON_COOLDOWN_EXPIRED = "Condition met, cooldown expired"
REASON_IN_COOLDOWN = "In cooldown (last triggered %ds ago)"
TRIGGER_MESSAGE = "Alert '%s' triggered: %s %s %s (current: %.2f)"

# --- fixed values: live channels -------------------------------------------------------
DEFAULT_CHANNELS = ("events", "metrics", "alerts")
NOTICE_CHANNEL = "rate_limit"
NOTICE_DELIVERY_CHANNEL = "events"
