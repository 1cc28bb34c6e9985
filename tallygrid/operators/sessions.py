"""Sessions: a user's events without a pause longer than ``gap`` between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallygrid.operators.filters import known_users

GAP = "30 minutes"


def sessions(events: DataFrame, gap: str = GAP) -> DataFrame:
    """``client_id``, ``user_id``, ``session_start``, ``session_end`` (the last event), ``events`` and ``names`` (distinct), in batch or stream.

    An event exactly ``gap`` after the one before still belongs to its session. With the library's settings, sessions are joined inside the tasks
    before the shuffle, so a busy user sends sessions, not events. Events without a user or a time belong to none."""
    rows = known_users(events).where(F.col("event_time").isNotNull())
    grouped = rows.groupBy("client_id", "user_id", F.session_window("event_time", gap).alias("session"))
    counted = grouped.agg(F.count("*").alias("events"), F.max("event_time").alias("session_end"), F.collect_set("event_name").alias("names"))
    return counted.select("client_id", "user_id", F.col("session.start").alias("session_start"), "session_end", "events", F.size("names").alias("names"))


def session_figures(found: DataFrame) -> DataFrame:
    """Per tenant: ``sessions``, ``events``, ``seconds`` in all, and ``bounced``, the sessions of one event."""
    seconds = F.unix_seconds("session_end") - F.unix_seconds("session_start")
    return found.groupBy("client_id").agg(
        F.count("*").alias("sessions"), F.sum("events").alias("events"), F.sum(seconds).alias("seconds"), F.count_if(F.col("events") == 1).alias("bounced")
    )
