"""CSV exports with proper quoting."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def event_export(df: DataFrame) -> DataFrame:
    """Columns of the event browser's export."""
    return df.select(
        F.col("id").alias("ID"),
        F.col("event_name").alias("Event Name"),
        F.coalesce(F.nullif(F.col("user_id"), F.lit("")), F.lit("N/A")).alias("User ID"),
        F.date_format("event_time", TIME_FORMAT).alias("Event Time"),
        F.date_format("received_at", TIME_FORMAT).alias("Received At"),
        F.coalesce("properties", F.lit("{}")).alias("Properties"),
    )


def feed_export(df: DataFrame) -> DataFrame:
    """Columns of the live feed's export."""
    return df.select(
        F.date_format("received_at", TIME_FORMAT).alias("Timestamp"),
        F.coalesce("event_name", F.lit("Unknown")).alias("Event Name"),
        F.coalesce("user_id", F.lit("")).alias("User ID"),
        F.coalesce("properties", F.lit("")).alias("Properties"),
    )


def _write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def export_events_csv(df: DataFrame, path: str) -> None:
    _write_csv(event_export(df), path)


def export_feed_csv(df: DataFrame, path: str) -> None:
    _write_csv(feed_export(df), path)
