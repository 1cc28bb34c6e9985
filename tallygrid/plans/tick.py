"""The scheduled jobs over the stored tables: roll-up, upsert, alerts, retention."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tallygrid.functions.times import Instant
from tallygrid.operators.alerts import (
    evaluate_rules,
    fire_rules,
    mark_notified,
    notification_rows,
    split_due_rules,
)
from tallygrid.operators.rollups import rollup_hour, rollup_minute
from tallygrid.session import new_run_dir
from tallygrid.sources.storage import delete_folder, merge_aggregates


@dataclass(frozen=True)
class AlertRun:
    decisions: DataFrame
    history: DataFrame
    notifications: DataFrame
    rules: DataFrame
    written: str

    def discard(self) -> None:
        """Remove the written decisions, once the four results have been stored."""
        delete_folder(self.rules.sparkSession, self.written)


def run_rollups(
    spark: SparkSession,
    events: DataFrame,
    registry: DataFrame,
    aggregates_path: str,
    tick: Instant,
    minutes: int = 1,
    hours: int = 0,
) -> None:
    """Fold the last whole minutes and hours into the series table.

    A larger horizon re-rolls earlier intervals, which picks up late events.
    """
    updates = rollup_minute(events, registry, tick, minutes)
    if hours:
        updates = updates.unionByName(rollup_hour(events, registry, tick, hours))
    merge_aggregates(spark, aggregates_path, updates)


def run_alerts(
    rules: DataFrame, registry: DataFrame, aggregates: DataFrame, events: DataFrame | None, as_of: Instant
) -> AlertRun:
    """Decide every due rule once and derive history, notifications and the new rule table.

    The decisions are written out first, so the four results come from one evaluation; ``discard`` removes
    them afterwards.
    """
    spark = rules.sparkSession
    due, idle = split_due_rules(rules, registry)
    decided, written = evaluate_rules(due, aggregates, events, as_of), new_run_dir(spark, "decisions")
    decided.write.parquet(written)
    decisions = spark.read.schema(decided.schema).parquet(written)
    history, updated = fire_rules(decisions, as_of)
    notifications = notification_rows(history, updated)
    return AlertRun(
        decisions, mark_notified(history, notifications), notifications, updated.unionByName(idle), written
    )
