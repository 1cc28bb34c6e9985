"""Streaming jobs.

Sinks are idempotent per micro-batch of one checkpoint: batch *n* writes folders named after *n*, and job state
that is a table (rules, rate entries, feed tail) goes from version *n* to *n + 1*. A batch that is
run again after a failure therefore replaces what it wrote before. Ingest jobs may share a table: their loads are
named after the checkpoint's query id too. State tables belong to one checkpoint.

``once=True`` works off everything that is there and stops (bounded catch-up); otherwise the
query keeps running with the given trigger interval.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tallygrid.fixed_values import LIVE_TAIL_SIZE, RATE_WINDOW_SECONDS
from tallygrid.functions.times import Instant, at
from tallygrid.operators import alerts, fanout, ingest, ratelimit
from tallygrid.operators.filters import known_users, newest_per_group
from tallygrid.operators.sessions import GAP, sessions
from tallygrid.sources import storage
from tallygrid.sources.buckets import BucketLog, fold_late
from tallygrid.sources.readers import read_aggregates
from tallygrid.sources.snapshots import SeriesLog

LATENESS = "10 minutes"
VERSION = "version"


def start(
    stream: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    once: bool = True,
    every: str = "1 minute",
    mode: str = "append",
) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def progress(query: StreamingQuery) -> dict:
    """Batches done and rows read, from the last progress report."""
    last = query.lastProgress
    return {"batch": last["batchId"], "rows": last["numInputRows"]} if last else {"batch": None, "rows": 0}


def _replace_folder(df: DataFrame, path: str, column: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/{column}={batch_id}")


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a checkpoint gives its query, the same at every restart."""
    return spark.read.schema("id STRING").json(f"{checkpoint}/metadata").first()["id"]


# --- versioned state tables -------------------------------------------------------------


def seed_state(df: DataFrame, path: str) -> None:
    """Version 0 of a state table."""
    _replace_folder(df, path, VERSION, 0)


def _state_before(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """The newest version that batch ``batch_id`` may see, or None."""
    versions = [int(v) for v in storage.partition_values(spark, path, VERSION) if int(v) <= batch_id]
    return spark.read.parquet(f"{path}/{VERSION}={max(versions)}") if versions else None


def _state_after(df: DataFrame, path: str, batch_id: int) -> None:
    """Write the version that follows batch ``batch_id``; the one before it stays for a re-run."""
    spark = df.sparkSession
    _replace_folder(df, path, VERSION, batch_id + 1)
    earlier = sorted(int(v) for v in storage.partition_values(spark, path, VERSION) if int(v) <= batch_id)
    for version in earlier[:-1]:
        storage.drop_partition(spark, path, VERSION, str(version))


def read_state(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version of a state table."""
    versions = [int(v) for v in storage.partition_values(spark, path, VERSION)]
    return spark.read.parquet(f"{path}/{VERSION}={max(versions)}") if versions else None


# --- ingest -----------------------------------------------------------------------------


def stream_ingest(
    lines: DataFrame,
    registry: DataFrame,
    events_path: str,
    quarantine_path: str,
    checkpoint: str,
    policy: str = ingest.REJECT_BATCH,
    name: str | None = None,
    **options,
) -> StreamingQuery:
    """Check incoming envelopes, store the good events, keep the refused ones with reasons.

    The receipt time is the micro-batch's own timestamp, which a re-run repeats, and so do event ids. Loads and
    quarantine folders are named after ``name``, by default the query id in the checkpoint; jobs that share
    a table must not share a name.
    """
    checked = ingest.check_batches(lines, registry, policy)

    def handle(batch: DataFrame, batch_id: int) -> None:
        load = f"{name or query_id(batch.sparkSession, checkpoint)}-{batch_id}"
        batch.persist()
        storage.append_events(ingest.unique_ids(ingest.accepted(batch), load), events_path, load)
        ingest.quarantined(batch).write.mode("overwrite").parquet(f"{quarantine_path}/load={load}")
        batch.unpersist()

    return start(checked, handle, checkpoint, **options)


# --- roll-ups ---------------------------------------------------------------------------


def _as_metric(rows: DataFrame, metric: str, value, meta) -> DataFrame:
    now = F.current_timestamp()
    return rows.select(
        "client_id",
        F.lit(metric).alias("metric_name"),
        F.col("window.start").alias("interval_start"),
        F.col("window.end").alias("interval_end"),
        value.cast("double").alias("value"),
        meta.alias("meta_data"),
        now.alias("created_at"),
        now.alias("updated_at"),
    )


def stream_rollup(events: DataFrame, minutes: int = 1, lateness: str = LATENESS) -> DataFrame:
    """Closed windows of 1 or 60 minutes as ``events_per_minute`` or ``events_per_hour`` rows.

    Partial counts are combined before the shuffle. Only non-empty windows appear.
    """
    if minutes not in (1, 60):
        raise ValueError("minutes must be 1 or 60")
    counted = (
        events.withWatermark("event_time", lateness)
        .groupBy("client_id", F.window("event_time", f"{minutes} minutes"))
        .agg(F.count("*").alias("count"))
    )
    rate = F.round(F.col("count") / F.lit(float(minutes)), 2)
    metric, value = ("events_per_minute", rate) if minutes == 1 else ("events_per_hour", rate * 60)
    return _as_metric(counted, metric, value, F.to_json(F.struct("count")))


def stream_active_users(events: DataFrame, minutes: int = 1, lateness: str = LATENESS) -> DataFrame:
    """Closed windows with their exact number of distinct users.

    First one row per (tenant, user, window), which spreads a busy tenant over all tasks, then a
    count of those rows per window.
    """
    if minutes not in (1, 60):
        raise ValueError("minutes must be 1 or 60")
    length = f"{minutes} minutes"
    seen = (
        known_users(events.withWatermark("event_time", lateness))
        .groupBy("client_id", "user_id", F.window("event_time", length))
        .agg(F.count("*").alias("events"))
    )
    users = seen.groupBy("client_id", F.window(F.window_time("window"), length)).agg(F.count("*").alias("users"))
    metric = "active_users_1m" if minutes == 1 else "active_users_1h"
    return _as_metric(users, metric, F.col("users"), F.lit("{}"))


def stream_upsert(rows: DataFrame, aggregates_path: str, checkpoint: str, **options) -> StreamingQuery:
    """Fold a stream of metric rows into the series table; a re-run leaves the same table."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        storage.merge_aggregates(batch.sparkSession, aggregates_path, batch)

    return start(rows, handle, checkpoint, **options)


def stream_series_log(rows: DataFrame, path: str, checkpoint: str, compact_every: int = 8, **options) -> StreamingQuery:
    """Fold a stream of metric rows into a ``SeriesLog``: each micro-batch writes its own rows, a re-run replaces its delta, and
    every ``compact_every``-th batch merges the days that have collected several."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        log = SeriesLog(batch.sparkSession, path)
        log.merge(batch, f"{query_id(batch.sparkSession, checkpoint)}-{batch_id}")
        if (batch_id + 1) % compact_every == 0:
            log.compact()

    return start(rows, handle, checkpoint, **options)


def stream_late_rollups(
    events: DataFrame, log_path: str, series_path: str, registry: DataFrame, tick: Instant, checkpoint: str, compact_every: int = 8, **options
) -> StreamingQuery:
    """Roll up a stream by hour without a watermark: each micro-batch adds its signed changes to a ``BucketLog`` and renews the hours that it
    touches in a ``SeriesLog``, however late its events are. A re-run changes nothing; the batch at hand is never merged."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        log, series = BucketLog(spark, log_path), SeriesLog(spark, series_path)
        load = f"{query_id(spark, checkpoint)}-{batch_id}"
        fold_late(log, series, batch, load, registry, tick)
        if (batch_id + 1) % compact_every == 0:
            log.compact(spared={load})
            series.compact()

    return start(events, handle, checkpoint, **options)


# --- sessions ---------------------------------------------------------------------------


def stream_sessions(events: DataFrame, path: str, checkpoint: str, gap: str = GAP, lateness: str = LATENESS, **options) -> StreamingQuery:
    """Store sessions once they are over: those whose last event lies ``gap`` and ``lateness`` behind the newest event. A re-run
    of a micro-batch replaces its folder."""
    found = sessions(events.withWatermark("event_time", lateness), gap)

    def handle(batch: DataFrame, batch_id: int) -> None:
        _replace_folder(batch, path, "batch", batch_id)

    return start(found, handle, checkpoint, **options)


# --- alerts -----------------------------------------------------------------------------


def stream_alerts(
    rows: DataFrame,
    registry: DataFrame,
    rules_path: str,
    aggregates_path: str,
    history_path: str,
    notifications_path: str,
    checkpoint: str,
    events: DataFrame | None = None,
    **options,
) -> StreamingQuery:
    """Fold metric rows into the series, then decide all rules at each window end that closed, in order.

    ``rules_path`` is a state table (see ``seed_state``) that carries last_triggered and
    trigger_count from batch to batch. ``events`` (a table) stands in for metrics that are not stored. How windows are
    cut into micro-batches makes no difference.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with storage.staged(batch, "metric-rows") as rows_in:
            ends = rows_in.select(F.unix_micros("interval_end").alias("micros")).distinct().collect()
            if not ends:
                return
            storage.merge_aggregates(spark, aggregates_path, rows_in)
        moments = [at("1970-01-01") + timedelta(microseconds=row["micros"]) for row in ends]
        rules = _state_before(spark, rules_path, batch_id)
        if rules is None:
            raise ValueError(f"{rules_path} holds no rules that batch {batch_id} may see: seed it, one state table per checkpoint")
        due, idle = alerts.split_due_rules(rules, registry)
        decided = alerts.evaluate_windows(due, read_aggregates(spark, aggregates_path), events, moments)
        # a row a rule; decisions that do not fire have no reader
        with storage.staged(alerts.firings(decided), "decisions") as decisions:
            history, updated = alerts.fire_windows(decisions)
            notifications = alerts.notification_rows(history, updated)
            _replace_folder(alerts.mark_notified(history, notifications), history_path, "batch", batch_id)
            _replace_folder(notifications, notifications_path, "batch", batch_id)
            _state_after(updated.unionByName(idle), rules_path, batch_id)

    return start(rows, handle, checkpoint, **options)


# --- rate decisions ---------------------------------------------------------------------


def stream_admit(
    requests: DataFrame,
    limits: DataFrame,
    decisions_path: str,
    entries_path: str,
    checkpoint: str,
    window: int = RATE_WINDOW_SECONDS,
    mode: str = ratelimit.PER_REQUEST,
    lateness: int | None = None,
    late_path: str | None = None,
    **options,
) -> StreamingQuery:
    """Decide every request of each micro-batch, carrying the entries still in the window.

    State per key is at most one row per second of ``window + lateness`` (two windows by default), held as a table,
    and the decision itself is the batch operator. Requests that come later than ``lateness`` are not decided
    but kept with a reason in ``late_path`` (by default beside the decisions).
    """
    late_path = late_path or f"{decisions_path}-late"

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with storage.staged(batch.filter("client_id IS NOT NULL AND epoch IS NOT NULL"), "requests") as new:
            if new.isEmpty():
                return
            carry = _state_before(spark, entries_path, batch_id)
            due, late = ratelimit.split_late(new, carry, window, lateness)
            _replace_folder(late, late_path, "batch", batch_id)
            _replace_folder(ratelimit.admit(due, limits, window, mode, carry), decisions_path, "batch", batch_id)
        decided = spark.read.parquet(f"{decisions_path}/batch={batch_id}")
        _state_after(ratelimit.carry_after(decided, carry, window, mode, lateness), entries_path, batch_id)

    return start(requests, handle, checkpoint, **options)


# --- live feed --------------------------------------------------------------------------


def stream_fanout(events: DataFrame, feed_path: str, checkpoint: str, **options) -> StreamingQuery:
    """Deliverable messages, each stored once, in folders by batch and channel.

    A connection's feed is resolved when it is read (``read_feed``), so storage does not grow with connections.
    """
    messages = fanout.fanout_events(events, delivered=True, keep=("id",))

    def handle(batch: DataFrame, batch_id: int) -> None:
        numbered = batch.withColumn("batch", F.lit(batch_id)).sortWithinPartitions("channel", "client_id")
        storage.overwrite_partitions(numbered, feed_path, "batch", "channel")

    return start(messages, handle, checkpoint, **options)


def read_feed(spark: SparkSession, feed_path: str, subscriptions: DataFrame) -> DataFrame:
    """The stored messages of the given subscriptions' connections: connection_id, client_id, id, message, batch, channel."""
    columns = "client_id STRING, message STRING, id STRING, batch INT, channel STRING"
    return fanout.route_messages(spark.read.schema(columns).parquet(feed_path), subscriptions)


def stream_tail(
    events: DataFrame, tail_path: str, checkpoint: str, n: int = LIVE_TAIL_SIZE, **options
) -> StreamingQuery:
    """Keeps the newest ``n`` events per tenant and its running total as a state table."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = _state_before(spark, tail_path, batch_id)
        with storage.staged(batch, "tail-input") as new:
            rows, totals = new, new.groupBy("client_id").agg(F.count("*").alias("total"))
            if before is not None:
                rows = rows.unionByName(before.drop("position", "total"))
                earlier = before.groupBy("client_id").agg(F.max("total").alias("total"))
                totals = totals.unionByName(earlier).groupBy("client_id").agg(F.sum("total").alias("total"))
            newest = newest_per_group(rows, ["client_id"], "received_at", ["id"], n, "position")
            _state_after(newest.join(totals, "client_id"), tail_path, batch_id)

    return start(events, handle, checkpoint, **options)
