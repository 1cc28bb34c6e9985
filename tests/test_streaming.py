"""Late data, repeated batches and state carried from batch to batch."""

import json
from datetime import timedelta

import pytest
from instants import utc
from test_alerts import rule

from tallygrid.operators.ratelimit import DISTINCT_SECOND, PER_REQUEST
from tallygrid.plans.catalog.streams import EVENT_DDL
from tallygrid.schemas import REQUESTS, RULES
from tallygrid.session import new_run_dir
from tallygrid.sources import readers
from tallygrid.streaming import jobs
from test_ratelimit import bursty, limits_frame, simulate


def dirs(spark, *names):
    return [new_run_dir(spark, n) for n in names]


def arrive(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


def event_stream(spark, path):
    return spark.readStream.schema(EVENT_DDL).parquet(path)


def points(df):
    return sorted((r["client_id"], r["metric_name"], r["interval_start"].isoformat()[11:16], r["value"]) for r in df.collect())


def test_rollup_drops_too_late_events_and_keeps_open_windows_back(spark, make_events):
    source, table, checkpoint = dirs(spark, "in", "out", "check")
    arrivals = [
        [("a", "u", "x", "2024-01-01 10:00:10"), ("a", "v", "x", "2024-01-01 10:00:50"), ("a", "u", "x", "2024-01-01 10:05:00")],
        [("a", "u", "x", "2024-01-01 10:04:00"), ("a", "u", "x", "2024-01-01 10:20:00")],  # four minutes late: counted
        [("a", "u", "x", "2024-01-01 10:00:20"), ("a", "u", "x", "2024-01-01 10:21:00")],  # too late: dropped
    ]
    for rows in arrivals:
        arrive(make_events(rows), source)
        jobs.stream_upsert(jobs.stream_rollup(event_stream(spark, source)), table, checkpoint).awaitTermination()
    assert points(readers.read_aggregates(spark, table)) == [
        ("a", "events_per_minute", "10:00", 2.0), ("a", "events_per_minute", "10:04", 1.0), ("a", "events_per_minute", "10:05", 1.0)]


def test_active_users_are_distinct_and_known(spark, make_events):
    source, table, checkpoint = dirs(spark, "in", "out", "check")
    rows = [("a", u, "x", f"2024-01-01 10:00:{s:02}") for s, u in enumerate(["u", "u", "v", None, "w", "v"])]
    arrive(make_events(rows + [("b", "u", "x", "2024-01-01 10:00:30"), ("a", "u", "x", "2024-01-01 12:00:00")]), source)
    jobs.stream_upsert(jobs.stream_active_users(event_stream(spark, source)), table, checkpoint).awaitTermination()
    assert points(readers.read_aggregates(spark, table)) == [("a", "active_users_1m", "10:00", 3.0), ("b", "active_users_1m", "10:00", 1.0)]


def test_only_minutes_and_hours(spark, make_events):
    with pytest.raises(ValueError):
        jobs.stream_rollup(make_events([]), 5)


@pytest.mark.parametrize("mode", [PER_REQUEST, DISTINCT_SECOND])
def test_admit_equals_request_by_request(spark, mode):
    rows, limits = bursty(11, n=240), {"a": 2, "b": 1, "hot": 8}
    source, decisions, entries, checkpoint = dirs(spark, "in", "decisions", "entries", "check")
    for part in (rows[:80], rows[80:95], rows[95:]):
        arrive(spark.createDataFrame(part, REQUESTS), source)
        stream = spark.readStream.schema(REQUESTS).parquet(source)
        jobs.stream_admit(stream, limits_frame(spark, limits), decisions, entries, checkpoint, mode=mode).awaitTermination()
    found = {(r["client_id"], r["epoch"], r["seq"]): (r["allowed"], r["current"], r["limit"], r["remaining"], r["reset_at"])
             for r in spark.read.parquet(decisions).collect()}
    assert found == simulate(rows, limits, mode=mode)


def test_alert_cooldown_spans_batches(spark, make_events, registry):
    source, rules, table, history, sent, checkpoint = dirs(spark, "in", "rules", "agg", "history", "sent", "check")
    # fires at the first closed minute, is cooling at the next, fires again after the cooldown
    jobs.seed_state(spark.createDataFrame([rule("r", metric="events_per_minute", op=">=", threshold=1.0, cooldown=120),
                                           rule("off", metric="events_per_minute", op=">=", enabled=False)], RULES), rules)
    first = utc("2024-01-01 10:00:30").replace(tzinfo=None)
    for minute in range(0, 6):
        arrive(make_events([("a", "u", "x", (first + timedelta(minutes=minute)).isoformat())]), source)
        stream = jobs.stream_rollup(event_stream(spark, source), lateness="0 seconds")
        jobs.stream_alerts(stream, registry, rules, table, history, sent, checkpoint).awaitTermination()
    fired = sorted(r["triggered_at"].isoformat()[11:16] for r in spark.read.parquet(history).collect())
    assert fired == ["10:01", "10:03", "10:05"]
    state = {r["id"]: r["trigger_count"] for r in jobs.read_state(spark, rules).collect()}
    assert state == {"r": 3, "off": 0}
    assert spark.read.parquet(sent).count() == 3


def test_repeated_batch_replaces_its_output(spark, make_events, registry):
    """A fresh checkpoint over the same sinks runs batch 0 a second time."""
    source, tail, feed = dirs(spark, "in", "tail", "feed")
    arrive(make_events([("a", "u", "x", f"2024-01-01 10:00:0{i}") for i in range(5)]), source)
    subs = spark.createDataFrame([("1", "a", "events"), ("2", "b", "events")], "connection_id string, client_id string, channel string")
    for _ in range(2):
        jobs.stream_tail(event_stream(spark, source), tail, new_run_dir(spark, "check"), 3).awaitTermination()
        jobs.stream_fanout(event_stream(spark, source), feed, new_run_dir(spark, "check")).awaitTermination()
        rows = jobs.read_state(spark, tail).orderBy("position").collect()
        assert [(r["id"], r["total"]) for r in rows] == [("4", 5), ("3", 5), ("2", 5)]
        read = jobs.read_feed(spark, feed, subs)
        assert read.count() == 5 and {r["connection_id"] for r in read.collect()} == {"1"}


def test_ingest_in_small_batches_and_repeated(spark, registry):
    source, table, quarantine = dirs(spark, "in", "events", "quarantine")
    keyed = registry.withColumn("key_hash", __import__("pyspark").sql.functions.sha2("id", 256))
    texts = [json.dumps({"api_key": k, "events": [{"event_name": n, "event_time": "2024-01-01T00:00:00Z"}]})
             for k, n in (("a", "x"), ("a", ""), ("idle", "y"), ("off", "z"), ("a", "w"))]
    for text in texts:
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("append").text(source)
    for _ in range(2):
        # one name for both runs: the second takes the place of the first
        query = jobs.stream_ingest(
            readers.read_lines(spark, source, True, max_files=1), keyed, table, quarantine, new_run_dir(spark, "check"), name="one"
        )
        query.awaitTermination()
        assert jobs.progress(query)["batch"] == 4
        assert sorted(r["event_name"] for r in readers.read_stored_events(spark, table).collect()) == ["w", "x", "y"]
        assert spark.read.parquet(quarantine).count() == 2


def test_two_ingest_jobs_share_a_table(spark, registry):
    keyed = registry.withColumn("key_hash", __import__("pyspark").sql.functions.sha2("id", 256))
    table, quarantine = dirs(spark, "events", "quarantine")
    one, other = dirs(spark, "in", "check"), dirs(spark, "in", "check")
    for names, (source, checkpoint) in ((("x", "y"), one), (("z", ""), other), (("w",), one)):
        lines = [(json.dumps({"api_key": "a", "event_name": n}),) for n in names]
        spark.createDataFrame(lines, "value string").coalesce(1).write.mode("append").text(source)
        jobs.stream_ingest(readers.read_lines(spark, source, True), keyed, table, quarantine, checkpoint).awaitTermination()
    stored = readers.read_stored_events(spark, table).collect()
    assert sorted(r["event_name"] for r in stored) == ["w", "x", "y", "z"]
    assert len({r["id"] for r in stored}) == 4 and spark.read.parquet(quarantine).count() == 1


def test_one_clock_does_not_reset_other_keys(spark):
    source, decisions, entries, checkpoint = dirs(spark, "in", "decisions", "entries", "check")
    parts = [
        [("a", 1000, 1), ("a", 1001, 2), ("b", 9_000_000, 3)],  # a is full, the clock of b is wrong
        [("a", 1002, 4), ("a", 1003, 5), ("b", 1004, 6)],
        [("a", 1061, 7), ("a", 940, 8)],  # the first entry of a has left; the last request is too late
    ]
    for part in parts:
        arrive(spark.createDataFrame(part, REQUESTS), source)
        stream = spark.readStream.schema(REQUESTS).parquet(source)
        jobs.stream_admit(stream, limits_frame(spark, {"a": 2, "b": 2}), decisions, entries, checkpoint).awaitTermination()
    allowed = {r["seq"]: r["allowed"] for r in spark.read.parquet(decisions).collect()}
    assert allowed == {1: True, 2: True, 3: True, 4: False, 5: False, 7: True}
    assert sorted(r["seq"] for r in spark.read.parquet(f"{decisions}-late").collect()) == [6, 8]


@pytest.mark.parametrize("parts", [1, 3])
def test_alerts_do_not_depend_on_micro_batches(spark, make_events, registry, parts):
    source, rules, table, history, sent, checkpoint = dirs(spark, "in", "rules", "agg", "history", "sent", "check")
    jobs.seed_state(spark.createDataFrame([rule("r", metric="events_per_minute", op=">=", threshold=1.0, cooldown=120),
                                           rule("live", metric="active_users_1h", op="<", threshold=1.0, cooldown=0)], RULES), rules)
    events = [("a", "u", "x", f"2024-01-01 10:0{minute}:30") for minute in range(6)]
    for i in range(parts):
        arrive(make_events(events[i * 6 // parts : (i + 1) * 6 // parts]), source)
        stream = jobs.stream_rollup(event_stream(spark, source), lateness="0 seconds")
        seen = spark.read.schema(EVENT_DDL).parquet(source)
        jobs.stream_alerts(stream, registry, rules, table, history, sent, checkpoint, events=seen).awaitTermination()
    fired = sorted((r["alert_id"], r["triggered_at"].isoformat()[11:16]) for r in spark.read.parquet(history).collect())
    assert fired == [("r", "10:01"), ("r", "10:03"), ("r", "10:05")]
