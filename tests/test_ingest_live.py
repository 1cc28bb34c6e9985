import csv
import glob
import json
import random

import pytest
from instants import utc
from pyspark.sql import functions as F

from tallygrid.operators import fanout, ingest
from tallygrid.schemas import REGISTRY
from tallygrid.session import new_run_dir
from tallygrid.sources import exports, readers

SECRET, REVOKED = "secret", "revoked"


@pytest.fixture
def keys(spark):
    rows = [("a", "A", SECRET, True), ("r", "R", REVOKED, False)]
    made = utc("2024-01-01")
    df = spark.createDataFrame([(i, n, k, "o", 10, on, made) for i, n, k, on in rows], REGISTRY)
    return df.withColumn("key_hash", F.sha2("key_hash", 256))


def check(spark, keys, *texts, policy=ingest.REJECT_BATCH, **options):
    lines = spark.createDataFrame([(t if isinstance(t, str) else json.dumps(t),) for t in texts], "value string")
    received = F.lit("2024-05-05 05:05:05").cast("timestamp")
    return ingest.check_batches(lines, keys, policy, received_at=received, **options)


def batch(*events, key=SECRET):
    return {"api_key": key, "events": list(events)}


def reasons(checked):
    return sorted(tuple(r["reasons"]) for r in checked.collect())


@pytest.mark.parametrize("event, reason", [
    ({"event_name": "x"}, None),
    ({"event_name": "x" * 255}, None),
    ({"event_name": "x" * 256}, "event_name must have 1 to 255 characters"),
    ({"event_name": ""}, "event_name must have 1 to 255 characters"),
    ({"user_id": "u"}, "event_name must be text"),
    ({"event_name": None}, "event_name must be text"),
    ({"event_name": 5}, "event_name must be text"),
    ({"event_name": "x", "user_id": "u" * 255}, None),
    ({"event_name": "x", "user_id": "u" * 256}, "user_id must have at most 255 characters"),
    ({"event_name": "x", "user_id": 7}, "user_id must be text"),
    ({"event_name": "x", "user_id": None}, None),
    ({"event_name": "x", "properties": {"a": {"b": [1, None]}}}, None),
    ({"event_name": "x", "properties": None}, None),
    ({"event_name": "x", "properties": [1]}, "properties must be an object"),
    ({"event_name": "x", "properties": "text"}, "properties must be an object"),
    ({"event_name": "x", "properties": {"p": "y" * 99992}}, None),
    ({"event_name": "x", "properties": {"p": "y" * 99993}}, "properties exceed 100000 characters"),
    ({"event_name": "x", "event_time": None}, None),
    ({"event_name": "x", "event_time": "2024-01-01T00:00:00Z"}, None),
    ({"event_name": "x", "event_time": 1704067200}, None),
    ({"event_name": "x", "event_time": "soon"}, "event_time is not a time"),
    ("text", "event must be an object"),
])
def test_event_checks(spark, keys, event, reason):
    found = check(spark, keys, batch(event)).collect()
    assert len(found) == 1 and found[0]["client_id"] == "a"
    assert (reason in found[0]["reasons"]) if reason else found[0]["reasons"] == []


def test_batch_sizes(spark, keys):
    event = {"event_name": "x"}
    for size, good, bad in ((0, 0, 1), (1, 1, 0), (1000, 1000, 0), (1001, 0, 1)):
        checked = check(spark, keys, batch(*[event] * size))
        assert (ingest.accepted(checked).count(), ingest.quarantined(checked).count()) == (good, bad)


def test_whole_envelope_faults(spark, keys):
    checked = check(spark, keys, "{broken", '{"api_key": "secret"}', '{"api_key": "secret", "events": 5}', "")
    assert reasons(checked) == [("events must be a list",)] * 2 + [("malformed JSON",)] * 2


def test_policies(spark, keys):
    good, bad = {"event_name": "x"}, {"event_name": ""}
    both = [batch(good, bad, good), batch(good)]
    assert ingest.accepted(check(spark, keys, *both)).count() == 1
    assert ingest.accepted(check(spark, keys, *both, policy=ingest.SKIP_EVENT)).count() == 3
    report = {(r["status"], r["reason"]): r["events"] for r in ingest.ingest_report(check(spark, keys, *both)).collect()}
    assert report == {("processed", ""): 1, ("failed", "another event of the batch is not valid"): 2,
                      ("failed", "event_name must have 1 to 255 characters"): 1}
    with pytest.raises(ValueError):
        check(spark, keys, batch(good), policy="other")


def test_keys(spark, keys):
    event = {"event_name": "x"}
    checked = check(spark, keys, batch(event, key=f" {SECRET} "), batch(event, key=REVOKED), batch(event, key="other"), {"events": [event]})
    assert reasons(checked) == [(), ("unknown or revoked key",), ("unknown or revoked key",), ("unknown or revoked key",)]


def test_defaults_and_time_field(spark, keys):
    event = {"event_name": "x", "timestamp": "2024-01-01T00:00:00Z"}
    assert ingest.accepted(check(spark, keys, batch(event))).first()["event_time"].isoformat() == "2024-05-05T05:05:05"
    mapped = ingest.accepted(check(spark, keys, batch(event), time_field="timestamp")).first()
    assert mapped["event_time"].isoformat() == "2024-01-01T00:00:00" and mapped["id"]
    typed = ingest.apply_defaults(spark.createDataFrame([("a", None, "x", None, None)],
                                  "client_id string, user_id string, event_name string, properties string, event_time timestamp")).first()
    assert typed["event_time"] == typed["received_at"] and typed["id"]


def test_structural_check(spark):
    whole = {"id": "1", "client_id": "a", "user_id": None, "event_name": "x", "properties": {"p": 1},
             "event_time": "2024-01-01T00:00:00Z", "received_at": "2024-01-01T00:00:01+00:00"}
    variants = [json.dumps(whole), "{broken"] + [json.dumps({k: v for k, v in whole.items() if k != gone}) for gone in
                                                 ("client_id", "event_name", "event_time", "received_at", "user_id", "properties")]
    variants.append(json.dumps({**whole, "event_time": None}))
    variants.append(json.dumps({**whole, "event_time": "1704067200"}))
    path = new_run_dir(spark, "queued")
    spark.createDataFrame([(v,) for v in variants], "value string").coalesce(1).write.text(path)
    good, rejected = ingest.structural_check(readers.read_events(spark, path))
    assert good.count() == 3
    assert [json.loads(r["properties"]) for r in good.collect() if r["properties"]] == [{"p": 1}, {"p": 1}]
    assert sorted(r["reasons"][0] for r in rejected.collect()) == [
        "client_id is missing", "event_name is missing"] + ["event_time is missing or not a time"] * 3 + [
        "malformed JSON", "received_at is missing or not a time"]


def test_messages(make_events):
    df = make_events([("a", None, 'say "hi"', "2024-01-01 00:00:00", '{"k": [1, {"z": null}]}')])
    sent = json.loads(fanout.fanout_events(df).first()["message"])
    event = {"id": "0", "client_id": "a", "user_id": None, "event_name": 'say "hi"', "properties": {"k": [1, {"z": None}]},
             "event_time": "2024-01-01T00:00:00+00:00", "received_at": "2024-01-01T00:00:00+00:00"}
    assert sent == {"client_id": "a", "event": event}
    assert json.loads(fanout.fanout_events(df, delivered=True).first()["message"]) == {
        "type": "event", "data": event, "timestamp": "2024-01-01T00:00:00+00:00"}


def test_subscriptions_equal_a_replay(spark):
    rng = random.Random(1)
    names = ["events", "metrics", "alerts", "other"]
    log = [(i, f"c{rng.randrange(6)}", rng.choice(["subscribe", "unsubscribe", "unsubscribe"]), rng.sample(names, rng.randrange(4))) for i in range(60)]
    state = {f"c{i}": {"events", "metrics", "alerts"} for i in range(7)}
    for _, connection, action, channels in log:
        if action == "subscribe":
            state[connection] = set(channels) or state[connection]
        else:
            state[connection] = state[connection] - set(channels)
    connections = spark.createDataFrame([(c, "t") for c in state], "connection_id string, client_id string")
    commands = spark.createDataFrame(log, "seq bigint, connection_id string, action string, channels array<string>")
    found = {(r["connection_id"], r["channel"]) for r in fanout.subscription_state(connections, commands).collect()}
    assert found == {(c, channel) for c, channels in state.items() for channel in channels}


def test_routing_stays_inside_tenant_and_channel(spark):
    messages = spark.createDataFrame([("a", "events", "m1"), ("b", "events", "m2"), ("a", "alerts", "m3")], "client_id string, channel string, message string")
    subs = spark.createDataFrame([("1", "a", "events"), ("2", "a", "alerts"), ("3", "b", "events"), ("4", "b", "metrics")],
                                 "connection_id string, client_id string, channel string")
    assert {(r[0], r[3]) for r in fanout.route_messages(messages, subs).collect()} == {("1", "m1"), ("2", "m3"), ("3", "m2")}


def test_live_tail(make_events):
    df = make_events([("a", "u", "x", f"2024-01-01 00:00:0{i % 4}") for i in range(9)] + [("b", "u", "x", "2024-01-01")])
    rows = fanout.live_tail(df, 3).orderBy("client_id", "position").collect()
    assert [(r["client_id"], r["id"], r["total"]) for r in rows] == [("a", "7", 9), ("a", "3", 9), ("a", "6", 9), ("b", "9", 1)]


def test_csv_survives_quotes(spark, make_events):
    df = make_events([("a", None, 'a "quoted", name', "2024-01-01 10:00:00", '{"k": "v, \\"w\\""}'), ("a", "", "x", "2024-01-01 10:00:00")])
    path = new_run_dir(spark, "csv")
    exports.export_events_csv(df.coalesce(1), path)
    with open(glob.glob(f"{path}/part-*.csv")[0], newline="") as file:
        rows = list(csv.DictReader(file))
    assert rows[0] == {"ID": "0", "Event Name": 'a "quoted", name', "User ID": "N/A", "Event Time": "2024-01-01 10:00:00",
                       "Received At": "2024-01-01 10:00:00", "Properties": '{"k": "v, \\"w\\""}'}
    assert (rows[1]["User ID"], rows[1]["Properties"]) == ("N/A", "{}")
    feed = new_run_dir(spark, "csv")
    exports.export_feed_csv(df.coalesce(1), feed)
    with open(glob.glob(f"{feed}/part-*.csv")[0], newline="") as file:
        assert [list(r) for r in csv.reader(file)][0] == ["Timestamp", "Event Name", "User ID", "Properties"]


def test_equal_lines_have_ids_of_their_own(spark, make_events):
    rows = make_events([("a", "u", "view", "2024-01-01")] * 40 + [("a", f"u{i}", "view", "2024-01-01") for i in range(20)])
    same = F.when(F.col("id").cast("int") < 40, "line").otherwise(F.col("id"))
    load = rows.withColumn("id", same).repartition(5)
    ids = [[r["id"] for r in ingest.unique_ids(frame, name).collect()] for frame, name in ((load, "one"), (load.repartition(3), "one"), (load, "two"))]
    assert all(len(set(own)) == 60 for own in ids)
    assert set(ids[0]) == set(ids[1]) and not set(ids[0]) & set(ids[2])
