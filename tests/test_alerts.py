import json
import random
from datetime import timedelta

import pytest
from instants import utc
from pyspark.sql import functions as F

from tallygrid.operators import alerts
from tallygrid.plans.tick import run_alerts
from tallygrid.schemas import AGGREGATES, ALERT_HISTORY, RULE_CHANGES, RULES

NOW = "2024-01-01 12:00:00"
MADE = utc("2023-01-01")


def rule(id, metric="m", op=">", threshold=1.0, window="1m", client="a", last=None, cooldown=300, enabled=True,
         channels=(True, None), severity="warning"):
    return (id, client, f"name {id}", None, (metric, op, threshold, window), severity, enabled,
            utc(last) if isinstance(last, str) else last, 0, channels, cooldown, MADE, MADE)


def point(metric, start, value, client="a"):
    begin = utc(start)
    return (client, metric, begin, begin + timedelta(minutes=1), value, None, MADE, MADE)


@pytest.fixture
def tables(spark, make_events):
    def build(rules, points=(), events=()):
        return (spark.createDataFrame(list(rules), RULES), spark.createDataFrame(list(points), AGGREGATES), make_events(list(events)))

    return build


def by_rule(df, column):
    return {r["alert_id"] if "alert_id" in df.columns else r["id"]: r[column] for r in df.collect()}


def test_current_value_lookbacks(tables):
    rules = [rule("1m"), rule("5m", window="5m"), rule("1h", window="1h"), rule("odd", window="7d"), rule("none", window=None),
             rule("null", metric="n"), rule("missing", metric="zzz")]
    points = [point("m", "2024-01-01 11:55:00", 7.0), point("m", "2024-01-01 10:00:00", 3.0), point("n", "2024-01-01 11:59:00", None),
              point("m", "2024-01-01 12:00:00", 99.0), point("m", "2024-01-01 11:59:00", 50.0, client="b")]
    found = by_rule(alerts.current_metric(*tables(rules, points), NOW), "current_value")
    assert found == {"1m": 0.0, "5m": 7.0, "1h": 7.0, "odd": 0.0, "none": 0.0, "null": 0.0, "missing": 0.0}


def test_lookback_bound_is_inclusive(tables):
    found = by_rule(alerts.current_metric(*tables([rule("r")], [point("m", "2024-01-01 11:58:00", 4.0)]), NOW), "current_value")
    assert found == {"r": 4.0}


def test_live_fallback(tables):
    rules = [rule("epm", metric="events_per_minute"), rule("au", metric="active_users_1h"), rule("eph", metric="events_per_hour")]
    events = [("a", "u1", "x", "2024-01-01 11:59:00"), ("a", "u2", "x", "2024-01-01 11:59:59"), ("a", "u1", "x", "2024-01-01 11:00:00"),
              ("a", None, "x", "2024-01-01 11:30:00"), ("a", "u3", "x", "2024-01-01 12:00:00"), ("b", "u9", "x", "2024-01-01 11:59:30")]
    found = by_rule(alerts.current_metric(*tables(rules, [], events), NOW), "current_value")
    assert found == {"epm": 2.0, "au": 2.0, "eph": 0.0}


def test_reasons_and_cooldown(tables):
    points = [point("m", "2024-01-01 11:59:00", 5.0)]
    rules = [rule("met"), rule("not", op="<"), rule("edge", last="2024-01-01 11:55:00"), rule("cool", last="2024-01-01 11:55:01"),
             rule("zero", last=NOW, cooldown=0), rule("bad", threshold=None), rule("op", op="~")]
    found = alerts.evaluate_rules(*tables(rules, points), NOW)
    assert by_rule(found, "should_trigger") == {"met": True, "not": False, "edge": True, "cool": False, "zero": True, "bad": False, "op": False}
    assert by_rule(found, "reason") == {
        "met": "Condition met", "not": "Condition not met", "edge": "Condition met, cooldown expired",
        "cool": "In cooldown (last triggered 299s ago)", "zero": "Condition met, cooldown expired", "bad": None, "op": "Condition not met"}
    assert by_rule(found, "error")["bad"] is not None


def test_missing_metric_fires_below_and_hourly_warning(tables):
    found = alerts.evaluate_rules(*tables([rule("r", metric="events_per_hour", op="<")]), NOW)
    assert by_rule(found, "should_trigger") == {"r": True}
    assert by_rule(found, "warning")["r"] is not None


def test_fire(tables):
    rules = [rule("r", threshold=10000000.0, op="<"), rule("quiet", op=">")]
    history, updated = alerts.fire_rules(alerts.evaluate_rules(*tables(rules, [point("m", "2024-01-01 11:59:00", 0.126)]), NOW), NOW)
    (one,) = history.collect()
    assert one["message"] == "Alert 'name r' triggered: m < 10000000.0 (current: 0.13)"
    assert json.loads(one["context"])["current_value"] == 0.126 and one["severity"] == "warning"
    assert not one["notification_sent"]
    assert by_rule(updated, "trigger_count") == {"r": 1, "quiet": 0}
    assert by_rule(updated.select("id", F.unix_seconds("last_triggered").alias("t")), "t") == {"r": int(utc(NOW).timestamp()), "quiet": None}


def test_only_enabled_rules_of_active_tenants(tables, registry):
    rules = [rule("on", op="<"), rule("disabled", op="<", enabled=False), rule("inactive", op="<", client="off"), rule("bad", threshold=None)]
    frame, points, events = tables(rules)
    run = run_alerts(frame, registry, points, events, NOW)
    assert by_rule(run.history, "notification_sent") == {"on": True}
    assert by_rule(run.rules, "trigger_count") == {"on": 1, "disabled": 0, "inactive": 0, "bad": 0}
    assert by_rule(run.decisions, "error")["bad"]
    decisions, history, everything = alerts.evaluate_all(frame, registry, points, events, NOW)
    assert (decisions.count(), history.count(), everything.count()) == (2, 1, 4)


def test_notifications(spark, tables):
    rules = [rule("both", op="<", channels=(True, ["x@example.com", "y@example.com"])), rule("mail", op="<", channels=(False, ["z@example.com"])),
             rule("unset", op="<", channels=(None, [])), rule("none", op="<", channels=None), rule("off", op="<", channels=(False, None))]
    history, updated = alerts.fire_rules(alerts.evaluate_rules(*tables(rules), NOW), NOW)
    sent = alerts.notification_rows(history, updated)
    found = sorted((r["alert_id"], r["channel"], r["address"] or "") for r in sent.collect())
    assert found == [("both", "email", "x@example.com"), ("both", "email", "y@example.com"), ("both", "websocket", ""),
                     ("mail", "email", "z@example.com"), ("none", "websocket", ""), ("unset", "websocket", "")]
    assert by_rule(alerts.mark_notified(history, sent), "notification_sent")["off"] is False


def test_history(spark):
    rows = [(str(i), f"r{i % 2}", "a", utc(NOW) + timedelta(minutes=i), "info", "m", None, True) for i in range(10)]
    history = spark.createDataFrame(rows, ALERT_HISTORY)
    assert [r["id"] for r in alerts.alert_history(history, "r1", 2).collect()] == ["9", "7"]
    assert sorted(r["id"] for r in alerts.alert_history(history, n=1).collect()) == ["8", "9"]
    with pytest.raises(ValueError):
        alerts.alert_history(history, n=501)


def test_validate_rules(spark):
    base = rule("r")
    fill = lambda **kw: tuple(kw.get(f, v) for f, v in zip(spark.createDataFrame([], RULES).columns, base))
    rows = [fill(id="ok", severity=None, enabled=None, cooldown_seconds=None, notification_channels=None, expression=("m", ">", 1.0, None)),
            fill(id="name0", name=""), fill(id="name255", name="x" * 255), fill(id="name256", name="x" * 256), fill(id="noname", name=None),
            fill(id="sev", severity="fatal"), fill(id="cool", cooldown_seconds=3601), fill(id="cool0", cooldown_seconds=0),
            fill(id="op", expression=("m", "=", 1.0, "1m")), fill(id="noexpr", expression=None), fill(id="nothresh", expression=("m", ">", None, "1m")),
            fill(id="desc", description="x" * 1001)]
    good, rejected = alerts.validate_rules(spark.createDataFrame(rows, RULES))
    assert {r["id"] for r in good.collect()} == {"ok", "name255", "cool0"}
    assert {r["id"]: len(r["reasons"]) for r in rejected.collect()} == dict.fromkeys(
        ["name0", "name256", "noname", "sev", "cool", "op", "noexpr", "nothresh", "desc"], 1)
    ok = good.filter("id = 'ok'").first()
    assert (ok["severity"], ok["enabled"], ok["cooldown_seconds"], ok["expression"]["window"], ok["notification_channels"]["websocket"]) == (
        "info", True, 300, "1m", True)


def replay(rules, changes):
    """One change after the other on a dictionary."""
    state = {r[0]: dict(name=r[2], severity=r[5], enabled=r[6], cooldown=r[10], expression=r[4][:3], made=False) for r in rules}
    for seq, _, action, id, _, name, _, expression, severity, enabled, _, cooldown in changes:
        if cooldown is not None and cooldown > 3600 and action in ("create", "patch"):
            continue
        if action == "delete":
            state.pop(id, None)
        elif action == "create":
            if id not in state and name and expression:
                state[id] = dict(name=name, severity=severity or "info", enabled=True if enabled is None else enabled,
                                 cooldown=300 if cooldown is None else cooldown, expression=expression[:3], made=True)
        elif id in state:
            given = dict(name=name, severity=severity, enabled=enabled, cooldown=cooldown, expression=expression and expression[:3])
            if action in ("enable", "disable"):
                given = dict(enabled=action == "enable")
            state[id].update({k: v for k, v in given.items() if v is not None})
    return state


@pytest.mark.parametrize("seed", range(4))
def test_rule_changes_equal_a_replay(spark, seed):
    rng = random.Random(seed)
    rules = [rule(f"r{i}") for i in range(6)]
    changes = []
    for seq in range(120):
        action = rng.choice(["create", "create", "patch", "patch", "patch", "enable", "disable", "delete"])
        carries = action in ("create", "patch")
        changes.append((seq, utc(NOW) + timedelta(seconds=seq), action, f"r{rng.randrange(12)}", "a",
                        f"n{seq}" if carries and rng.random() < 0.7 else None, None,
                        ("m", rng.choice("<>"), float(seq), "1m") if carries and rng.random() < 0.7 else None,
                        "error" if carries and rng.random() < 0.3 else None,
                        rng.choice([True, False, None]) if carries else None, None,
                        rng.choice([None, 5, 60, 4000]) if carries else None))
    found = alerts.apply_rule_changes(spark.createDataFrame(rules, RULES), spark.createDataFrame(changes, RULE_CHANGES)).collect()
    got = {r["id"]: dict(name=r["name"], severity=r["severity"], enabled=r["enabled"], cooldown=r["cooldown_seconds"],
                         expression=tuple(r["expression"])[:3], made=utc(NOW).replace(tzinfo=None) <= r["created_at"]) for r in found}
    assert got == replay(rules, changes)
