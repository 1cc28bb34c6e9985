"""Roll-ups by signed changes: repeats, loads that shrink, other writers, crashes, what is read."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallygrid.schemas import EVENTS
from tallygrid.session import new_run_dir
from tallygrid.sources.buckets import NAME, USER, USERS, BucketLog, fold_late
from tallygrid.sources.snapshots import SeriesLog

TICK = "2024-01-03T00:00:00"


@pytest.fixture
def log(spark):
    return BucketLog(spark, new_run_dir(spark, "buckets"))


def values(rows, metric):
    return {(r.client_id, r.interval_start.strftime("%d %H")): r.value for r in rows.where(F.col("metric_name") == metric).collect()}


def by_hand(events):
    """Users and names per tenant and hour, one event at a time."""
    users, names = defaultdict(set), defaultdict(Counter)
    for client, user, name, time in events:
        place = (client, f"{time[8:10]} {time[11:13]}")
        names[place][name] += 1
        users[place] |= {user} - {None}
    return {place: len(users[place]) for place in names}, {place: len(found) for place, found in names.items()}


def test_loads_in_any_order_like_one_event_at_a_time(spark, log, make_events):
    chance = random.Random(5)
    held = {}
    for step in range(9):
        load = f"load-{chance.randrange(3)}"
        rows = [
            (chance.choice("ab"), chance.choice(["u", "v", "w", None]), chance.choice(["x", "y"]), f"2024-01-0{chance.choice('12')}T1{chance.choice('012')}:00:00")
            for _ in range(chance.choice([0, 1, 6]))
        ]
        held[load] = rows
        log.apply(make_events(rows) if rows else spark.createDataFrame([], EVENTS), load)
        users, names = by_hand([row for own in held.values() for row in own])
        found = log.rollup(TICK)
        assert values(found, "active_users_1h") == users
        assert values(found, "top_events_1h") == names


def test_a_repeat_writes_nothing(log, make_events):
    events = make_events([("a", "u", "x", "2024-01-01T10:00:00"), ("a", None, "x", "2024-01-01T10:00:00")])
    version = log.apply(events, "one")
    assert log.apply(events, "one") == version and len(log.segments()) == 1


def test_an_hour_that_loses_its_events_gets_zeros(spark, log, make_events, registry):
    series = SeriesLog(spark, new_run_dir(spark, "series"))
    rows = [("a", "u", "x", "2024-01-01T10:00:00"), ("a", "u", "x", "2024-01-01T11:00:00"), ("off", "u", "x", "2024-01-01T11:00:00")]
    fold_late(log, series, make_events(rows), "one", registry, TICK)
    fold_late(log, series, make_events(rows[:1]), "one", registry, TICK)
    assert values(series.read(), "active_users_1h") == {("a", "01 10"): 1, ("a", "01 11"): 0}
    assert values(series.read(), "events_per_hour") == {("a", "01 10"): 1.2, ("a", "01 11"): 0}


def test_users_are_looked_up_anew_when_another_writer_was_faster(log, make_events, monkeypatch):
    """Both loads bring the same user; counted twice if the slower one kept what it had found first."""
    other = BucketLog(log.spark, log.path)
    plain, calls = log.commit, []

    def late_commit(base, segments):
        if not calls:
            calls.append(base)
            other.apply(make_events([("a", "u", "x", "2024-01-01T10:00:00")]), "other")
        return plain(base, segments)

    monkeypatch.setattr(log, "commit", late_commit)
    log.apply(make_events([("a", "u", "x", "2024-01-01T10:30:00"), ("a", "v", "x", "2024-01-01T10:30:00")]), "mine")
    assert calls and values(log.rollup(TICK), "active_users_1h") == {("a", "01 10"): 2}
    assert log.version() == 2


def test_a_crash_between_log_and_series_is_mended_by_a_repeat(spark, log, make_events, registry, monkeypatch):
    series = SeriesLog(spark, new_run_dir(spark, "series"))
    events = make_events([("a", "u", "x", "2024-01-01T10:00:00")])

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(series, "merge", die)
        with pytest.raises(RuntimeError):
            fold_late(log, series, events, "one", registry, TICK)
    fold_late(log, series, events, "one", registry, TICK)
    assert values(series.read(), "active_users_1h") == {("a", "01 10"): 1}


def test_compaction_keeps_the_sums_and_spares_loads(log, make_events):
    for number in range(5):
        log.apply(make_events([("a", "u", "x", "2024-01-01T10:00:00"), ("b", f"u{number}", "x", "2024-01-01T10:00:00")]), f"load-{number}")
    before = log.rollup(TICK).collect()
    log.compact(spared={"load-4"})
    assert sorted(s.load_id.split("-")[0] for s in log.segments()) == ["load", "merged"]
    assert sorted(map(str, log.rollup(TICK).collect())) == sorted(map(str, before))
    log.apply(make_events([("b", "u4", "x", "2024-01-01T10:00:00")]), "load-4")
    assert values(log.rollup(TICK), "active_users_1h") == {("a", "01 10"): 1, ("b", "01 10"): 5}


def test_only_days_of_the_load_are_opened(log, make_events, monkeypatch):
    log.apply(make_events([("a", "u", "x", f"2024-01-0{day}T10:00:00") for day in (1, 2, 3)]), "one")
    opened, plain = set(), log.open

    def watch(segments, *rest):
        opened.update(s.day for s in segments)
        return plain(segments, *rest)

    monkeypatch.setattr(log, "open", watch)
    log.apply(make_events([("a", "u", "x", "2024-01-02T10:05:00")]), "two")
    log.rollup(TICK, None, log.touched("two")).collect()
    assert opened == {"2024-01-02"}


def test_a_rollup_reads_no_rows_of_single_users(log, make_events):
    log.apply(make_events([("a", "u", "x", "2024-01-01T10:00:00")]), "one")
    plan = log.rollup(TICK)._jdf.queryExecution().executedPlan().toString()
    assert f"EqualTo(kind,{USER})" not in plan
    assert all(f"EqualTo(kind,{kind})" in plan for kind in (NAME, USERS))


def test_hours_and_minutes_only(spark):
    with pytest.raises(ValueError):
        BucketLog(spark, "/nowhere", 7)
