"""Sketches, sessions, trailing counts and newest rows against plain loops."""

import random
from collections import Counter, defaultdict
from datetime import timedelta

import pytest
from instants import utc
from pyspark.sql import functions as F

from tallygrid.operators import filters, sessions, sketches, trailing
from tallygrid.session import new_run_dir
from tallygrid.streaming import jobs


def some_events(make_events, seed, n=600, users=40, hours=30):
    chance = random.Random(seed)
    rows = []
    for _ in range(n):
        moment = utc("2024-01-01") + timedelta(seconds=chance.randrange(hours * 3600))
        user = None if chance.random() < 0.05 else f"u{min(chance.randrange(users), chance.randrange(users))}"
        rows.append((chance.choice("ab"), user, f"n{chance.randrange(9)}", moment.replace(tzinfo=None).isoformat()))
    return rows, make_events(rows)


@pytest.mark.parametrize("capacity", [1, 4, 100])
def test_name_summaries_keep_their_bounds(make_events, capacity):
    rows, events = some_events(make_events, 1)
    hourly = sketches.name_summaries(events, "2024-01-01", "2024-01-03", capacity=capacity, name="user_id")
    assert all(len(r["names"]) <= capacity for r in hourly.collect())
    merged = {r["client_id"]: r for r in sketches.merge_name_summaries(hourly, capacity=capacity).collect()}
    for client in "ab":
        true = Counter(user for c, user, _, _ in rows if c == client and user)
        kept = {e["name"]: e["count"] for e in merged[client]["names"]}
        error, total = merged[client]["error"], merged[client]["total"]
        assert total == sum(true.values()) and error * (capacity + 1) <= total
        assert all(kept.get(name, 0) <= n <= kept.get(name, 0) + error for name, n in true.items()) and set(kept) <= set(true)
        if capacity == 100:
            assert error == 0 and kept == dict(true)


def test_late_users_merge_into_sketches(make_events):
    rows, events = some_events(make_events, 2)
    late = F.col("id").cast("long") % 3 == 0
    parts = [sketches.user_sketches(part, "2024-01-01", "2024-01-03") for part in (events.where(~late), events.where(late))]
    found = {r["client_id"]: r["active_users"] for r in sketches.users_over(sketches.merge_user_sketches(*parts), "2024-01-01 05:00:00", "2024-01-01 20:00:00").collect()}
    for client in "ab":
        true = len({u for c, u, _, t in rows if c == client and u and "2024-01-01T05" <= t < "2024-01-01T20"})
        assert abs(found[client] - true) <= 1
    assert sketches.user_sketches(events.limit(0), "2024-01-01", "2024-01-03").count() == 0


def test_quantiles_by_rank(make_events):
    _, events = some_events(make_events, 3, n=3_000)
    value = F.when(F.col("user_id").isNotNull(), F.substring("user_id", 2, 9).cast("double"))
    found = sketches.quantiles_over(sketches.quantile_sketches(events, value, "2024-01-01", "2024-01-03"), "2024-01-01", "2024-01-03").collect()
    values = defaultdict(list)
    for r in events.select("client_id", value.alias("v")).where("v IS NOT NULL").collect():
        values[r["client_id"]].append(r["v"])
    assert len(found) == 6
    for r in found:
        own = values[r["client_id"]]
        assert r["n"] == len(own)
        assert sum(v < r["value"] for v in own) / len(own) <= r["share"] + 0.02 and sum(v <= r["value"] for v in own) / len(own) >= r["share"] - 0.02


def test_trailing_users_like_a_loop(make_events):
    rows, events = some_events(make_events, 4, n=500, users=25)
    moments = trailing.trailing_grid("2024-01-01 01:00:00", "2024-01-02 12:00:00", timedelta(minutes=37))
    moments = [m.replace(second=0) for m in moments]
    windows = {"5m": timedelta(minutes=5), "1h": timedelta(hours=1), "9h": timedelta(hours=9)}
    found = {(r["client_id"], r["as_of"].timestamp(), r["window"]): r["users"] for r in trailing.trailing_users(events, moments, windows).collect()}
    assert len(found) == 2 * 3 * len(moments)
    for (client, moment, window), n in found.items():
        since = moment - windows[window].total_seconds()
        assert n == len({u for c, u, _, t in rows if c == client and u and since <= utc(t).timestamp() < moment}), (client, moment, window)
    with pytest.raises(ValueError):
        trailing.trailing_users(events, moments, {"odd": timedelta(seconds=90)})


def test_sessions_end_with_a_pause(make_events):
    times = ["10:00:00", "10:29:59", "10:59:59", "11:30:00", "13:00:00"]
    rows = [("a", "u", f"n{i % 2}", f"2024-01-01T{t}") for i, t in enumerate(times)] + [("a", None, "x", "2024-01-01T10:10:00"), ("b", "u", "x", "2024-01-01T10:10:00")]
    found = sessions.sessions(make_events(rows)).collect()
    assert sorted((r["client_id"], r["session_start"].strftime("%H:%M:%S"), r["session_end"].strftime("%H:%M:%S"), r["events"], r["names"]) for r in found) == [
        ("a", "10:00:00", "10:59:59", 3, 2), ("a", "11:30:00", "11:30:00", 1, 1), ("a", "13:00:00", "13:00:00", 1, 1), ("b", "10:10:00", "10:10:00", 1, 1),
    ]


@pytest.mark.parametrize("parts", [1, 3])
def test_streamed_sessions_do_not_depend_on_arrivals(spark, make_events, parts):
    times = ["10:00:00", "10:20:00", "10:45:00", "11:30:00", "11:40:00", "13:00:00", "15:00:00"]
    source, table, checkpoint = (new_run_dir(spark, name) for name in ("in", "sessions", "check"))
    for i in range(parts):
        make_events([("a", "u", "x", f"2024-01-01T{t}") for t in times[i * 7 // parts : (i + 1) * 7 // parts]]).write.mode("append").parquet(source)
        schema = spark.read.parquet(source).schema
        jobs.stream_sessions(spark.readStream.schema(schema).parquet(source), table, checkpoint, lateness="0 seconds").awaitTermination()
    found = spark.read.parquet(table).collect()
    assert sorted((r["session_start"].strftime("%H:%M"), r["session_end"].strftime("%H:%M"), r["events"]) for r in found) == [("10:00", "10:45", 3), ("11:30", "11:40", 2), ("13:00", "13:00", 1)]


def test_newest_rows_of_a_busy_second(make_events):
    rows = [("a", f"u{i}", "x", "2024-01-01T10:00:00") for i in range(30)] + [("a", "v", "x", "2024-01-01T10:00:01")] * 3 + [("a", "w", "x", "2024-01-01T09:00:00")] * 5 + [("b", "w", "x", "2024-01-01T09:00:00")] * 2
    events = make_events(rows)
    for n in (1, 3, 5, 33, 36, 100):
        found = filters.newest_per_group(events, ["client_id"], "event_time", ["id"], n).collect()
        for client in "ab":
            own = sorted(((t, str(i)) for i, (c, _, _, t) in enumerate(rows) if c == client), reverse=True)[:n]
            assert sorted((r["rank"], r["id"]) for r in found if r["client_id"] == client) == [(p + 1, i) for p, (_, i) in enumerate(own)]
