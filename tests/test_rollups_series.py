import json
from datetime import timedelta

import pytest
from instants import utc
from pyspark.sql import functions as F

from tallygrid.operators import rollups, series
from tallygrid.plans.dashboard import dashboard_bundle
from tallygrid.plans.tick import run_rollups
from tallygrid.schemas import AGGREGATES
from tallygrid.session import new_run_dir
from tallygrid.sources import readers, storage


def values(df):
    return {(r["client_id"], r["metric_name"], r["interval_start"].isoformat()[11:16]): r["value"] for r in df.collect()}


def test_minute_rollup_has_zeros_for_idle_and_nothing_for_inactive(make_events, registry):
    df = make_events([("a", "u", "x", "2024-01-01 10:00:00"), ("a", None, "x", "2024-01-01 10:00:59"),
                      ("a", "u", "x", "2024-01-01 10:01:00"), ("off", "u", "x", "2024-01-01 10:00:30")])
    found = rollups.rollup_minute(df, registry, "2024-01-01 10:01:42")
    assert values(found) == {("a", "events_per_minute", "10:00"): 2.0, ("a", "active_users_1m", "10:00"): 1.0,
                             ("idle", "events_per_minute", "10:00"): 0.0, ("idle", "active_users_1m", "10:00"): 0.0}
    meta = {r["metric_name"]: r["meta_data"] for r in found.filter("client_id = 'a'").collect()}
    assert json.loads(meta["events_per_minute"]) == {"count": 2} and json.loads(meta["active_users_1m"]) == {}


def test_hour_rollup_value_is_rounded_rate_times_sixty(make_events, registry):
    df = make_events([("a", "u", "x", "2024-01-01 10:30:00")])
    found = rollups.rollup_hour(df, registry, "2024-01-01 11:15:00")
    got = values(found)
    assert got["a", "events_per_hour", "10:00"] == pytest.approx(1.2)
    assert got["a", "top_events_1h", "10:00"] == 1.0 and got["idle", "top_events_1h", "10:00"] == 0.0
    meta = {(r["client_id"], r["metric_name"]): json.loads(r["meta_data"]) for r in found.collect()}
    assert meta["a", "top_events_1h"] == {"events": [{"event_name": "x", "count": 1, "percentage": 100.0}]}
    assert meta["idle", "top_events_1h"] == {"events": []}
    # the backfill stores the plain count for the same hour
    assert values(rollups.rollup_backfill(df, "2024-01-01 11:15:00"))["a", "events_per_hour", "10:00"] == 1.0


def test_hour_keeps_ten_names(make_events, registry):
    df = make_events([("a", "u", f"n{i:02}", "2024-01-01 10:30:00") for i in range(12)])
    top = rollups.rollup_hour(df, registry, "2024-01-01 11:00:00").filter("metric_name = 'top_events_1h' AND client_id = 'a'").first()
    assert top["value"] == 10.0 and [e["event_name"] for e in json.loads(top["meta_data"])["events"]] == [f"n{i:02}" for i in range(10)]


def test_several_intervals(make_events, registry):
    df = make_events([("a", "u", "x", "2024-01-01 10:00:00"), ("a", "u", "x", "2024-01-01 10:02:30")])
    got = values(rollups.rollup_minute(df, registry, "2024-01-01 10:03:00", 3))
    assert [got["a", "events_per_minute", f"10:0{m}"] for m in range(3)] == [1.0, 0.0, 1.0] and len(got) == 12


def test_backfill_lower_bound_is_strict(make_events):
    df = make_events([("a", "u", "x", "2024-01-01 06:00:00"), ("a", "u", "x", "2024-01-01 06:00:01")])
    found = rollups.rollup_backfill(df, "2024-01-01 12:00:00")
    assert values(found)["a", "events_per_minute", "06:00"] == 1.0
    assert values(found)["a", "events_per_hour", "06:00"] == 2.0
    assert {r["meta_data"] for r in found.collect()} == {None}


def agg(spark, rows):
    """(client, metric, start, value, stamp) as aggregate rows."""
    return spark.createDataFrame(
        [(c, m, utc(s), utc(s) + timedelta(minutes=1), v, None if v is None else f'{{"v":{v}}}', utc(t), utc(t)) for c, m, s, v, t in rows],
        AGGREGATES)


def test_upsert(spark):
    old = agg(spark, [("a", "m", "2024-01-01 10:00:00", 1.0, "2024-01-01"), ("a", "m", "2024-01-01 10:01:00", 2.0, "2024-01-01")])
    new = agg(spark, [("a", "m", "2024-01-01 10:01:00", 5.0, "2024-01-02"), ("a", "m", "2024-01-01 10:01:00", None, "2024-01-03"),
                      ("a", "m", "2024-01-01 10:02:00", 7.0, "2024-01-02"), ("a", "m", "2024-01-01 10:02:00", 8.0, "2024-01-03")])
    day = lambda c: F.date_format(c, "d").alias(c)
    got = series.upsert_aggregates(old, new).orderBy("interval_start").select("value", "meta_data", day("created_at"), day("updated_at")).collect()
    assert [tuple(r) for r in got] == [(1.0, '{"v":1.0}', "1", "1"), (None, None, "1", "3"), (8.0, '{"v":8.0}', "2", "3")]
    value_only = series.upsert_aggregates(old, new, replace=("value",)).orderBy("interval_start").collect()
    assert (value_only[1]["value"], value_only[1]["meta_data"], value_only[1]["updated_at"].day) == (None, '{"v":2.0}', 1)


def test_series_bounds(spark):
    points = agg(spark, [("a", "m", f"2024-01-01 10:0{i}:00", float(i), "2024-01-01") for i in range(5)])
    got = series.time_series(points, "m", "2024-01-01 10:04:00", "2024-01-01 10:00:00", client_id="a")
    assert [r["value"] for r in got.collect()] == [1.0, 2.0, 3.0]
    assert [r["value"] for r in series.time_series(points, "m", "2024-01-01 11:02:00").collect()] == [3.0, 4.0]
    assert [r["value"] for r in series.time_series(points, "m", "2024-01-01 11:00:00", "2024-01-01", limit=2).collect()] == [0.0, 1.0]


def test_series_pages(spark):
    points = agg(spark, [("a", "m", f"2024-01-01 10:0{i}:00", float(i), "2024-01-01") for i in range(5)])
    bounds = dict(start="2024-01-01 09:00:00", limit=2)
    seen, cursor = [], None
    for has_next in (True, True, False):
        page = series.time_series_page(points, "m", "a", "2024-01-01 11:00:00", cursor=cursor, **bounds)
        assert page.has_next is has_next and page.count == len(page.items)
        seen, cursor = seen + [r["value"] for r in page.items], page.next_cursor
    assert seen == [0.0, 1.0, 2.0, 3.0, 4.0] and cursor is None
    whole = series.time_series_page(points, "m", "a", "2024-01-01 11:00:00", start="2024-01-01", limit=5)
    assert not whole.has_next and whole.count == 5
    ignored = series.time_series_page(points, "m", "a", "2024-01-01 11:00:00", cursor="not a cursor", **bounds)
    assert [r["value"] for r in ignored.items] == [0.0, 1.0]
    with pytest.raises(ValueError):
        series.time_series_page(points, "m", "a", "2024-01-01", limit=1001)


@pytest.mark.parametrize("bad", [None, "", "%%%", "bm90IGpzb24=", "W10=", "e30=", "eyJ0aW1lc3RhbXAiOiAxfQ=="])
def test_bad_cursors(bad):
    assert series.decode_cursor(bad) is None
    assert series.decode_cursor(series.encode_cursor("2024-01-01 10:00:00.123456")) == utc("2024-01-01 10:00:00.123456")


def test_event_pages(make_events):
    times = [f"2024-01-01 10:{i % 3:02}:{i % 2:02}" for i in range(23)]
    df = make_events([("a" if i % 5 else "b", "u", "x", t) for i, t in enumerate(times)])
    expected = [i for _, i in sorted(((t, str(i)) for i, t in enumerate(times)), reverse=True)]
    got = []
    for page in range(1, 5):
        rows = series.events_page(df, "2024-01-01 11:00:00", page=page, page_size=7).collect()
        got += [r["id"] for r in rows]
    assert got == expected
    assert series.events_page(df, "2024-01-01 11:00:00", page=9, page_size=7).count() == 0
    info = series.events_page_info(df, "2024-01-01 11:00:00", page=4, page_size=7).first().asDict()
    assert info == dict(total=23, page=4, page_size=7, total_pages=4, has_next=False, has_prev=True)
    none = series.events_page_info(df, "2024-01-01 11:00:00", event_name="zzz").first()
    assert (none["total"], none["total_pages"], none["has_next"]) == (0, 0, False)


def test_retention_keeps_the_cutoff(spark, make_events):
    df = make_events([("a", "u", "x", "2024-01-01 12:00:00"), ("a", "u", "x", "2024-01-01 11:59:59")])
    assert [r["id"] for r in series.prune_events(df, "2024-03-31 12:00:00").collect()] == ["0"]
    points = agg(spark, [("a", "m", "2024-01-01 12:00:00", 1.0, "2024-01-01"), ("a", "m", "2024-01-01 11:59:59", 2.0, "2024-01-01")])
    assert [r["value"] for r in series.prune_aggregates(points, "2024-01-31 12:00:00").collect()] == [1.0]


def test_event_table_retention_and_reload(spark, make_events):
    path = new_run_dir(spark, "events")
    times = ["2024-01-01 10:00:00", "2024-01-02 11:59:59", "2024-01-02 12:00:00", "2024-01-03 00:00:00"]
    storage.append_events(make_events([("a", "u", "x", t) for t in times]), path, "one")
    storage.append_events(make_events([("b", "u", "x", "2024-01-02 01:00:00")]), path, "two")
    storage.append_events(make_events([("b", "u", "x", "2024-01-02 01:00:00")]), path, "two")
    assert readers.read_stored_events(spark, path).count() == 5
    for _ in range(2):
        storage.prune_event_table(spark, path, "2024-01-12 12:00:00", days=10)
        kept = readers.read_stored_events(spark, path)
        assert sorted(r["event_time"].isoformat() for r in kept.collect()) == ["2024-01-02T12:00:00", "2024-01-03T00:00:00"]
    assert storage.partition_values(spark, path, "event_date") == ["2024-01-02", "2024-01-03"]
    assert storage.partition_values(spark, f"{path}/event_date=2024-01-02", "load_id") == ["one"]


def test_aggregate_table(spark):
    path = new_run_dir(spark, "aggregates")
    first = agg(spark, [("a", "m", "2024-01-01 10:00:00", 1.0, "2024-01-01"), ("a", "m", "2024-01-02 10:00:00", 2.0, "2024-01-01")])
    second = agg(spark, [("a", "m", "2024-01-02 10:00:00", 9.0, "2024-01-05"), ("a", "m", "2024-01-03 10:00:00", 3.0, "2024-01-05")])
    storage.merge_aggregates(spark, path, first)
    for _ in range(2):
        storage.merge_aggregates(spark, path, second)
        got = readers.read_aggregates(spark, path).orderBy("interval_start").collect()
        assert [(r["value"], r["created_at"].day) for r in got] == [(1.0, 1), (9.0, 1), (3.0, 5)]
    storage.merge_aggregates(spark, path, first.limit(0))
    assert storage.prune_aggregate_table(spark, path, "2024-01-12 10:00:01", days=10) == 1
    assert [r["value"] for r in readers.read_aggregates(spark, path).collect()] == [3.0]


def test_pruned_scan_reads_only_its_days(spark, make_events):
    path = new_run_dir(spark, "events")
    storage.append_events(make_events([("a", "u", "x", f"2024-01-0{d} 10:00:00") for d in range(1, 6)]), path)
    from tallygrid.operators.filters import in_window

    window = in_window(readers.read_stored_events(spark, path), "2024-01-02 00:00:00", "2024-01-03 00:00:00", "a")
    plan = window._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "PushedFilters: [" in plan and "EqualTo(client_id,a)" in plan
    assert len(window.inputFiles()) >= 1 and window.count() == 1


def test_tick_and_dashboard(spark, make_events, registry):
    path = new_run_dir(spark, "aggregates")
    events = make_events([("a", "u", "x", "2024-01-01 10:00:30", '{"plan": "pro"}'), ("a", "v", "y", "2024-01-01 10:30:30", '{"plan": "free"}')])
    run_rollups(spark, events, registry, path, "2024-01-01 10:31:00", minutes=31)
    run_rollups(spark, events, registry, path, "2024-01-01 11:00:00", minutes=30, hours=1)
    stored = readers.read_aggregates(spark, path)
    assert stored.filter("metric_name = 'events_per_minute'").count() == 2 * 60
    rows = dashboard_bundle(events, stored, "last_hour", as_of="2024-01-01 11:00:00").collect()
    panels = {(r["client_id"], r["panel"]) for r in rows}
    assert panels == {("a", "overview"), ("a", "top_events"), ("a", "plan"), ("a", "series"), ("idle", "series")}
    assert sum(r["value"] for r in rows if r["panel"] == "series") == 1.0
    assert {(r["label"], r["percentage"]) for r in rows if r["panel"] == "plan"} == {("free", 50.0), ("pro", 50.0)}
