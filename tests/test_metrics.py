import pytest
from pyspark.sql import functions as F

from tallygrid.fixed_values import BREAKDOWN_PROPERTIES, EXPLORE_PERIODS, OVERVIEW_PERIODS
from tallygrid.functions import compare_alert, compare_exact, json_property, number_text, parse_time, split_steps, window_bounds
from tallygrid.operators import metrics

START, END = "2024-01-01 00:00:00", "2024-01-01 01:00:00"
NOON = "2024-01-01 00:30:00"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("value, op, threshold, expected", [
    (100, ">", 50, True), (50, ">", 100, False), (50, "<", 100, True), (100, "<", 50, False),
    (100, "==", 100, True), (100, "==", 101, False), (5, ">=", 5, True), (5, "<=", 4, False),
    (5, "!=", 4, False), (5, "~", 5, False), ("x", ">", 1, False), (None, ">", 1, False),
])
def test_compare_exact(spark, value, op, threshold, expected):
    df = spark.createDataFrame([(None if value is None else str(value), op, str(threshold))], "v string, o string, t string")
    assert df.select(compare_exact(F.col("v"), F.col("o"), F.col("t"))).first()[0] is expected


@pytest.mark.parametrize("value, op, expected", [
    (10.009, "==", True), (10.011, "==", False), (10.009, "!=", False), (10.011, "!=", True),
    (10.0, ">=", True), (10.0, "<=", True), (10.0, ">", False), (10.0, "<", False), (10.0, "~", False),
])
def test_compare_alert(spark, value, op, expected):
    df = spark.createDataFrame([(value, op, 10.0)], "v double, o string, t double")
    assert df.select(compare_alert(F.col("v"), F.col("o"), F.col("t"))).first()[0] is expected


def test_window_is_half_open(make_events):
    df = make_events([("a", "u", "x", START), ("a", "u", "x", END), ("a", None, "x", NOON)])
    assert rows(metrics.event_rate(df, START, END), "client_id", "count", "rate") == [("a", 2, 0.03)]
    assert rows(metrics.active_users(df, START, END), "active_users") == [(1,)]
    assert rows(metrics.event_rate(df, START, START), "client_id") == []


def test_zero_length_window_has_zero_rate(make_events, registry):
    df = make_events([("a", "u", "x", START)])
    assert rows(metrics.event_rate(df, START, START, registry), "client_id", "rate") == [("a", 0.0), ("idle", 0.0)]


def test_idle_and_inactive_tenants(make_events, registry):
    df = make_events([("a", "u", "x", NOON), ("off", "u", "x", NOON)])
    assert rows(metrics.event_rate(df, START, END, registry), "client_id", "count") == [("a", 1), ("idle", 0)]
    assert rows(metrics.active_users(df, START, END, registry), "client_id", "active_users") == [("a", 1), ("idle", 0)]
    found = {r["client_id"]: r for r in metrics.overview(df, "last_hour", as_of=END, registry=registry).collect()}
    assert found["idle"]["total_events"] == 0 and found["idle"]["top_events"] == []
    assert found["a"]["top_events"][0].asDict() == {"event_name": "x", "count": 1, "percentage": 100.0}
    assert set(found) == {"a", "idle"}


def test_percentages_cover_returned_rows_and_ties_go_by_name(make_events):
    names = ["p"] * 2 + ["b"] + ["c"] + ["d"]
    df = make_events([("a", "u", n, NOON) for n in names])
    top = metrics.top_events(df, START, END, 2).orderBy("rank").collect()
    assert [(r["event_name"], r["count"], r["percentage"]) for r in top] == [("p", 2, 66.67), ("b", 1, 33.33)]
    with pytest.raises(ValueError):
        metrics.top_events(df, START, END, 101)


def test_approximate_users(make_events):
    df = make_events([("a", f"u{i}", "x", NOON) for i in range(50)])
    assert abs(metrics.active_users(df, START, END, approximate=True).first()["active_users"] - 50) <= 5


JSON_CASES = ['{"plan": "pro"}', '{"plan": null}', "{}", '{"plan": true}', '{"plan": 7}', "{broken", None, '{"plan": "pro"}']


def test_json_property(spark):
    df = spark.createDataFrame([(c,) for c in JSON_CASES], "p string")
    found = [r[0] for r in df.select(json_property(F.col("p"), "plan")).collect()]
    assert found == ["pro", None, None, "true", "7", None, None, "pro"]
    with pytest.raises(ValueError):
        json_property(F.col("p"), "a']['b")


def test_breakdown(make_events):
    df = make_events([("a", None if i == 7 else "u", "x", NOON, p) for i, p in enumerate(JSON_CASES)])
    found = metrics.breakdown(df, "plan", START, END, n=2).orderBy("rank").collect()
    assert [(r["label"], r["count"], r["users"], r["percentage"], r["total"]) for r in found] == [
        ("pro", 2, 1, 66.67, 3), ("7", 1, 1, 33.33, 3)]
    assert metrics.breakdown(df, "plan", START, END, event_name="").count() == 3
    assert metrics.breakdown(df, "plan", START, END, event_name="y").count() == 0
    with pytest.raises(ValueError):
        metrics.breakdown(df, "session_id", START, END)
    with pytest.raises(ValueError):
        metrics.breakdown(df, "plan", START, END, n=51)


def test_several_breakdowns_equal_single_ones(make_events):
    df = make_events([("a", f"u{i % 3}", "x", NOON, f'{{"plan": "p{i % 2}", "os": "o{i % 5}"}}') for i in range(20)])
    both = metrics.breakdowns(df, ["plan", "os", "city"], START, END)
    single = metrics.breakdown(df, "plan", START, END).unionByName(metrics.breakdown(df, "os", START, END))
    columns = both.columns
    assert rows(both, *columns) == rows(single, *columns)


def test_property_list():
    assert metrics.breakdown_properties() == sorted(BREAKDOWN_PROPERTIES) and len(BREAKDOWN_PROPERTIES) == 22


def test_funnel_ignores_order_but_needs_every_step(make_events, registry):
    df = make_events([
        ("a", "back", "s3", START), ("a", "back", "s2", NOON), ("a", "back", "s1", NOON),
        ("a", "gap", "s1", START), ("a", "gap", "s3", NOON),
        ("a", "one", "s1", START), ("a", "one", "s1", NOON),
        ("a", None, "s1", NOON), ("a", "late", "s1", END), ("a", "no-start", "s2", NOON),
    ])
    found = metrics.funnel(df, ["s1", "s2", "s3"], START, END, registry).orderBy("client_id", "step_number").collect()
    assert [(r["users"], r["conversion_from_start"], r["conversion_from_previous"], r["dropped"]) for r in found[:3]] == [
        (3, 100.0, 100.0, 0), (1, 33.33, 33.33, 2), (1, 33.33, 100.0, 0)]
    assert {r["overall_conversion"] for r in found[:3]} == {33.33}
    assert [(r["client_id"], r["users"], r["conversion_from_previous"]) for r in found[3:]] == [
        ("idle", 0, 100.0), ("idle", 0, 0.0), ("idle", 0, 0.0)]


def test_funnel_empty_first_step_and_repeated_step(make_events):
    df = make_events([("a", "u", "s2", NOON)])
    found = metrics.funnel(df, ["s1", "s2"], START, END).orderBy("step_number").collect()
    assert [(r["users"], r["conversion_from_start"], r["dropped"]) for r in found] == [(0, 0.0, 0), (0, 0.0, 0)]
    twice = metrics.funnel(df, ["s2", "s2"], START, END).collect()
    assert [r["users"] for r in twice] == [1, 1]


def test_steps_and_periods():
    assert split_steps(" a, b ,,c") == ["a", "b", "c"]
    for bad in ("a", ",".join("abcdefghi")):
        with pytest.raises(ValueError):
            split_steps(bad)
    with pytest.raises(ValueError):
        window_bounds("last_30d", END, OVERVIEW_PERIODS)
    start, end = window_bounds("last_30d", END, EXPLORE_PERIODS)
    assert (end - start).days == 30


def test_share_of_total(spark):
    items = spark.createDataFrame([("a", "x", 2, 10), ("a", "y", 1, 10), ("a", "z", 1, 10), ("b", "x", 0, 0)],
                                  "client_id string, label string, count bigint, total bigint")
    assert rows(metrics.share_of_total(items), "client_id", "label", "share") == [
        ("a", "x", 50.0), ("a", "y", 25.0), ("a", "z", 25.0), ("b", "x", 0.0)]
    kept = metrics.share_of_total(items, total="total", keep=2)
    assert rows(kept, "client_id", "label", "share") == [("a", "x", 20.0), ("a", "y", 10.0), ("b", "x", 0.0)]


def test_rounding_is_half_up(spark):
    # three of eight events: 37.5 stays, 1 of 800 = 0.125 goes up
    assert spark.range(1).select(F.round(F.lit(1) / F.lit(800) * 100, 2)).first()[0] == 0.13


@pytest.mark.parametrize("value, text", [
    (120.0, "120.0"), (0.05, "0.05"), (10000000.0, "10000000.0"), (-2.5, "-2.5"), (0.0, "0.0"), (100.0, "100.0"), (1e-15, "1.0E-15"),
])
def test_number_text(spark, value, text):
    assert spark.createDataFrame([(value,)], "v double").select(number_text(F.col("v"))).first()[0] == text


@pytest.mark.parametrize("text, micros", [
    ("2024-01-01T00:00:00Z", 1704067200000000), ("2024-01-01T01:00:00+01:00", 1704067200000000),
    ("2024-01-01 00:00:00.5", 1704067200500000), ("1704067200", 1704067200000000), ("1704067200000", 1704067200000000),
    ("2024-01-01", 1704067200000000), ("yesterday", None), ("", None), ("12:30", None),
])
def test_parse_time(spark, text, micros):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(F.unix_micros(parse_time(F.col("t")))).first()[0] == micros
