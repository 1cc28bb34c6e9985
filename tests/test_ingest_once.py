"""Filters on the faults of an event do not judge it again."""

from tallygrid.operators import ingest


def test_filter_uses_the_judged_event(spark):
    lines = spark.createDataFrame([('{"api_key": "k", "events": [{"event_name": "x"}, {"event_name": ""}]}',), ("{",)], "value string")
    good, bad = ingest.validate_events(ingest.explode_batches(ingest.parse_batches(lines), ingest.SKIP_EVENT))
    plan = good.select("api_key", "event_name")._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and not any("variant" in line.lower() for line in filters)
    assert [r["event_name"] for r in good.collect()] == ["x"] and sorted(r["reasons"][0] for r in bad.collect()) == ["event_name must have 1 to 255 characters", "malformed JSON"]
