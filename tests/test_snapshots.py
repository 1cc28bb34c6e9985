"""Versioned tables: crashes, other writers, untouched files, deltas in any grouping."""

import random

import pytest
from instants import utc
from pyspark.sql import functions as F

from tallygrid.schemas import AGGREGATES
from tallygrid.session import new_run_dir
from tallygrid.sources.snapshots import EventLog, SegmentsChanged, SeriesLog, VersionTaken


def ids(rows):
    return sorted(r["id"] + r["client_id"] for r in rows.collect())


@pytest.fixture
def log(spark):
    return EventLog(spark, new_run_dir(spark, "events"))


def day(make_events, number, *clients):
    return make_events([(c, "u", "view", f"2024-01-{number:02d}T10:00:00") for c in clients])


def files(log, segments):
    return sorted(r[0] for r in log.open(segments).select(F.input_file_name()).distinct().collect())


def test_a_crash_before_the_commit_leaves_the_table_as_it_was(log, make_events, monkeypatch):
    log.append(day(make_events, 1, "a", "b"), "one")
    before, version = ids(log.read()), log.version()

    def die(*_):
        raise RuntimeError("lost")

    for step in (
        lambda: log.append(day(make_events, 2, "a"), "two"), lambda: log.reload_tenants(day(make_events, 1, "b"), ["a"], "reload"),
        lambda: log.prune("2024-01-02 10:00:00", days=1),
    ):
        with monkeypatch.context() as broken:
            broken.setattr(log, "commit", die)
            with pytest.raises(RuntimeError):
                step()
        assert ids(log.read()) == before and log.version() == version
    log.append(day(make_events, 2, "a"), "two")  # run again
    assert ids(log.read()) == ["0a", "0a", "1b"]
    log.append(day(make_events, 2, "a"), "two")
    assert ids(log.read()) == ["0a", "0a", "1b"]


def test_two_writers_get_two_versions_and_lose_nothing(log, make_events):
    log.append(day(make_events, 1, "a"), "one")
    other = EventLog(log.spark, log.path)
    base = log.version()
    new = log.write(day(make_events, 3, "c").withColumn("event_date", F.to_date("event_time")).withColumn("load_id", F.lit("three")))
    other.append(day(make_events, 2, "b"), "two")
    with pytest.raises(VersionTaken):
        log.commit(base, log.segments(base) + new)
    log.change(lambda now: now + new)
    assert ids(log.read()) == ["0a", "0b", "0c"] and log.version() == 3


def test_replaced_segments_must_still_be_there(log, make_events):
    log.append(day(make_events, 1, "a"), "one")
    log.append(day(make_events, 1, "b"), "two")
    old = log.segments()
    EventLog(log.spark, log.path).reload_tenants(day(make_events, 1, "a"), ["a"], "reload")
    with pytest.raises(SegmentsChanged):
        log._swap(old, [])
    log.compact("2024-01-05")
    assert ids(log.read()) == ["0a", "0b"]


def test_a_reload_writes_its_tenant_alone_and_compaction_leaves_other_days(log, make_events):
    log.append(make_events([(c, "u", "view", f"2024-01-{d:02d}T10:00:00") for d in range(1, 6) for c in "abc"]), "all")
    before = {s.day: s.folder for s in log.segments()}
    log.reload_tenants(day(make_events, 2, "b"), ["b"], "reload")
    assert {s.day: s.folder for s in log.segments() if s.load_id == "all"} == before
    new = [s for s in log.segments() if s.load_id == "reload"]
    assert [s.day for s in new] == ["2024-01-02"] and log.open(new).count() == 1
    assert log.read().where("client_id = 'b'").count() == 1 and log.read().count() == 11
    log.compact("2024-01-04")
    after = {s.day: s.folder for s in log.segments()}
    assert {d for d in before if after[d] == before[d]} == {"2024-01-04", "2024-01-05"}  # open days; closed ones had lost a tenant
    log.compact("2024-01-04")
    assert {s.day: s.folder for s in log.segments()} == after
    assert log.read().where("client_id = 'b'").count() == 1 and log.read(1).count() == 15


def test_ranges_open_their_segments_alone_and_odd_values_survive(log, make_events):
    log.append(day(make_events, 1, "a"), "load = 1/2: ü")
    log.append(day(make_events, 9, "a"), "two")
    assert [r["load_id"] for r in log.read(end="2024-01-05").collect()] == ["load = 1/2: ü"]
    assert all("2024-01-09" in f for f in files(log, log.chosen(log.segments(), "2024-01-02", None)))
    log.append(day(make_events, 1, "b"), "load = 1/2: ü")
    assert ids(log.read()) == ["0a", "0b"]
    empty = EventLog(log.spark, log.path + "-empty")
    assert empty.read().count() == 0 and empty.version() == 0 and empty.read().columns == log.read().columns
    assert empty.compact("2030-01-01") == 0 and empty.prune("2030-01-01") == 0


def test_vacuum_keeps_what_kept_versions_name(log, make_events):
    log.append(day(make_events, 1, "a", "b"), "one")
    log.append(day(make_events, 1, "c"), "one")
    log.reload_tenants(day(make_events, 1, "d"), ["c"], "reload")
    log.write(day(make_events, 1, "x").withColumn("event_date", F.to_date("event_time")).withColumn("load_id", F.lit("lost")))
    assert log.vacuum(1, "2000-01-01") == 0  # all too young
    log.append(day(make_events, 2, "e"), "two")
    assert log.vacuum(2, "2100-01-01") == 2
    assert ids(log.read()) == ["0d", "0e"] and ids(log.read(log.version() - 1)) == ["0d"]


def test_deltas_fold_alike_in_any_grouping(spark):
    chance = random.Random(5)
    for seed in range(3):
        log = SeriesLog(spark, new_run_dir(spark, "series"))
        state = {}
        for step in range(9):
            columns = chance.choice([("value", "meta_data", "updated_at"), ("value",), ("value", "updated_at")])
            stamp = utc("2024-03-01") if chance.random() < 0.5 else utc(f"2024-03-{step + 1:02d}")
            rows = []
            for key in chance.sample(range(6), 3):
                start = utc(f"2024-02-0{key % 2 + 1}T0{key}:00:00")
                row = {"end": utc(f"2024-02-0{key % 2 + 1}T1{step}:00:00"), "value": float(step), "meta_data": f"m{step}", "created_at": stamp, "updated_at": stamp}
                rows.append(("a", "m", start, row["end"], row["value"], row["meta_data"], stamp, stamp))
                if start in state:
                    state[start].update({name: row[name] for name in columns})
                else:
                    state[start] = row
            for _ in range(chance.choice([1, 2])):  # some loads twice
                log.merge(spark.createDataFrame(rows, AGGREGATES), f"load-{step}", columns)
            if chance.random() < 0.4:
                log.compact(merge_at=2, size_ratio=chance.choice([0, 2, 100]))
        got = {r["interval_start"].timestamp(): (r["interval_end"].timestamp(), r["value"], r["meta_data"], r["created_at"].timestamp(), r["updated_at"].timestamp()) for r in log.read().collect()}
        assert got == {k.timestamp(): (v["end"].timestamp(), v["value"], v["meta_data"], v["created_at"].timestamp(), v["updated_at"].timestamp()) for k, v in state.items()}


def test_a_merge_writes_its_own_rows_only_and_large_segments_stay(spark):
    log = SeriesLog(spark, new_run_dir(spark, "series"))
    start = F.timestamp_seconds(F.col("id") * 60 + 1_706_745_600)
    rows = lambda n, value: spark.range(n).select(
        F.lit("a").alias("client_id"), F.lit("m").alias("metric_name"), start.alias("interval_start"), start.alias("interval_end"), F.lit(value).cast("double").alias("value"),
        F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(value))), 256).alias("meta_data"), start.alias("created_at"), start.alias("updated_at"))
    log.merge(rows(1400, 0), "large")
    large = log.segments()
    for step in range(1, 5):
        log.merge(rows(3, step), f"small-{step}")
    assert log.open([s for s in log.segments() if s.load_id == "small-2"]).count() == 3
    assert set(large) <= set(log.segments())
    log.compact()
    assert set(large) <= set(log.segments()) and len(log.segments()) == 2
    assert log.read().where("value = 4").count() == 3 and log.read().count() == 1400
