"""Queries that write on the way, on a cluster of processes whose shared folder is a path without a scheme."""

import json
import subprocess
import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

REPO = str(Path(__file__).resolve().parent.parent)
# one for each way of writing: partitions replaced, text files, summaries by day, a versioned log
NAMES = ["append_events", "export_events_csv", "sketch_top_events", "series_log_merge"]
RUN = """
import json, sys
from pyspark.sql import SparkSession
from tallygrid.plans.catalog import QUERIES
folder, tables, *names = sys.argv[1:]
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "1g", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2",
        "spark.checkpoint.dir": folder, "spark.local.dir": folder + "-local", "spark.driver.host": "127.0.0.1", "spark.sql.session.timeZone": "UTC"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
print("ROWS" + json.dumps({name: sorted(str(row) for row in QUERIES[name](spark, tables).collect()) for name in names}))
spark.stop()
"""


@pytest.fixture
def tables(spark, tmp_path):
    start = datetime(2024, 1, 25)
    rows = [(n, start + timedelta(hours=5 * n, microseconds=n), n % 7, ("view", "click")[n % 2], float(n), f'{{"k": {n}, "quoted": "a, b"}}') for n in range(25)]
    events = spark.createDataFrame(rows, "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING")
    events.write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(n, f"region {n}") for n in range(5)], "r_regionkey INT, r_name STRING").write.parquet(f"{tmp_path}/region.parquet")
    return str(tmp_path)


def test_cluster_gives_the_rows_of_a_local_session(spark, tables, tmp_path):
    from tallygrid.plans.catalog import QUERIES

    shared = tmp_path / "shared"
    shared.mkdir()
    ran = subprocess.run([sys.executable, "-c", RUN, str(shared), tables, *NAMES], cwd=REPO, capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0, ran.stderr[-2000:]
    found = json.loads(next(line for line in ran.stdout.splitlines() if line.startswith("ROWS"))[4:])
    for name in NAMES:
        assert found[name], name
        assert found[name] == sorted(str(row) for row in QUERIES[name](spark, tables).collect()), name
