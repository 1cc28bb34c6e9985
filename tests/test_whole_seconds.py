"""Queries against their SQL on events that fall on whole seconds."""

import duckdb
import pytest
from instants import utc
from oracle import _rows

from tallygrid.plans.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def odd_times(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("whole-seconds"))
    moments = ["2024-01-05 00:00:00", "2024-01-05 10:20:30", "2024-01-05 10:20:30.000001", "2024-01-05 10:20:30.5"]
    rows = [(i, utc(moment), i % 3, "view", 1.0, '{"k": 7}') for i, moment in enumerate(moments)]
    events = spark.createDataFrame(rows, "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING")
    events.selectExpr("* EXCEPT (ts)", "CAST(ts AS TIMESTAMP_NTZ) AS ts").write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", ["fanout_events", "fanout_delivered"])
def test_event_messages_match_sql(spark, odd_times, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{odd_times}/events.parquet/*.parquet'")
    con.execute("CREATE VIEW region AS SELECT 0 AS r_regionkey, 'A' AS r_name")
    cursor = con.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    found = QUERIES[name](spark, odd_times)
    assert _rows(found.columns, found.collect()) == _rows(columns, cursor.fetchall())
