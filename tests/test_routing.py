"""Products of messages and connections are made by all tasks."""

from instants import utc
from pyspark.sql import functions as F

from tallygrid.operators import fanout, temporal


def _messages(spark):
    rows = [("a", "events", str(i), utc(f"2024-01-01 00:{i:02d}:00")) for i in range(40)]
    return spark.createDataFrame(rows, "client_id string, channel string, event_id string, sent_at timestamp").coalesce(1)


def _tasks(spark, df):
    """Tasks that make rows of ``df``, when Spark does not put small ones together."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        return df.withColumn("task", F.spark_partition_id()).select("task").distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_route_is_spread_and_whole(spark):
    subscriptions = spark.createDataFrame([(f"c{i}", "a", "events") for i in range(5)] + [("x", "b", "events")], "connection_id string, client_id string, channel string")
    routed = fanout.route_messages(_messages(spark), subscriptions)
    assert _tasks(spark, routed) > 1
    assert sorted((r["connection_id"], r["event_id"]) for r in routed.collect()) == sorted((f"c{c}", str(i)) for c in range(5) for i in range(40))
    assert routed.columns == ["connection_id", "client_id", "channel", "event_id", "sent_at"]


def test_route_repeats_and_nulls(spark):
    messages = spark.createDataFrame([("a", "events", None), ("a", "events", None), (None, "events", "1")], "client_id string, channel string, event_id string")
    subscriptions = spark.createDataFrame([("c", "a", "events"), ("c", "a", "events"), ("d", None, "events")], "connection_id string, client_id string, channel string")
    assert [tuple(r) for r in fanout.route_messages(messages, subscriptions).collect()] == [("c", "a", "events", None)] * 4


def test_route_as_of_is_spread_and_whole(spark):
    periods = [(f"c{i}", "a", "events", utc(f"2024-01-01 00:{10 * i:02d}:00"), None) for i in range(3)]
    frame = spark.createDataFrame(periods, "connection_id string, client_id string, channel string, valid_from timestamp, valid_until timestamp")
    routed = temporal.route_as_of(_messages(spark), frame)
    assert _tasks(spark, routed) > 1
    assert sorted((r["connection_id"], int(r["event_id"])) for r in routed.collect()) == sorted((f"c{c}", i) for c in range(3) for i in range(10 * c, 40))
    assert routed.columns == ["connection_id", "client_id", "channel", "event_id", "sent_at"]


def _shares(df):
    """Rows of ``df`` made by each task, under the session's own settings."""
    return sorted(row["count"] for row in df.groupBy(F.spark_partition_id().alias("task")).count().collect())


def _many(spark, tenants):
    return spark.range(4000).select(
        F.concat(F.lit("t"), (F.col("id") % tenants).cast("string")).alias("client_id"), F.lit("events").alias("channel"),
        F.col("id").cast("string").alias("event_id"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id")).alias("sent_at"),
    )


def test_products_are_shared_by_all_tasks(spark):
    """What is read is small, so Spark puts a join of its own into a task or two, however many rows it makes."""
    periods = spark.range(100).select(
        F.concat(F.lit("c"), F.col("id").cast("string")).alias("connection_id"), F.lit("t0").alias("client_id"), F.lit("events").alias("channel"),
        F.lit(None).cast("timestamp").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_until"),
    )
    routed = fanout.route_messages(_many(spark, 1), periods.drop("valid_from", "valid_until"))
    for made in (routed, temporal.route_as_of(_many(spark, 1), periods)):
        shares = _shares(made)
        assert sum(shares) == 400_000
        assert len(shares) > 16 and shares[-1] < 40_000


def test_product_keeps_nulls_and_repeats_beside_the_keys(spark):
    messages = spark.createDataFrame([("a", None, 1), ("a", None, 1), (None, "x", 2), ("b", "y", 3)], "k string, note string, n int")
    others = spark.createDataFrame([("a", None), ("a", None), ("a", "p"), (None, "q")], "k string, name string")
    made = fanout.product_join(messages, others, ["k"])
    assert made.columns == ["k", "note", "n", "name"]
    assert sorted(tuple(r) for r in made.collect() if r["name"]) == [("a", None, 1, "p")] * 2
    assert [tuple(r) for r in made.filter("name IS NULL").collect()] == [("a", None, 1, None)] * 4
    assert fanout.product_join(messages.limit(0), others, ["k"]).count() == fanout.product_join(messages, others.limit(0), ["k"]).count() == 0
