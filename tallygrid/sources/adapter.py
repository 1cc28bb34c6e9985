"""Maps the generated test tables onto the event model.

Tenants are the five regions: tenant 3 is switched off and tenant 4 never sends an event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallygrid.functions.times import literal_time

AS_OF = "2024-01-31 00:00:00"
EVENT_COLUMNS = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def event_columns(raw: DataFrame) -> DataFrame:
    """Event model columns over the generated event columns; works on batch and stream."""
    return raw.select(
        F.col("event_id").cast("string").alias("id"),
        (F.col("user_id") % 4).cast("string").alias("client_id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.col("event_type").alias("event_name"),
        F.col("props").alias("properties"),
        F.col("ts").alias("event_time"),
        F.col("ts").alias("received_at"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # read as an instant at once, so that time bounds reach the parquet scan
    return event_columns(spark.read.schema(EVENT_COLUMNS).parquet(f"{sf_dir}/events.parquet"))


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = spark.readStream.schema(EVENT_COLUMNS).option("pathGlobFilter", "events.parquet")
    return event_columns(stream.parquet(sf_dir))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = spark.read.parquet(f"{sf_dir}/region.parquet")
    key = F.col("r_regionkey")
    return region.select(
        key.cast("string").alias("id"),
        F.col("r_name").alias("client_name"),
        F.sha2(F.concat(F.lit("key-"), key.cast("string")), 256).alias("key_hash"),
        F.concat(F.lit("owner-"), (key % 2).cast("string")).alias("user_id"),
        (key + 2).cast("int").alias("rate_limit"),
        (key != 3).alias("is_active"),
        literal_time("2023-12-01").alias("created_at"),
    )


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule per customer, so that the rule table grows with the data."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    key = F.col("c_custkey")

    def pick(column, *values):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (column % len(values) + 1).cast("int"))

    as_of = literal_time(AS_OF)
    return customer.select(
        F.concat(F.lit("rule-"), key.cast("string")).alias("id"),
        (key % 5).cast("string").alias("client_id"),
        F.col("c_name").alias("name"),
        F.lit(None).cast("string").alias("description"),
        F.struct(
            pick(F.col("c_nationkey"), "events_per_minute", "active_users_1h", "events_per_hour", "unknown")
            .alias("metric"),
            pick(key, ">", "<", ">=", "<=", "==", "!=").alias("operator"),
            (F.floor(F.col("c_acctbal") / 100) / 10).alias("threshold"),
            pick(F.floor(key / 2), "1m", "5m", "1h").alias("window"),
        ).alias("expression"),
        pick(key, "info", "warning", "error", "critical").alias("severity"),
        (key % 7 != 0).alias("enabled"),
        F.when(key % 5 != 4, F.timestamp_micros(F.unix_micros(as_of) - (key % 1200) * 1000000)).alias("last_triggered"),
        (key % 4).cast("int").alias("trigger_count"),
        F.struct(
            (key % 3 != 1).alias("websocket"),
            F.when(
                key % 2 == 0,
                F.array(F.concat(F.lit("a"), key.cast("string"), F.lit("@example.com")), F.lit("ops@example.com")),
            ).alias("email"),
        ).alias("notification_channels"),
        (key * 37 % 3601).cast("int").alias("cooldown_seconds"),
        literal_time("2023-12-01").alias("created_at"),
        literal_time("2023-12-01").alias("updated_at"),
    )


def requests(events_frame: DataFrame) -> DataFrame:
    """The event table seen as a request log, one request per event."""
    return events_frame.select(
        "client_id", F.unix_seconds("received_at").alias("epoch"), F.col("id").cast("bigint").alias("seq")
    )


def envelopes(events_frame: DataFrame, size: int = 10) -> DataFrame:
    """Incoming batches as JSON lines (``value``) out of the events, ``size`` ids each.

    Some events and envelopes are spoiled by a fixed rule on their number, so that every kind
    of refusal occurs; keys 3 (revoked) and 5 (unknown) do not belong to an active tenant.
    """
    number = F.col("id").cast("bigint")
    quote = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    name = F.when(number % 17 == 0, F.lit("")).otherwise(F.col("event_name"))
    user = F.when(number % 19 == 0, F.col("user_id")).otherwise(quote(F.col("user_id")))
    props = F.when(number % 29 == 0, F.lit("[1, 2]")).otherwise(F.col("properties"))
    moment = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    moment = F.when(number % 23 == 0, quote(F.lit("yesterday"))).when(number % 31 == 0, F.lit("null")).otherwise(quote(moment))
    event = F.concat(
        F.lit('{"event_name": '), quote(name), F.lit(', "user_id": '), user, F.lit(', "properties": '), props,
        F.lit(', "event_time": '), moment, F.lit("}"),
    )
    batch = F.floor(number / size)
    # ids are unique, so an envelope collects at most ``size`` events
    packed = events_frame.groupBy(batch.alias("batch")).agg(
        F.sort_array(F.collect_list(F.struct(number.alias("number"), event.alias("event")))).alias("items")
    )
    listed = F.array_join(F.transform("items", lambda item: item["event"]), ", ")
    head = F.concat(F.lit('{"api_key": "key-'), (F.col("batch") % 6).cast("string"), F.lit('", "events": ['))
    line = (
        F.when(F.col("batch") % 37 == 0, head)
        .when(F.col("batch") % 41 == 0, F.concat(head, F.lit("]}")))
        .otherwise(F.concat(head, listed, F.lit("]}")))
    )
    return packed.select(line.alias("value"))


def queued_events(events_frame: DataFrame) -> DataFrame:
    """Queued events as JSON lines, some broken or incomplete by a fixed rule on their number."""
    number = F.col("id").cast("bigint")
    moment = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    whole = F.to_json(
        F.struct(
            "id",
            F.when(number % 17 != 0, F.col("client_id")).alias("client_id"),
            "user_id",
            F.when(number % 19 != 0, F.col("event_name")).alias("event_name"),
            F.parse_json("properties").alias("properties"),
            F.when(number % 23 != 0, moment).alias("event_time"),
            F.when(number % 29 == 0, F.lit("soon")).otherwise(moment).alias("received_at"),
        )
    )
    return events_frame.select(
        F.when(number % 31 == 0, F.substring(whole, 1, 40)).otherwise(whole).alias("value")
    )


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One live connection per supplier."""
    key = F.col("s_suppkey")
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.concat(F.lit("conn-"), key.cast("string")).alias("connection_id"),
        (key % 5).cast("string").alias("client_id"),
    )


def connection_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One subscribe or unsubscribe command per part."""
    key = F.col("p_partkey")
    texts = lambda *names: F.array(*[F.lit(n) for n in names]).cast("array<string>")
    chosen = (
        F.when(key % 5 == 0, texts())
        .when(key % 5 == 1, texts("events"))
        .when(key % 5 == 2, texts("alerts", "metrics"))
        .when(key % 5 == 3, texts("events", "alerts"))
        .otherwise(texts("metrics"))
    )
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        key.cast("bigint").alias("seq"),
        F.concat(F.lit("conn-"), (key % 101).cast("string")).alias("connection_id"),
        F.when(key % 3 == 0, "subscribe").otherwise("unsubscribe").alias("action"),
        chosen.alias("channels"),
    )
