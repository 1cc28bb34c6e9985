"""Checking of incoming event batches and of queued events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallygrid.fixed_values import MAX_BATCH_EVENTS, MAX_NAME_LENGTH, MAX_PROPERTIES_LENGTH
from tallygrid.functions.checks import failed, split_by_reasons
from tallygrid.functions.times import parse_time
from tallygrid.schemas import EVENT_COLUMNS

REJECT_BATCH, SKIP_EVENT = "reject_batch", "skip_event"
MALFORMED = "malformed JSON"


def _member(event: Column, name: str) -> Column:
    return F.try_variant_get(event, f"$.{name}", "variant")


def _text(event: Column, name: str) -> Column:
    return F.try_variant_get(event, f"$.{name}", "string")


def _not_text(value: Column) -> Column:
    """Whether a JSON scalar is there but is neither text nor null."""
    return value.isNotNull() & ~F.schema_of_variant(value).isin("STRING", "VOID")


def _extracted(event: Column, time_field: str) -> Column:
    """The members of one JSON event, each read once."""
    properties = _member(event, "properties")
    return F.struct(
        event.alias("event"),
        _member(event, "event_name").alias("name_json"),
        _text(event, "event_name").alias("event_name"),
        _member(event, "user_id").alias("user_json"),
        _text(event, "user_id").alias("user_id"),
        F.when(~F.is_variant_null(properties), F.to_json(properties)).alias("properties"),
        _text(event, time_field).alias("time_text"),
    )


def _timed(item: Column) -> Column:
    return item.withField("event_time", parse_time(item["time_text"]))


def _judged(item: Column) -> Column:
    """The event's columns and the reasons why it is not acceptable."""
    name, user, properties = item["event_name"], item["user_id"], item["properties"]
    not_an_object = F.when(name.isNull(), ~F.coalesce(F.schema_of_variant(item["event"]).startswith("OBJECT"), F.lit(False)))
    faults = failed(
        ("event must be an object", not_an_object),
        ("event_name must be text", name.isNull() | _not_text(item["name_json"])),
        ("event_name must have 1 to 255 characters", ~F.length(name).between(1, MAX_NAME_LENGTH)),
        ("user_id must be text", _not_text(item["user_json"])),
        ("user_id must have at most 255 characters", F.length(user) > MAX_NAME_LENGTH),
        ("properties must be an object", ~properties.startswith("{")),
        ("properties exceed 100000 characters", F.length(properties) > MAX_PROPERTIES_LENGTH),
        ("event_time is not a time", item["time_text"].isNotNull() & item["event_time"].isNull()),
    )
    return F.struct(
        user.alias("user_id"),
        name.alias("event_name"),
        properties.alias("properties"),
        item["event_time"].alias("event_time"),
        item["event"].alias("event"),
        faults.alias("faults"),
    )


def parse_batches(lines: DataFrame) -> DataFrame:
    """Text lines (``value``) as envelopes: api_key, events, batch_reasons, raw.

    A line is ``{"api_key": ..., "events": [...]}`` with 1 to 1000 events, or a single event with its
    own members beside the key: ``{"api_key": ..., "event_name": ...}``.
    """
    parsed = lines.select("value", F.try_parse_json("value").alias("doc"))
    single = F.try_variant_get("doc", "$.events", "variant").isNull()
    parsed = parsed.select(
        "value",
        "doc",
        F.try_variant_get("doc", "$.api_key", "string").alias("api_key"),
        F.coalesce(
            F.try_variant_get("doc", "$.events", "array<variant>"),
            F.when(single & F.try_variant_get("doc", "$.event_name", "variant").isNotNull(), F.array("doc")),
        ).alias("events"),
    )
    count = F.size("events")
    reasons = failed(
        (MALFORMED, F.col("doc").isNull()),
        ("events must be a list", F.col("doc").isNotNull() & F.col("events").isNull()),
        ("batch must have 1 to 1000 events", F.col("events").isNotNull() & ~count.between(1, MAX_BATCH_EVENTS)),
    )
    return parsed.select("api_key", "events", reasons.alias("batch_reasons"), F.col("value").alias("raw"))


def explode_batches(batches: DataFrame, policy: str = REJECT_BATCH, time_field: str = "event_time") -> DataFrame:
    """One row per event with its ``reasons``; an envelope that fails as a whole is one row.

    ``reject_batch`` refuses every event of an envelope that has a bad one, ``skip_event`` only
    the bad ones. ``time_field`` names the member that carries the client's time.
    """
    if policy not in (REJECT_BATCH, SKIP_EVENT):
        raise ValueError(f"unknown policy {policy!r}")
    whole = F.size("batch_reasons") == 0
    if policy == SKIP_EVENT:
        # nothing to know about the other events: explode first, check row by row
        rows = batches.select(
            "api_key", "batch_reasons", "raw", F.lit(False).alias("spoiled"),
            F.posexplode_outer(F.when(whole, F.col("events"))).alias("place", "event"),
        )
        item = F.when(F.col("event").isNotNull(), _extracted(F.col("event"), time_field))
        rows = rows.withColumn("item", item).withColumn("item", _timed(F.col("item")))
        # as a list of one, so that a later filter on the faults does not judge the event anew for each use of it
        rows = rows.withColumn("item", F.explode(F.array(F.when(F.col("item").isNotNull(), _judged(F.col("item"))))))
    else:
        # an envelope has at most 1000 events here, so it is judged as one row
        items = F.transform(F.when(whole, F.col("events")), lambda e: _extracted(e, time_field))
        checked = batches.withColumn("items", items)
        checked = checked.withColumn("items", F.transform("items", _timed))
        checked = checked.withColumn("items", F.transform("items", _judged))
        spoiled = F.coalesce(F.exists("items", lambda i: F.size(i["faults"]) > 0), F.lit(False))
        rows = checked.select(
            "api_key", "batch_reasons", "raw", spoiled.alias("spoiled"), F.posexplode_outer("items").alias("place", "item")
        )
    faults = F.col("item.faults")
    reasons = (
        F.when(F.col("item").isNull(), F.col("batch_reasons"))
        .when(F.col("spoiled") & (F.size(faults) == 0), F.array(F.lit("another event of the batch is not valid")))
        .otherwise(faults)
    )
    # only refused rows carry their text, and a refused envelope only once
    refused = F.when(F.size("reasons") > 0, F.coalesce(F.to_json("item.event"), F.col("raw")))
    return rows.withColumn("reasons", reasons).select(
        "api_key", "item.user_id", "item.event_name", "item.properties", "item.event_time", "reasons", refused.alias("raw"),
        event_id(F.col("raw"), F.col("place")).alias("id"),
    )


def event_id(line: Column, place: Column, load: Column | None = None) -> Column:
    """Tracking id of an event: a hash of its line, its place in it and the load, so that a repeated job gives the same ids."""
    return F.md5(F.concat_ws("|", *([load] if load is not None else []), place, line))


def validate_events(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(acceptable events, rejected rows with reasons) of ``explode_batches`` output."""
    return split_by_reasons(df)


def mark_clients(df: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds ``client_id`` from the presented key; NULL when no active key matches."""
    keys = registry.filter(F.col("is_active")).select("key_hash", F.col("id").alias("client_id"))
    hashed = df.withColumn("key_hash", F.sha2(F.trim("api_key"), 256))
    return hashed.join(keys, "key_hash", "left").drop("key_hash")


def attribute_clients(df: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with ``client_id``, rows whose key is unknown or revoked); the key is dropped."""
    marked = mark_clients(df, registry).drop("api_key")
    known = F.col("client_id").isNotNull()
    return marked.filter(known), marked.filter(~known).drop("client_id")


def apply_defaults(df: DataFrame, received_at: Column | None = None) -> DataFrame:
    """Receipt time, event time where missing, and a tracking id where there is none yet."""
    received = F.current_timestamp() if received_at is None else received_at
    tracking = F.col("id") if "id" in df.columns else F.uuid()
    return df.withColumns({"id": tracking, "received_at": received, "event_time": F.coalesce("event_time", received)})


def check_batches(
    lines: DataFrame,
    registry: DataFrame,
    policy: str = REJECT_BATCH,
    time_field: str = "event_time",
    received_at: Column | None = None,
) -> DataFrame:
    """Every incoming event once, complete if acceptable, with ``reasons`` and ``raw`` if not. Equal lines get equal ids;
    ``unique_ids`` tells them apart within a load."""
    rows = mark_clients(explode_batches(parse_batches(lines), policy, time_field), registry)
    # an envelope that cannot be read has no key to judge
    readable = ~F.array_contains("reasons", MALFORMED)
    unknown = F.when(readable & F.col("client_id").isNull(), F.array(F.lit("unknown or revoked key")))
    rows = rows.withColumn("reasons", F.concat("reasons", F.coalesce(unknown, F.array().cast("array<string>"))))
    return apply_defaults(rows, received_at).select(*EVENT_COLUMNS, "reasons", "raw")


def unique_ids(rows: DataFrame, load: str) -> DataFrame:
    """The rows of one load with ids of their own: a hash of the load, the id from ``check_batches`` and the number among equal ones.

    Equal lines of a load have equal ids before; their copies are told apart by numbers from 1 on, so a repeat of the load gives
    the same ids. Copies are counted by task first: one line that makes up most of a load is numbered by all tasks."""
    placed = rows.withColumn("_task", F.spark_partition_id())
    counts = placed.groupBy("id", "_task").agg(F.count("*").alias("_n"))
    ids = Window.partitionBy("id")
    repeated = counts.withColumns({"_all": F.sum("_n").over(ids), "_before": F.sum("_n").over(ids.orderBy("_task")) - F.col("_n")}).where("_all > 1")
    copies = placed.join(repeated.select("id", "_task", "_before"), ["id", "_task"])
    numbered = copies.withColumn("_copy", F.col("_before") + F.row_number().over(Window.partitionBy("id", "_task").orderBy("id")))
    single = placed.join(repeated.select("id", "_task"), ["id", "_task"], "left_anti").withColumn("_copy", F.lit(1).cast("bigint"))
    own = F.md5(F.concat_ws("|", F.lit(load), "id", "_copy"))
    every = single.select(*rows.columns, "_copy").unionByName(numbered.select(*rows.columns, "_copy"))
    return every.withColumn("id", own).drop("_copy")


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("reasons") == 0).select(*EVENT_COLUMNS)


def quarantined(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("reasons") > 0).select("client_id", "received_at", "reasons", "raw")


def structural_check(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(typed events, rejected rows) of queued events read as text.

    Tenant, name and both times must be there and the times must be ISO text.
    """

    def bad_time(name: str) -> Column:
        return F.coalesce(~F.col(name).rlike(r"^\d{4}-\d{2}-\d{2}"), F.lit(True)) | parse_time(F.col(name)).isNull()

    corrupt = F.col("corrupt").isNotNull() if "corrupt" in df.columns else F.lit(False)
    readable = ~corrupt
    reasons = failed(
        (MALFORMED, corrupt),
        ("client_id is missing", readable & F.col("client_id").isNull()),
        ("event_name is missing", readable & F.col("event_name").isNull()),
        ("event_time is missing or not a time", readable & bad_time("event_time")),
        ("received_at is missing or not a time", readable & bad_time("received_at")),
    )
    good, rejected = split_by_reasons(df.withColumn("reasons", reasons))
    typed = good.withColumns({name: parse_time(F.col(name)) for name in ("event_time", "received_at")})
    return typed.select(*EVENT_COLUMNS), rejected


def ingest_report(checked: DataFrame, *keys: str) -> DataFrame:
    """Events per status and reason: (keys), status, reason, events."""
    status = F.when(F.size("reasons") == 0, "processed").otherwise("failed")
    return checked.groupBy(*keys, status.alias("status"), F.concat_ws("; ", "reasons").alias("reason")).agg(
        F.count("*").alias("events")
    )
