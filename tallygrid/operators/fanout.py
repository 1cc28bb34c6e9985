"""Live feed: messages, subscriptions, routing and the newest-first tail."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from tallygrid.fixed_values import DEFAULT_CHANNELS, LIVE_TAIL_SIZE, NOTICE_CHANNEL, NOTICE_DELIVERY_CHANNEL
from tallygrid.functions.times import iso_micros, iso_text
from tallygrid.operators.filters import newest_per_group

_JSON = {"ignoreNullFields": "false"}

#: of a product: tasks a core, so that uneven ones even out; blocks of messages a task; arrays that hold the other rows of a key
PRODUCT_TASKS, BLOCKS, PACKS = 8, 4, 16


def _message(channel: str, body: Column) -> list[Column]:
    return [F.col("client_id"), F.lit(channel).alias("channel"), F.to_json(body, _JSON).alias("message")]


def _event_body(as_text: Callable[[Column], Column]) -> Column:
    return F.struct(
        "id", "client_id", "user_id", "event_name",
        F.try_parse_json("properties").alias("properties"),
        as_text(F.col("event_time")).alias("event_time"),
        as_text(F.col("received_at")).alias("received_at"),
    )


def fanout_events(df: DataFrame, delivered: bool = False, keep: tuple[str, ...] = (), even: bool = False) -> DataFrame:
    """One message per event on its tenant's ``events`` channel, with the ``keep`` columns beside it.

    The published form is ``{client_id, event}``; the ``delivered`` form is what a connection
    receives: ``{type, data, timestamp}``. Times have microseconds only when there are any; ``even`` ones
    always have six digits.
    """
    as_text = iso_micros if even else iso_text
    body = _event_body(as_text)
    published = F.struct("client_id", body.alias("event"))
    outgoing = F.struct(F.lit("event").alias("type"), body.alias("data"), as_text(F.col("received_at")).alias("timestamp"))
    return df.select(*_message("events", outgoing if delivered else published), *keep)


def fanout_metrics(aggregates: DataFrame, delivered: bool = True) -> DataFrame:
    """One message per stored metric value; published as ``{client_id, metric, value, metadata}``."""
    metadata = F.coalesce(F.try_parse_json("meta_data"), F.parse_json(F.lit("{}"))).alias("metadata")
    head = F.lit("metric").alias("type") if delivered else F.col("client_id")
    return aggregates.select(*_message("metrics", F.struct(head, F.col("metric_name").alias("metric"), "value", metadata)))


def fanout_alerts(notifications: DataFrame, delivered: bool = True) -> DataFrame:
    """One message per websocket notification; published as ``{client_id, alert}``. The message's own
    ``timestamp`` is the time of the firing: no query reads the clock."""
    fired = iso_text(F.col("triggered_at"))
    body = F.struct(
        F.lit("alert").alias("type"), "alert_id", "alert_name", "severity", "message",
        F.try_parse_json("context").alias("context"),
        fired.alias("triggered_at"),
        fired.alias("timestamp"),
    )
    outgoing = body if delivered else F.struct("client_id", body.alias("alert"))
    return notifications.filter(F.col("channel") == "websocket").select(*_message("alerts", outgoing))


def fanout_notices(notices: DataFrame, delivered: bool = True) -> DataFrame:
    """One message per rate-limit notice: published ``{client_id, limit, reset_at}`` on a channel of its own,
    delivered on the ``events`` channel."""
    if not delivered:
        return notices.select(*_message(NOTICE_CHANNEL, F.struct("client_id", "limit", "reset_at")))
    body = F.struct(F.lit("rate_limit_exceeded").alias("type"), "limit", "reset_at")
    return notices.select(*_message(NOTICE_DELIVERY_CHANNEL, body))


def subscription_state(connections: DataFrame, commands: DataFrame) -> DataFrame:
    """(connection_id, client_id, channel) after a log of subscribe and unsubscribe commands.

    A connection starts on the default channels. A subscribe with channels replaces the set, an
    empty one does nothing; an unsubscribe removes channels. Commands are ordered by ``seq``.
    """
    replaced = commands.filter((F.col("action") == "subscribe") & (F.size("channels") > 0)).groupBy(
        "connection_id"
    ).agg(F.max_by("channels", "seq").alias("channels"), F.max("seq").alias("since"))
    removed = (
        commands.filter(F.col("action") == "unsubscribe")
        .select("connection_id", "seq", F.explode("channels").alias("channel"))
        .groupBy("connection_id", "channel")
        .agg(F.max("seq").alias("removed_at"))
    )
    default = F.array(*[F.lit(c) for c in DEFAULT_CHANNELS])
    current = connections.select("connection_id", "client_id").join(replaced, "connection_id", "left").select(
        "connection_id",
        "client_id",
        "since",
        F.explode(F.array_distinct(F.coalesce("channels", default))).alias("channel"),
    )
    gone = F.col("removed_at").isNotNull() & (F.col("since").isNull() | (F.col("removed_at") > F.col("since")))
    return (
        current.join(removed, ["connection_id", "channel"], "left")
        .filter(~gone)
        .select("connection_id", "client_id", "channel")
    )


def product_join(messages: DataFrame, others: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``messages`` with every row of ``others`` that has the same ``on``, for joins that make far more rows than they read.

    ``messages`` are dealt evenly into blocks and ``others`` come once for each block, so that all tasks share the rows of a busy key. The
    number of tasks is set here: Spark would choose it by the size of what is read and put all into a few. The rows of ``others`` travel as
    arrays, up to ``PACKS`` for a key, and are taken out of them where rows are made. Nothing is broadcast beyond Spark's size threshold.
    """
    spark = messages.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism * PRODUCT_TASKS)
    known = reduce(and_, [F.col(c).isNotNull() for c in on])  # null equals nothing in a join, but does inside a struct
    rest = [c for c in others.columns if c not in on]
    numbered = others.filter(known).withColumn("_pack", F.pmod(F.xxhash64(*rest), F.lit(PACKS))).repartition(tasks, *on, "_pack")
    packs = numbered.groupBy(*on, "_pack").agg(F.collect_list(F.struct(*rest)).alias("_rows"))
    blocks = F.sequence(F.lit(0), F.lit(tasks * BLOCKS - 1))
    place = F.struct(*on, "_block").cast(f"struct<{', '.join(f'{c}: {messages.schema[c].dataType.simpleString()}' for c in on)}, _block: int>")
    copies = packs.select(*on, "_rows", F.explode(blocks).alias("_block")).select(place.alias("_place"), "_rows")
    dealt = messages.filter(known).repartition(tasks * BLOCKS).withColumn("_block", F.spark_partition_id()).withColumn("_place", place)
    joined = dealt.repartition(tasks, "_place").join(copies.repartition(tasks, "_place"), "_place")
    return joined.select(*messages.columns, F.inline("_rows"))


def route_messages(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Each message to each connection of its tenant that is subscribed to its channel.

    ``messages`` are best ids with tenant and channel (texts are stored once, see ``stream_fanout``), and
    ``subscriptions`` those of the connections whose feed is asked for: the result is their product per tenant (see ``product_join``).
    """
    routed = product_join(messages, subscriptions.select("client_id", "channel", "connection_id"), ["client_id", "channel"])
    return routed.select("connection_id", *messages.columns)


def live_tail(df: DataFrame, n: int = LIVE_TAIL_SIZE) -> DataFrame:
    """The newest ``n`` events of each tenant with the tenant's running total (see ``newest_per_group``)."""
    newest = newest_per_group(df, ["client_id"], "received_at", ["id"], n, "position")
    totals = df.groupBy("client_id").agg(F.count("*").alias("total"))
    return newest.join(totals, "client_id")
