"""Sliding-window rate decisions over a request log (client_id, epoch, seq).

A request at second s is admitted when fewer than ``limit`` earlier requests were admitted in
``(s - window, s]``. Denied requests leave no trace, so the rule is recursive in time. It only
depends on how many requests fall into each second, though: the recursion therefore runs over
per-second counts (at most 86,400 rows per key and day, whatever the traffic), streamed through
a task in time order, and its answer is joined back to the requests.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tallygrid.fixed_values import DEFAULT_RATE_LIMIT, RATE_WINDOW_SECONDS

PER_REQUEST, DISTINCT_SECOND = "per_request", "distinct_second"
# seq values are unique, so one (key, second, seq block) never holds more rows than this
SEQ_BLOCK = 1_000_000
SLICE_SECONDS = 3600

_DECISION = "client_id STRING, epoch BIGINT, limit BIGINT, prior BIGINT, entered BIGINT, seen BOOLEAN"


def _decide(window: int, mode: str):
    """Per-partition walk over (key, second) rows sorted by key and time; keeps one window."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, recent, held = None, deque(), 0
        for frame in batches:
            rows = []
            columns = (frame[c].tolist() for c in ("client_id", "epoch", "requests", "carried", "limit"))
            for client, epoch, requests, carried, limit in zip(*columns):
                if client != key:
                    key, recent, held = client, deque(), 0
                while recent and recent[0][0] <= epoch - window:
                    held -= recent.popleft()[1]
                if carried:
                    recent.append((epoch, carried))
                    held += carried
                if not requests:
                    continue
                seen = bool(recent) and recent[-1][0] == epoch
                if mode == PER_REQUEST:
                    entered = max(0, min(requests, limit - held))
                else:
                    entered = int(held < limit and not seen)
                rows.append((client, epoch, limit, held, entered, seen))
                if entered:
                    recent.append((epoch, entered))
                    held += entered
            yield pd.DataFrame(rows, columns=["client_id", "epoch", "limit", "prior", "entered", "seen"])

    return walk


def _limits(limits: DataFrame) -> DataFrame:
    return limits.select(F.col("id").alias("client_id"), F.col("rate_limit").cast("bigint").alias("limit"))


def decide_seconds(
    seconds: DataFrame,
    limits: DataFrame,
    window: int = RATE_WINDOW_SECONDS,
    mode: str = PER_REQUEST,
    carry: DataFrame | None = None,
) -> DataFrame:
    """Per (key, second): entries held before it and entries it adds.

    ``seconds`` is (client_id, epoch, requests); ``carry`` is (client_id, epoch, entered) of
    earlier runs, so that a log can be processed day by day or batch by batch.
    """
    if mode not in (PER_REQUEST, DISTINCT_SECOND):
        raise ValueError(f"unknown mode {mode!r}")
    rows = seconds.select("client_id", "epoch", "requests", F.lit(0).cast("bigint").alias("carried"))
    if carry is not None:
        earlier = carry.select("client_id", "epoch", F.lit(0).cast("bigint").alias("requests"), F.col("entered").alias("carried"))
        rows = rows.unionByName(earlier)
    rows = rows.join(_limits(limits), "client_id", "left").withColumn(
        "limit", F.coalesce("limit", F.lit(DEFAULT_RATE_LIMIT).cast("bigint"))
    )
    in_order = rows.repartition("client_id").sortWithinPartitions("client_id", "epoch", "requests")
    return in_order.mapInPandas(_decide(window, mode), _DECISION)


def admit(
    requests: DataFrame,
    limits: DataFrame,
    window: int = RATE_WINDOW_SECONDS,
    mode: str = PER_REQUEST,
    carry: DataFrame | None = None,
) -> DataFrame:
    """Every request with allowed, current, limit, remaining and reset_at.

    ``per_request`` counts each admitted request. ``distinct_second`` stores one entry per
    second, so requests of one second count once and a limit above the window never denies.
    """
    block = F.expr(f"seq div {SEQ_BLOCK}")
    # stated here so that both uses of the counts are the same plan and share one shuffle
    requests = requests.filter("client_id IS NOT NULL AND epoch IS NOT NULL AND seq IS NOT NULL")
    blocks = requests.groupBy("client_id", "epoch", block.alias("block")).agg(F.count("*").alias("requests"))
    seconds = blocks.groupBy("client_id", "epoch").agg(F.sum("requests").alias("requests"))
    decided = decide_seconds(seconds, limits, window, mode, carry)
    before = Window.partitionBy("client_id", "epoch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("skipped", F.coalesce(F.sum("requests").over(before), F.lit(0))).drop("requests")
    keys = ["client_id", "epoch"]
    plan = placed.join(decided, keys)
    rows = requests.select("client_id", "epoch", "seq", block.alias("block")).join(plan, keys + ["block"])
    within = F.row_number().over(Window.partitionBy(*keys, "block").orderBy("seq"))
    # position of the request among those of its second
    ranked = rows.withColumn("position", F.col("skipped") + within)

    prior, entered, limit, position = (F.col(c) for c in ("prior", "entered", "limit", "position"))
    if mode == PER_REQUEST:
        allowed = position <= entered
        current = prior + F.least(position, entered)
    else:
        held = F.when(position == 1, prior).otherwise(prior + entered)
        allowed = held < limit
        current = held + F.when(allowed, 1).otherwise(0)
    decisions = ranked.withColumns({"allowed": allowed, "current": current})
    return decisions.select(
        "client_id",
        "epoch",
        "seq",
        "allowed",
        "current",
        "limit",
        F.greatest(F.lit(0), limit - F.col("current")).alias("remaining"),
        (F.col("epoch") + window).alias("reset_at"),
    )


def carry_after(
    admitted: DataFrame,
    carry: DataFrame | None = None,
    window: int = RATE_WINDOW_SECONDS,
    mode: str = PER_REQUEST,
    lateness: int | None = None,
) -> DataFrame:
    """What later requests need to know of ``admit`` and of the carry it started from.

    Each key is cut at its own newest request: entries of its last ``window + lateness`` seconds stay
    (``lateness`` is one window unless given), so one key's clock does not touch another's. ``newest`` is that
    request's time, kept also for a key without entries.
    """
    lateness = window if lateness is None else lateness
    entries = admitted.filter("allowed").groupBy("client_id", "epoch").agg(F.count("*").alias("entered"))
    moments = admitted.select("client_id", F.col("epoch").alias("newest"))
    if carry is not None:
        entries = entries.unionByName(carry.select("client_id", "epoch", "entered"))
        moments = moments.unionByName(carry.select("client_id", "newest"))
    newest = moments.groupBy("client_id").agg(F.max("newest").alias("newest"))
    recent = entries.join(newest, "client_id").filter(F.col("epoch") > F.col("newest") - window - lateness)
    marks = newest.select("client_id", F.col("newest").alias("epoch"), F.lit(0).cast("bigint").alias("entered"), "newest")
    entered = F.sum("entered") if mode == PER_REQUEST else F.least(F.sum("entered"), F.lit(1).cast("bigint"))
    both = recent.select("client_id", "epoch", "entered", "newest").unionByName(marks)
    return both.groupBy("client_id", "epoch").agg(entered.alias("entered"), F.max("newest").alias("newest"))


def split_late(
    requests: DataFrame, carry: DataFrame | None, window: int = RATE_WINDOW_SECONDS, lateness: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(requests that can be decided, requests too late for it with a ``reason``).

    A request more than ``lateness`` seconds older than its key's newest earlier one would meet a history
    that is no longer whole."""
    lateness = window if lateness is None else lateness
    if carry is None:
        return requests, requests.limit(0).withColumn("reason", F.lit(""))
    newest = carry.groupBy("client_id").agg(F.max("newest").alias("newest"))
    marked = requests.join(newest, "client_id", "left").withColumn(
        "late", F.coalesce(F.col("epoch") <= F.col("newest") - lateness, F.lit(False))
    )
    late = marked.filter("late").withColumn("reason", F.lit("older than the lateness allowed for its key"))
    return marked.filter("NOT late").drop("late", "newest"), late.drop("late", "newest")


def attempt_rate(
    requests: DataFrame, window: int = RATE_WINDOW_SECONDS, per_request: bool = False
) -> DataFrame:
    """Attempts per key and second, and attempts in the window that ends with that second.

    Counts are sliced by key and hour, each slice also receiving the last seconds of the one
    before, so a busy key is spread over many tasks. Within a slice every second adds its
    attempts when it comes and takes them off one window later, so a running sum is enough and
    the work does not grow with the window. ``per_request`` joins the figure back.
    """
    seconds = requests.groupBy("client_id", "epoch").agg(F.count("*").alias("attempts"))
    length = max(SLICE_SECONDS, window)
    late = F.pmod(F.col("epoch"), F.lit(length)) > length - window
    sliced = seconds.withColumn("own", F.floor(F.col("epoch") / length)).withColumn(
        "slice", F.explode(F.when(late, F.array(F.col("own"), F.col("own") + 1)).otherwise(F.array("own")))
    )
    comes = F.struct(F.col("epoch").alias("moment"), F.lit(1).alias("order"), F.col("attempts").alias("change"))
    goes = F.struct((F.col("epoch") + window).alias("moment"), F.lit(0).alias("order"), (-F.col("attempts")).alias("change"))
    # what goes after the end of the slice no longer matters there
    in_slice = (F.col("epoch") + window) < (F.col("slice") + 1) * length
    steps = sliced.withColumn("step", F.explode(F.when(in_slice, F.array(comes, goes)).otherwise(F.array(comes))))
    so_far = (
        Window.partitionBy("client_id", "slice")
        .orderBy("step.moment", "step.order")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rated = steps.withColumn("in_window", F.sum("step.change").over(so_far)).filter(
        (F.col("step.order") == 1) & (F.col("slice") == F.col("own"))
    )
    rated = rated.select("client_id", "epoch", "attempts", "in_window")
    if per_request:
        return requests.join(rated.drop("attempts"), ["client_id", "epoch"])
    return rated


def limit_notices(admitted: DataFrame) -> DataFrame:
    """One notice per denied request."""
    return admitted.filter(~F.col("allowed")).select("client_id", "limit", "reset_at")
