"""Row filters shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallygrid.functions.times import Instant, day_of, literal_time


def in_window(
    df: DataFrame,
    start: Instant,
    end: Instant,
    client_id: str | None = None,
    column: str = "event_time",
) -> DataFrame:
    """Rows with ``start <= column < end``, optionally of one tenant.

    The bounds are literals, so they reach the parquet scan. If the table is partitioned by
    ``event_date`` the matching dates are added, which prunes whole partitions.
    """
    keep = (F.col(column) >= literal_time(start)) & (F.col(column) < literal_time(end))
    if column == "event_time" and "event_date" in df.columns:
        keep = F.col("event_date").between(F.lit(day_of(start)), F.lit(day_of(end))) & keep
    if client_id is not None:
        keep = (F.col("client_id") == client_id) & keep
    return df.filter(keep)


def browse_filter(df: DataFrame, event_name: str | None = None, user_id: str | None = None) -> DataFrame:
    """Optional equality filters; an empty string means no filter."""
    if event_name:
        df = df.filter(F.col("event_name") == event_name)
    if user_id:
        df = df.filter(F.col("user_id") == user_id)
    return df


def known_users(df: DataFrame) -> DataFrame:
    return df.filter(F.col("user_id").isNotNull())


def active_keys(registry: DataFrame) -> DataFrame:
    return registry.filter(F.col("is_active"))


def enabled_rules(rules: DataFrame, enabled: bool | None = True) -> DataFrame:
    """Rules by their switch; ``None`` keeps all."""
    return rules if enabled is None else rules.filter(F.col("enabled") == F.lit(enabled))


def list_keys(registry: DataFrame, owner: str) -> DataFrame:
    """One owner's keys, newest first."""
    return registry.filter(F.col("user_id") == owner).orderBy(F.desc("created_at"), F.asc("id"))


def list_rules(rules: DataFrame, client_id: str, enabled: bool | None = None) -> DataFrame:
    """One tenant's rules, newest first."""
    mine = enabled_rules(rules, enabled).filter(F.col("client_id") == client_id)
    return mine.orderBy(F.desc("created_at"), F.asc("id"))


def check_limit(name: str, value: int, bounds: tuple[int, int]) -> int:
    low, high = bounds
    if not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}, got {value}")
    return value


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank_column: str = "rank"
) -> DataFrame:
    """The first ``n`` rows of every group with their rank.

    Catalyst turns the rank filter into a per-task limit before the shuffle (for n up to the session's
    ``windowGroupLimitThreshold``). That suits small n and inputs that are already aggregated; for
    large n over raw rows see ``newest_per_group``.
    """
    ranks = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_column, F.row_number().over(ranks)).filter(F.col(rank_column) <= n)


def newest_per_group(
    df: DataFrame, keys: Sequence[str], time: str, ties: Sequence[str], n: int, rank_column: str = "rank"
) -> DataFrame:
    """The ``n`` newest rows of every group, ties by falling ``ties``, with their rank.

    Counts by second, taken once, tell at which second each group's n-th newest row lies: found among its minutes first, then inside
    that minute. So no more than n rows and those of one second are ranked per group, however large the table is; rows
    without a time come last.
    """
    keys, rows = list(keys), df.withColumn("_second", F.coalesce(F.unix_seconds(time), F.lit(-(2**62))))
    minute = F.floor(F.col("_second") / 60).alias("_minute")
    seconds = rows.groupBy(*keys, minute, "_second").agg(F.count("*").alias("n"))
    by_minute = _cut(seconds.groupBy(*keys, "_minute").agg(F.sum("n").alias("n")), keys, "_minute", F.lit(n))
    inside = seconds.join(by_minute.withColumnRenamed("cut", "_minute"), [*keys, "_minute"]).withColumn("left", n - F.col("newer")).drop("newer")
    by_second = _cut(inside, keys, "_second", F.col("left")).select(*keys, F.col("cut").alias("_from"))
    newest = rows.join(by_second, keys, "left").filter(F.col("_second") >= F.coalesce("_from", F.lit(-(2**62))))
    return top_per_group(newest, keys, [F.desc(c) for c in (time, *ties)], n, rank_column).drop("_second", "_from")


def _cut(counts: DataFrame, keys: Sequence[str], bucket: str, wanted: Column) -> DataFrame:
    """Per group the bucket that holds the ``wanted``-th newest row (none if there are fewer), and the rows newer than it."""
    so_far = Window.partitionBy(*keys).orderBy(F.desc(bucket)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = counts.withColumn("upto", F.sum("n").over(so_far)).withColumn("newer", F.col("upto") - F.col("n"))
    held = summed.filter((F.col("newer") < wanted) & (F.col("upto") >= wanted))
    return held.select(*keys, F.col(bucket).alias("cut"), "newer")


def with_idle_tenants(result: DataFrame, registry: DataFrame | None, zeros: dict[str, Column]) -> DataFrame:
    """One row per active tenant, with ``zeros`` where it has no result of its own."""
    if registry is None:
        return result
    tenants = active_keys(registry).select(F.col("id").alias("client_id"))
    joined = tenants.join(result, "client_id", "left")
    return joined.select(
        *[F.coalesce(F.col(c), zeros[c]).alias(c) if c in zeros else F.col(c) for c in result.columns]
    )
