"""Partitioned parquet tables: append, partition overwrite and retention.

Nothing is read and overwritten in one plan: results go to a fresh folder in the shared area
first, and that copy is what replaces the partitions.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallygrid.fixed_values import AGGREGATE_RETENTION_DAYS, EVENT_RETENTION_DAYS
from tallygrid.functions.times import Instant, at, literal_time
from tallygrid.operators.series import upsert_aggregates
from tallygrid.session import new_run_dir
from tallygrid.sources.readers import read_aggregates, read_stored_events


@contextmanager
def staged(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """``df`` written once to the shared folder and read back, for the length of a block: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = new_run_dir(spark, label)
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        delete_folder(spark, path)


def delete_folder(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def with_event_date(df: DataFrame) -> DataFrame:
    return df.withColumn("event_date", F.to_date("event_time"))


def with_interval_date(df: DataFrame) -> DataFrame:
    return df.withColumn("interval_date", F.to_date("interval_start"))


def _balanced(df: DataFrame, partition_column: str, *sort: str) -> DataFrame:
    """Evenly sized files per partition: a busy day is split, small days share tasks."""
    return df.hint("rebalance", partition_column).sortWithinPartitions(partition_column, *sort)


def append_events(df: DataFrame, path: str, load_id: str | None = None) -> None:
    """Append to the event table; sorted so that tenant and time bounds skip row groups.

    Every load has its own folder below each day. Repeating a load under the same ``load_id``
    replaces all of it, also on days that the repeat no longer has, so a job that failed half-way can
    simply run again. Two jobs must not share load ids.
    """
    spark = df.sparkSession
    load = load_id or uuid.uuid4().hex
    stored = with_event_date(df).withColumn("load_id", F.lit(load))
    before = _days_of_load(spark, path, load)
    overwrite_partitions(_balanced(stored, "event_date", "client_id", "event_time"), path, "event_date", "load_id")
    if before:  # a repeat: its days are calendar days, a short list
        now = {str(row[0]) for row in stored.select("event_date").distinct().collect()}
        for day in before - now:
            drop_partition(spark, f"{path}/event_date={day}", "load_id", load)


def _days_of_load(spark: SparkSession, path: str, load_id: str) -> set[str]:
    """Days on which a load has a folder, from the file system listing alone."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/event_date=*/load_id={load_id}")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return {status.getPath().getParent().getName().split("=", 1)[1] for status in found or ()}


def overwrite_partitions(df: DataFrame, path: str, *partitions: str) -> None:
    """Replace exactly the partitions that occur in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def write_aggregates(df: DataFrame, path: str) -> None:
    stored = _balanced(with_interval_date(df), "interval_date", "client_id", "metric_name", "interval_start")
    overwrite_partitions(stored, path, "interval_date")


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def merge_aggregates(
    spark: SparkSession,
    path: str,
    updates: DataFrame,
    replace: tuple[str, ...] = ("value", "meta_data", "updated_at"),
) -> None:
    """Upsert into the series table, touching only the dates that occur in ``updates``.

    Repeating the call with the same updates leaves the same table.
    """
    with staged(updates, "updates") as new:
        # calendar days of one batch of updates: a short list
        days = [row[0] for row in new.select(F.to_date("interval_start")).distinct().collect()]
        if not days:
            return
        if path_exists(spark, path):
            touched = read_aggregates(spark, path).filter(F.col("interval_date").isin(days)).drop("interval_date")
        else:
            touched = new.limit(0)
        with staged(upsert_aggregates(touched, new, replace), "merged") as merged:
            write_aggregates(merged, path)


def replace_tenant_events(df: DataFrame, current_path: str, new_path: str, tenants: DataFrame | list[str], load_id: str = "reload") -> None:
    """A new version of the event table: the tenants' old rows out, ``df`` in under ``load_id``.

    ``tenants`` is a frame with ``client_id`` or a short list. Kept rows keep their load ids, so an earlier load
    can still be repeated, and the version is written as a whole: a repeat gives the same table.
    """
    spark = df.sparkSession
    if not isinstance(tenants, DataFrame):
        tenants = spark.createDataFrame([(t,) for t in tenants], "client_id string")
    kept = read_stored_events(spark, current_path).join(tenants.select("client_id").distinct(), "client_id", "left_anti")
    fresh = with_event_date(df).withColumn("load_id", F.lit(load_id))
    _write_version(kept.unionByName(fresh.select(*kept.columns)), new_path)


def _write_version(rows: DataFrame, path: str) -> None:
    """A whole version of the event table, in place of whatever an earlier attempt left there."""
    stored = _balanced(rows, "event_date", "client_id", "event_time")
    writer = stored.write.mode("overwrite").option("partitionOverwriteMode", "static")
    writer.partitionBy("event_date", "load_id").parquet(path)


def compact_events(spark: SparkSession, current_path: str, new_path: str, closed_before: Instant) -> None:
    """A new version of the event table in which every day before ``closed_before`` is one load.

    Streams leave a folder for each micro-batch and day; readers of the new version list one for each
    closed day. Loads of closed days must not be repeated afterwards: they have been merged.
    """
    stored = read_stored_events(spark, current_path)
    closed = F.col("event_date") < F.lit(at(closed_before).date())
    merged = F.when(closed, F.concat(F.lit("compact-"), F.col("event_date").cast("string"))).otherwise(F.col("load_id"))
    _write_version(stored.withColumn("load_id", merged), new_path)


def partition_values(spark: SparkSession, path: str, column: str) -> list[str]:
    """Values of a table's partition folders, from the file system listing alone."""
    if not path_exists(spark, path):
        return []
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop_path)
    names = [status.getPath().getName() for status in files if status.isDirectory()]
    return sorted(name.split("=", 1)[1] for name in names if name.startswith(f"{column}="))


def drop_partition(spark: SparkSession, path: str, column: str, value: str) -> None:
    delete_folder(spark, f"{path}/{column}={value}")


def _rewrite_day(spark, path, date_column, load_column, day, rows) -> None:
    """Replace one day by ``rows`` of it; folders that lose all their rows go."""
    with staged(rows, "boundary") as kept:
        overwrite_partitions(kept, path, date_column, *([load_column] if load_column else []))
        if load_column:
            folder = f"{path}/{date_column}={day}"
            left = {row[0] for row in kept.select(load_column).distinct().collect()}
            for load in partition_values(spark, folder, load_column):
                if load not in left:
                    drop_partition(spark, folder, load_column, load)
        elif kept.isEmpty():
            drop_partition(spark, path, date_column, day)


def _prune_table(spark, path, table, time_column, date_column, load_column, as_of, days) -> int:
    cutoff = at(as_of) - timedelta(days=days)
    boundary = cutoff.date().isoformat()
    values = partition_values(spark, path, date_column)
    if boundary in values:
        same_day = table.filter(F.col(date_column) == F.lit(cutoff.date()))
        _rewrite_day(spark, path, date_column, load_column, boundary, same_day.filter(F.col(time_column) >= literal_time(cutoff)))
    expired = [value for value in values if value < boundary]
    for value in expired:
        drop_partition(spark, path, date_column, value)
    return len(expired)


def prune_event_table(spark: SparkSession, path: str, as_of: Instant, days: int = EVENT_RETENTION_DAYS) -> int:
    """Drop expired days unread and rewrite only the day of the cut-off; returns days dropped."""
    table = read_stored_events(spark, path)
    return _prune_table(spark, path, table, "event_time", "event_date", "load_id", as_of, days)


def prune_aggregate_table(
    spark: SparkSession, path: str, as_of: Instant, days: int = AGGREGATE_RETENTION_DAYS
) -> int:
    table = read_aggregates(spark, path)
    return _prune_table(spark, path, table, "interval_start", "interval_date", None, as_of, days)
