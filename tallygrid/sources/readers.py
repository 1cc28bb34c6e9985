"""Readers with fixed schemas, batch or stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallygrid.schemas import AGGREGATES, ALERT_HISTORY, EVENTS_STORED, QUEUED_EVENT, REGISTRY, RULES


def _reader(spark: SparkSession, streaming: bool, max_files: int | None = None):
    if not streaming:
        return spark.read
    reader = spark.readStream
    return reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)


def read_lines(spark: SparkSession, path: str, streaming: bool = False, max_files: int | None = None) -> DataFrame:
    """Raw envelopes, one JSON text per line, as ``value``."""
    return _reader(spark, streaming, max_files).text(path)


def read_events(spark: SparkSession, path: str, streaming: bool = False, max_files: int | None = None) -> DataFrame:
    """Queued JSON events. Unreadable text is kept in ``corrupt`` and does not stop the rest."""
    return (
        _reader(spark, streaming, max_files)
        .schema(f"{QUEUED_EVENT}, corrupt STRING")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "corrupt")
        .json(path)
    )


def read_stored_events(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """The event table: parquet partitioned by ``event_date``."""
    return _reader(spark, streaming).schema(EVENTS_STORED).parquet(path)


def read_aggregates(spark: SparkSession, path: str) -> DataFrame:
    """The series table: parquet partitioned by ``interval_date``."""
    return spark.read.schema(f"{AGGREGATES}, interval_date DATE").parquet(path)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RULES).parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ALERT_HISTORY).parquet(path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REGISTRY).parquet(path)
