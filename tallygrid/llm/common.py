"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallygrid.session import configure, new_run_dir
from tallygrid.sources.storage import delete_folder

# fixed value: what counts as a word in every operator that reads words
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_PATTERN)

LLM_SETTINGS = {
    # rows that a Python worker holds at once; long texts make rows large
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, as ``--py-files`` would."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="package-"), "tallygrid.zip")
    with zipfile.ZipFile(archive, "w") as file:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    file.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def prepare(spark: SparkSession) -> SparkSession:
    """The library's settings, its code on the workers, and small Arrow batches for rows that hold whole texts."""
    configure(spark)
    ship_package(spark)
    for key, value in LLM_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: later steps survive lost executors
    and never see the rows change between two uses."""
    path = new_run_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that one run of an operator writes to the shared folder; ``drop`` removes those that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: list[tuple[DataFrame, str]] = []

    def write(self, df: DataFrame, label: str) -> DataFrame:
        """``df`` written once and read back, as ``staged`` does."""
        path = new_run_dir(self.spark, label)
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self._paths.append((table, path))
        return table

    def drop(self, table: DataFrame) -> None:
        for place, (held, path) in enumerate(self._paths):
            if held is table:
                delete_folder(self.spark, path)
                del self._paths[place]
                return
        raise ValueError("not a table of this run, or dropped before")

    def keep(self, *tables: DataFrame) -> None:
        """Remove all tables but these."""
        for table, _ in list(self._paths):
            if not any(table is kept for kept in tables):
                self.drop(table)


def by_batch(function: Callable[[dict[str, list]], dict[str, list]], schema: pa.Schema) -> Callable:
    """A ``mapInArrow`` function from one that maps a dict of columns to a dict of columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = function(batch.to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in schema], schema=schema)

    return run


def fold(id_col: str, folds: int) -> Column:
    """CRC-32 of the id as text, modulo ``folds``; a null id is in no fold."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


#: bits of the filter below, whatever the number of ids: 256 rows of 4 kB are sent to the tasks
FILTER_BITS = 1 << 23
_BITMAP = 32_768  # positions in one value of bitmap_construct_agg


def split_by_filter(rows: DataFrame, ids: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose id may be among ``ids``, rows whose id surely is not), by a bitmap of hashed ids.

    Rows of the second kind need no join and so no shuffle. The bitmap has a fixed size: with very many ids
    it fills up and more rows are of the first kind, which an exact join must follow anyway.
    """
    columns = rows.columns
    place = lambda column: F.pmod(F.xxhash64(column.cast("long")), F.lit(FILTER_BITS))
    placed = ids.select(place(F.col(ids.columns[0])).alias("_at"))
    bitmap = placed.groupBy(F.floor(F.col("_at") / _BITMAP).alias("_part")).agg(F.bitmap_construct_agg(F.col("_at") % _BITMAP).alias("_bits"))
    marked = rows.withColumn("_at", place(F.col(id_col))).withColumn("_part", F.floor(F.col("_at") / _BITMAP))
    marked = marked.join(F.broadcast(bitmap), "_part", "left").withColumn("_at", (F.col("_at") % _BITMAP).cast("int"))
    byte = F.conv(F.hex(F.expr("substring(_bits, _at div 8 + 1, 1)")), 16, 10).cast("int")
    marked = marked.withColumn("_held", F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), F.col("_at") % 8).cast("int")) != 0, F.lit(False)))
    back = [F.col(f"`{c}`") for c in columns]
    return marked.where("_held").select(*back), marked.where("NOT _held").select(*back)


def top_ids(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query number its k best ids, each id by its best score."""
    order = np.lexsort((-scores, ids, query))
    query, ids, scores = query[order], ids[order], scores[order]
    first = np.ones(len(ids), dtype=bool)
    first[1:] = (query[1:] != query[:-1]) | (ids[1:] != ids[:-1])
    query, ids, scores = query[first], ids[first], scores[first]
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    begin = np.searchsorted(query, query, side="left")
    held = np.arange(len(query)) - begin < k
    return query[held], ids[held], scores[held]
