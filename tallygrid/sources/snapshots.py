"""Versioned tables: files that never change, and a log that says which of them make up each version.

Below ``path`` a table has

* ``data/write=<id>/<date column>=<day>/load_id=<load>/``: a segment, written once by one job and never changed;
* ``log/<version>.json``: the segments of a version, one line each. A version comes into being by the rename of a finished
  file to its number, which fails if the number is taken, so readers see whole versions only and of two writers one repeats;
* ``gone/<id>/``: tenants that a reload took out of the segments named with it.

A job that dies before its rename leaves files that no version names: nothing to repair, ``vacuum`` removes them.
The log is read and written by the driver and holds a line a segment, not a file: days times loads, which ``compact`` keeps near
one a day. Readers of a range of days open the segments of these days alone.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Collection
from dataclasses import asdict, dataclass, replace
from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallygrid.fixed_values import AGGREGATE_RETENTION_DAYS, EVENT_RETENTION_DAYS
from tallygrid.functions.times import Instant, at, literal_time
from tallygrid.operators.series import SERIES_KEY, fold_updates
from tallygrid.schemas import AGGREGATES, EVENTS_STORED
from tallygrid.sources.storage import with_event_date, with_interval_date


class VersionTaken(RuntimeError):
    """Another writer made the next version first."""


class SegmentsChanged(RuntimeError):
    """Segments that were to be replaced are not in the newest version any more."""


@dataclass(frozen=True)
class Segment:
    """``order`` is the version that brought the rows, ``gone`` the reloads that took tenants out since."""

    folder: str
    day: str
    load_id: str
    size: int
    order: int = 0
    gone: tuple[str, ...] = ()


Change = Callable[[list[Segment]], list[Segment]]
TRIES = 20
#: segments of a day that are merged at the earliest, and how much larger than all newer ones together an older one may be to join
MERGE_AT, SIZE_RATIO = 4, 2


class SnapshotTable:
    """A table of immutable segments with numbered versions; version 0 is the empty table."""

    def __init__(self, spark: SparkSession, path: str, schema: str, date_column: str, sort: tuple[str, ...]):
        self.spark, self.path, self.schema, self.date_column, self.sort = spark, path.rstrip("/"), schema, date_column, sort

    # --- the log

    def _files(self, folder: str):
        hadoop_path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return hadoop_path, hadoop_path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of the newest version."""
        folder, files = self._files(f"{self.path}/log")
        if not files.exists(folder):
            return 0
        names = [status.getPath().getName() for status in files.listStatus(folder)]
        return max((int(name.removesuffix(".json")) for name in names if name.endswith(".json") and not name.startswith((".", "_"))), default=0)

    def segments(self, version: int | None = None) -> list[Segment]:
        """The segments of a version, by default of the newest."""
        number = self.version() if version is None else version
        if number == 0:
            return []
        file, files = self._files(f"{self.path}/log/{number:020d}.json")
        stream = files.open(file)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Segment(**{**line, "gone": tuple(line["gone"])}) for line in map(json.loads, text.splitlines())]

    def commit(self, base: int, segments: list[Segment]) -> int:
        """Make ``segments`` the version after ``base``."""
        target, files = self._files(f"{self.path}/log/{base + 1:020d}.json")
        draft, _ = self._files(f"{self.path}/log/_{uuid.uuid4().hex}.tmp")
        stream = files.create(draft, False)
        try:
            stream.write(bytearray("".join(json.dumps(asdict(s)) + "\n" for s in segments).encode()))
        finally:
            stream.close()
        jvm = self.spark._jvm
        plain = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        plain[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(context.makeQualified(draft), context.makeQualified(target), plain)
        except Exception as error:
            files.delete(draft, False)
            if files.exists(target):
                raise VersionTaken(f"version {base + 1} of {self.path} is there already") from error
            raise
        return base + 1

    def change(self, make: Change) -> int:
        """Commit what ``make`` makes of the newest version, anew if another writer was faster; no new version if nothing changes."""
        for _ in range(TRIES):
            base = self.version()
            now = self.segments(base)
            then = make(now)
            if then == now:
                return base
            try:
                return self.commit(base, [s if s.order else replace(s, order=base + 1) for s in then])
            except VersionTaken:
                continue
        raise VersionTaken(f"{self.path}: no free version in {TRIES} tries")

    # --- data

    def write(self, rows: DataFrame) -> list[Segment]:
        """Rows (with the date column and ``load_id``) as new segments, which no version names yet."""
        number = uuid.uuid4().hex
        root = f"{self.path}/data/write={number}"
        evenly = rows.hint("rebalance", self.date_column).sortWithinPartitions(self.date_column, *self.sort)
        evenly.write.partitionBy(self.date_column, "load_id").parquet(root)
        pattern, files = self._files(f"{root}/{self.date_column}=*/load_id=*")
        made = []
        for status in files.globStatus(pattern) or ():
            place = status.getPath()
            day, load = place.getParent().getName(), place.getName()
            size = files.getContentSummary(place).getLength()
            unescape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
            made.append(Segment(f"write={number}/{day}/{load}", day.split("=", 1)[1], unescape(load.split("=", 1)[1]), size))
        return sorted(made, key=lambda s: s.folder)

    def open(self, segments: list[Segment], keep_write: bool = False) -> DataFrame:
        """The rows of some segments as they were written."""
        reader = self.spark.read.schema(f"{self.schema}, write STRING").option("basePath", f"{self.path}/data")
        if segments:
            rows = reader.parquet(*[f"{self.path}/data/{s.folder}" for s in segments])
        else:
            rows = self.spark.createDataFrame([], f"{self.schema}, write STRING")
        return rows if keep_write else rows.drop("write")

    def chosen(self, segments: list[Segment], start: Instant | None, end: Instant | None) -> list[Segment]:
        """Segments of the days from ``start`` to ``end`` (both inside), by the log alone."""
        first = "" if start is None else at(start).date().isoformat()
        last = "~" if end is None else at(end).date().isoformat()
        return [s for s in segments if first <= s.day <= last]

    def vacuum(self, keep_versions: int, untouched_since: Instant) -> int:
        """Remove segments that none of the last ``keep_versions`` versions names and that were last written before
        ``untouched_since`` (a time before the start of any running writer), and the older versions; returns segments removed."""
        newest = self.version()
        oldest = max(1, newest - keep_versions + 1)
        named = {s.folder for number in range(oldest, newest + 1) for s in self.segments(number)}
        taken = {id_ for number in range(oldest, newest + 1) for s in self.segments(number) for id_ in s.gone}
        limit = at(untouched_since).timestamp() * 1000
        removed = 0
        pattern, files = self._files(f"{self.path}/data/write=*/{self.date_column}=*/load_id=*")
        for status in files.globStatus(pattern) or ():
            place = status.getPath()
            name = "/".join([place.getParent().getParent().getName(), place.getParent().getName(), place.getName()])
            if name not in named and status.getModificationTime() < limit:
                files.delete(place, True)
                removed += 1
        pattern, files = self._files(f"{self.path}/gone/*")
        for status in files.globStatus(pattern) or ():
            if status.getPath().getName() not in taken and status.getModificationTime() < limit:
                files.delete(status.getPath(), True)
        for number in range(oldest - 1, 0, -1):
            file, files = self._files(f"{self.path}/log/{number:020d}.json")
            if not files.delete(file, False):
                break
        return removed

    def due(self, merge_at: int, size_ratio: int, spared: Collection[str] = ()) -> list[list[Segment]]:
        """Runs of newest segments to merge, one for each day that has ``merge_at`` or more besides those of ``spared`` loads: from the
        newest on, those at most ``size_ratio`` times as large as all newer ones together."""
        by_day: dict[str, list[Segment]] = {}
        for segment in self.segments():
            if segment.load_id not in spared:
                by_day.setdefault(segment.day, []).append(segment)
        runs = []
        for own in by_day.values():
            if len(own) >= merge_at:
                own.sort(key=lambda s: -s.order)
                run = own[:2]
                for segment in own[2:]:
                    if segment.size > size_ratio * sum(s.size for s in run):
                        break
                    run.append(segment)
                runs.append(run)
        return runs

    def _swap(self, old: list[Segment], new: list[Segment]) -> int:
        """Replace segments by others, unless a writer changed them meanwhile."""
        out = set(old)

        def make(now: list[Segment]) -> list[Segment]:
            if not out <= set(now):
                raise SegmentsChanged(f"{self.path}: {len(out - set(now))} segments changed, run again")
            return [s for s in now if s not in out] + new

        return self.change(make)

    def _drop_before(self, time_column: str, as_of: Instant, days: int, rows_of: Callable[[list[Segment]], DataFrame]) -> int:
        """Drop the segments of expired days unread and rewrite those of the day of the cut-off."""
        cutoff = at(as_of) - timedelta(days=days)
        day = cutoff.date().isoformat()
        now = self.segments()
        expired, boundary = [s for s in now if s.day < day], [s for s in now if s.day == day]
        kept = self.write(rows_of(boundary).where(F.col(time_column) >= literal_time(cutoff))) if boundary else []
        order = max((s.order for s in boundary), default=0)
        return self._swap(expired + boundary, [replace(s, order=order) for s in kept])


class EventLog(SnapshotTable):
    """The event table with versions. A load may be repeated, a tenant reloaded without a rewrite, closed days compacted."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, EVENTS_STORED, "event_date", ("client_id", "event_time"))

    def append(self, events: DataFrame, load_id: str) -> int:
        """Add a load. A repeat under the same id replaces all of it, also with fewer days or empty."""
        new = self.write(with_event_date(events).withColumn("load_id", F.lit(load_id)))
        return self.change(lambda now: [s for s in now if s.load_id != load_id] + new)

    def reload_tenants(self, events: DataFrame, tenants: DataFrame | list[str], load_id: str) -> int:
        """The tenants' rows out, ``events`` in as a load. Writes the new rows and the names of the tenants; no other
        file is read or written. A repeat gives the same table."""
        if not isinstance(tenants, DataFrame):
            tenants = self.spark.createDataFrame([(t,) for t in tenants], "client_id string")
        number = uuid.uuid4().hex
        tenants.select("client_id").where("client_id IS NOT NULL").distinct().write.parquet(f"{self.path}/gone/{number}")
        new = self.write(with_event_date(events).withColumn("load_id", F.lit(load_id)))
        return self.change(lambda now: [replace(s, gone=(*s.gone, number)) for s in now if s.load_id != load_id] + new)

    def rows(self, segments: list[Segment]) -> DataFrame:
        """The events of some segments, without tenants that a later reload took out of them."""
        by_reloads: dict[tuple[str, ...], list[Segment]] = {}
        for segment in segments:
            by_reloads.setdefault(segment.gone, []).append(segment)
        parts = []
        for gone, own in by_reloads.items():
            part = self.open(own)
            if gone:
                names = self.spark.read.schema("client_id STRING").parquet(*[f"{self.path}/gone/{number}" for number in gone])
                part = part.join(names.distinct(), "client_id", "left_anti").select(*part.columns)
            parts.append(part)
        return reduce(DataFrame.unionByName, parts) if parts else self.open([])

    def read(self, version: int | None = None, start: Instant | None = None, end: Instant | None = None) -> DataFrame:
        """The events of a version, by default the newest, from the segments of the days between ``start`` and ``end``."""
        return self.rows(self.chosen(self.segments(version), start, end))

    def compact(self, closed_before: Instant) -> int:
        """One load, ``compact-<day>``, for every day before ``closed_before`` that has several or that a reload touched.
        All other segments stay as they are. Loads of closed days must not be repeated afterwards."""
        limit = at(closed_before).date().isoformat()
        by_day: dict[str, list[Segment]] = {}
        for segment in self.segments():
            by_day.setdefault(segment.day, []).append(segment)
        due = [s for day, own in by_day.items() if day < limit and (len(own) > 1 or own[0].gone) for s in own]
        if not due:
            return self.version()
        merged = self.rows(due).withColumn("load_id", F.concat(F.lit("compact-"), F.col("event_date").cast("string")))
        return self._swap(due, self.write(merged))

    def prune(self, as_of: Instant, days: int = EVENT_RETENTION_DAYS) -> int:
        """Without events before the cut-off; expired days go by the log alone."""
        return self._drop_before("event_time", as_of, days, self.rows)


#: what an update may replace on an existing row; the rest it only sets on a new one
REPLACEABLE = ("value", "meta_data", "updated_at")
_BITS = {name: 1 << place for place, name in enumerate(REPLACEABLE)}


class SeriesLog(SnapshotTable):
    """The series table as sorted deltas: a merge writes its own rows only, readers take the newest value of each key.

    A row says in ``replaces`` which columns it sets on an existing row. Deltas fold in any grouping of neighbours to the same rows, so
    ``compact`` may merge the small newest ones of a day and leave its large ones alone. Equal stamps need no rule between deltas:
    their order is that of their versions; inside one, ``fold_updates`` decides."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, f"{AGGREGATES}, replaces INT, interval_date DATE, load_id STRING", "interval_date", ("client_id", "metric_name", "interval_start"))

    def merge(self, updates: DataFrame, load_id: str | None = None, replace_columns: tuple[str, ...] = REPLACEABLE) -> int:
        """Upsert ``updates`` on (tenant, metric, interval start). A repeat under the same load id replaces the delta in its place."""
        load = load_id or uuid.uuid4().hex
        bits = sum(_BITS[name] for name in replace_columns)
        folded = with_interval_date(fold_updates(updates)).withColumns({"replaces": F.lit(bits), "load_id": F.lit(load)})
        new = self.write(folded)

        def make(now: list[Segment]) -> list[Segment]:
            order = max((s.order for s in now if s.load_id == load), default=0)
            return [s for s in now if s.load_id != load] + [replace(s, order=order) for s in new]

        return self.change(make)

    def folded(self, segments: list[Segment]) -> DataFrame:
        """One row a key: created by its oldest delta, each column by the newest delta that replaces it. Days of one segment need no merge."""
        days: dict[str, int] = {}
        for segment in segments:
            days[segment.day] = days.get(segment.day, 0) + 1
        alone, several = [s for s in segments if days[s.day] == 1], [s for s in segments if days[s.day] > 1]
        rows = self.open(alone).drop("load_id")
        if not several:
            return rows
        placed = [(s.folder.split("/", 1)[0].split("=", 1)[1], s.day, s.order) for s in several]
        orders = self.spark.createDataFrame(placed, "_write string, _day string, _order long")  # a row a segment
        here = (F.col("write") == F.col("_write")) & (F.col("interval_date").cast("string") == F.col("_day"))
        ordered = self.open(several, keep_write=True).join(F.broadcast(orders), here)
        first = F.min(F.struct("_order", "interval_end", "created_at", *REPLACEABLE, "replaces")).alias("first")
        last = [F.max(F.when(F.col("replaces").bitwiseAND(bit) != 0, F.struct("_order", name))).alias(f"last_{name}") for name, bit in _BITS.items()]
        merged = ordered.groupBy(*SERIES_KEY, "interval_date").agg(first, *last, F.bit_or("replaces").alias("replaces"))
        values = [F.when(F.col(f"last_{name}").isNotNull(), F.col(f"last_{name}")[name]).otherwise(F.col("first")[name]).alias(name) for name in REPLACEABLE]
        merged = merged.select(*SERIES_KEY, "first.interval_end", "first.created_at", *values, "replaces", "interval_date")
        return rows.unionByName(merged)

    def read(self, version: int | None = None, start: Instant | None = None, end: Instant | None = None) -> DataFrame:
        """The series of a version, in the columns of the plain table."""
        rows = self.folded(self.chosen(self.segments(version), start, end))
        return rows.select(*[part.split()[0] for part in AGGREGATES.split(", ")], "interval_date")

    def compact(self, merge_at: int = MERGE_AT, size_ratio: int = SIZE_RATIO) -> int:
        """Merge the runs that are due. Loads inside them cannot be repeated in place any more: a repeat counts as newer."""
        runs = self.due(merge_at, size_ratio)
        if not runs:
            return self.version()
        old = [s for run in runs for s in run]
        order = {run[0].day: max(s.order for s in run) for run in runs}
        rows = self.folded(old).withColumns({"load_id": F.lit(f"merged-{uuid.uuid4().hex}")})
        return self._swap(old, [replace(s, order=order[s.day]) for s in self.write(rows)])

    def prune(self, as_of: Instant, days: int = AGGREGATE_RETENTION_DAYS) -> int:
        """Without points before the cut-off; expired days go by the log alone."""

        def rows_of(segments: list[Segment]) -> DataFrame:
            return self.folded(segments).withColumns({"load_id": F.lit(f"merged-{uuid.uuid4().hex}")})

        return self._drop_before("interval_start", as_of, days, rows_of)

