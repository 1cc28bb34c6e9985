"""Roll-ups that late events change without a new roll-up.

``BucketLog`` keeps, for each tenant and interval, how many events there are of each name and of each user, and how many users there
are, as signed rows that add up: the sum over all segments is the state. A load writes what it changes and nothing else. For its users
that takes a look at the rows of the same users on the days that it reaches; for everything else, at nothing. Reading a roll-up
reads names and user counts, never the rows of single users.
"""

from __future__ import annotations

import uuid
from collections.abc import Collection
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallygrid.functions.times import Instant, floor_time, literal_time
from tallygrid.operators import rollups
from tallygrid.operators.filters import active_keys
from tallygrid.operators.metrics import rank_names
from tallygrid.sources.snapshots import MERGE_AT, SIZE_RATIO, TRIES, Segment, SeriesLog, SnapshotTable, VersionTaken
from tallygrid.sources.storage import staged, with_interval_date

#: kinds of rows: events of a name, events of a user, and users
NAME, USER, USERS = "name", "user", "users"
BUCKET = ["client_id", "interval_start"]
KEY = [*BUCKET, "kind", "member"]


class BucketLog(SnapshotTable):
    """Signed counts per tenant, interval and member. Events without a time belong to no interval, those without a user to no user."""

    def __init__(self, spark: SparkSession, path: str, seconds: int = rollups.HOUR):
        if seconds not in (rollups.MINUTE, rollups.HOUR):
            raise ValueError("roll-ups are by minute or by hour")
        schema = "client_id STRING, interval_start TIMESTAMP, kind STRING, member STRING, n BIGINT, interval_date DATE, load_id STRING"
        super().__init__(spark, path, schema, "interval_date", ("kind", *BUCKET))
        self.seconds = seconds

    def content(self, events: DataFrame) -> DataFrame:
        """What a load of ``events`` amounts to: a row for each interval and name, and for each interval and user."""
        members = F.array(
            F.struct(F.lit(NAME).alias("kind"), F.col("event_name").alias("member")), F.struct(F.lit(USER).alias("kind"), F.col("user_id").alias("member"))
        )
        timed = events.where(F.col("event_time").isNotNull())
        rows = timed.select("client_id", floor_time(F.col("event_time"), self.seconds).alias("interval_start"), F.inline(members))
        return rows.where((F.col("kind") == NAME) | F.col("member").isNotNull()).groupBy(*KEY).agg(F.count("*").alias("n"))

    def apply(self, events: DataFrame, load_id: str) -> int:
        """Make ``events`` the content of the load: a new load adds them, a repeat changes nothing, a repeat with other events
        takes back what went and adds what came, an empty one takes the load back. If another writer was faster, users are looked up anew."""
        with staged(self.content(events), "content") as wanted:
            for _ in range(TRIES):
                base = self.version()
                now = self.segments(base)
                with staged(self._changes(wanted, [s for s in now if s.load_id == load_id]), "changes") as changes:
                    rows = changes.unionByName(self._user_changes(changes.where(F.col("kind") == USER), now))
                    new = self.write(with_interval_date(rows).withColumn("load_id", F.lit(load_id)))
                if not new:
                    return base
                try:
                    return self.commit(base, now + [replace(s, order=base + 1) for s in new])
                except VersionTaken:
                    continue
        raise VersionTaken(f"{self.path}: no free version in {TRIES} tries")

    def _changes(self, wanted: DataFrame, own: list[Segment]) -> DataFrame:
        """What the load has to add to its own rows to come to ``wanted``."""
        if not own:
            return wanted
        held = self.open(own).where(F.col("kind") != USERS).select(*KEY, (-F.col("n")).alias("n"))
        return wanted.unionByName(held).groupBy(*KEY).agg(F.sum("n").alias("n")).where("n <> 0")

    def _user_changes(self, changes: DataFrame, now: list[Segment]) -> DataFrame:
        """Users who come into an interval with ``changes`` (+1), or go out of it (-1), summed by interval."""
        days = {str(row[0]) for row in changes.select(F.to_date("interval_start")).distinct().collect()}  # calendar days of one load
        user = [*BUCKET, "member"]
        held = self.open([s for s in now if s.day in days]).where(F.col("kind") == USER)
        before = held.join(changes.select(*user), user, "left_semi").select(*user, F.col("n").alias("old"), F.lit(0).cast("bigint").alias("new"))
        both = before.unionByName(changes.select(*user, F.lit(0).cast("bigint").alias("old"), F.col("n").alias("new")))
        summed = both.groupBy(*user).agg(F.sum("old").alias("old"), F.sum("new").alias("new"))
        step = (F.col("old") + F.col("new") > 0).cast("bigint") - (F.col("old") > 0).cast("bigint")
        moved = summed.groupBy(*BUCKET).agg(F.sum(step).alias("n")).where("n <> 0")
        return moved.select(*BUCKET, F.lit(USERS).alias("kind"), F.lit(None).cast("string").alias("member"), "n")

    def touched(self, load_id: str) -> DataFrame:
        """The intervals that a load's rows are about, also those of rows that it took back."""
        return self.open([s for s in self.segments() if s.load_id == load_id]).select(*BUCKET).distinct()

    def rollup(self, tick: Instant, registry: DataFrame | None = None, buckets: DataFrame | None = None) -> DataFrame:
        """Series rows as a roll-up of all events would give them, stamped with ``tick``: of the intervals in ``buckets``, with zeros
        for those that have lost their events, or else of all intervals with events; of active tenants if there is a ``registry``."""
        segments = self.segments()
        if buckets is not None:
            days = {str(row[0]) for row in buckets.select(F.to_date("interval_start")).distinct().collect()}
            segments = [s for s in segments if s.day in days]
        rows = self.open(segments).where(F.col("kind") != USER).select(*KEY, "n")
        rows = rows if buckets is None else rows.join(buckets.select(*BUCKET), BUCKET, "left_semi")
        if registry is not None:
            rows = rows.join(active_keys(registry).select(F.col("id").alias("client_id")), "client_id", "left_semi")
        named = rows.where(F.col("kind") == NAME).groupBy(*BUCKET, F.col("member").alias("event_name")).agg(F.sum("n").alias("count")).where("count <> 0")
        counts = named.groupBy(*BUCKET).agg(F.sum("count").alias("count"))
        users = rows.where(F.col("kind") == USERS).groupBy(*BUCKET).agg(F.sum("n").alias("users"))
        grid = counts.select(*BUCKET) if buckets is None else rows.select(*BUCKET).distinct()
        wide = rollups.together(grid, counts, users, rank_names(named, BUCKET, 10))
        return (rollups.hour_rows if self.seconds == rollups.HOUR else rollups.minute_rows)(wide, literal_time(tick))

    def compact(self, merge_at: int = MERGE_AT, size_ratio: int = SIZE_RATIO, spared: Collection[str] = ()) -> int:
        """Add up the runs that are due; what adds up to nothing goes. Loads inside them can be neither repeated nor taken back
        afterwards, so name those in ``spared`` that still may be."""
        runs = self.due(merge_at, size_ratio, spared)
        if not runs:
            return self.version()
        old = [s for run in runs for s in run]
        summed = with_interval_date(self.open(old).groupBy(*KEY).agg(F.sum("n").alias("n")).where("n <> 0"))
        return self._swap(old, self.write(summed.withColumn("load_id", F.lit(f"merged-{uuid.uuid4().hex}"))))


def fold_late(log: BucketLog, series: SeriesLog, events: DataFrame, load_id: str, registry: DataFrame, tick: Instant) -> None:
    """A load of late events into the log, and the intervals that it touches into the series. May be run again after a failure
    at any point. One job at a time folds into one series: the delta that comes last has to hold the newest state."""
    log.apply(events, load_id)
    series.merge(log.rollup(tick, registry, log.touched(load_id)))
