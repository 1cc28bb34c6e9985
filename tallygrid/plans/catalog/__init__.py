"""Registered queries over the test tables, each with the SQL that checks it."""

from tallygrid.plans.catalog.common import QUERIES, SQL
from tallygrid.plans.catalog import alerts, buckets, live, metrics, series, snapshots, streams, summaries, temporal  # noqa: F401  (registration)

__all__ = ["QUERIES", "SQL"]
