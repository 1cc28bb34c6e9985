"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

SESSION_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # per-tenant top-n is cut inside every map task before the shuffle up to this n
    "spark.sql.optimizer.windowGroupLimitThreshold": "20000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # sessions of a busy user are joined inside the tasks before they are shuffled
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
}

_local_fallback: dict[str, str] = {}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings the operators are written for."""
    for key, value in SESSION_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(master: str = "local[8]", app_name: str = "tallygrid", **extra: str) -> SparkSession:
    """A session for local work; on a cluster use the session the cluster provides."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in {**SESSION_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, as named by ``spark.checkpoint.dir`` or by the context's ``setCheckpointDir``.

    A path without a scheme may be a mounted share, which looks like a folder of one machine from here: it is taken as named.
    Only a local session may fall back to a temporary folder of its own, made once.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _local_fallback:
        _local_fallback[context.applicationId] = tempfile.mkdtemp(prefix="tallygrid-")
    return _local_fallback[context.applicationId]


def new_run_dir(spark: SparkSession, label: str) -> str:
    """A fresh, unused path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
