"""Spark session and shared-storage helpers."""
from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def get_spark(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "tillpoint") -> SparkSession:
    """Local session used by tests, bench and the CLI helpers.

    On a cluster the session comes from spark-submit; only the SQL knobs set
    here matter there (AQE, skew join, UTC, ANSI).
    """
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("TILLPOINT_DRIVER_MEM", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> None:
    """Session-level settings every job relies on (idempotent)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")


@contextmanager
def short_methods(spark: SparkSession) -> Iterator[None]:
    """For writes of wide rows made of many expressions: generated methods beyond 8000 bytes, which the JVM never compiles, are split."""
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "8000")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names for checkpoints.

    Read from the session (``spark.checkpoint.dir`` or the SparkContext
    checkpoint dir). Where neither is set, a local session (tests) gets a fresh
    folder; on a cluster that is an error, since executors share no local disk.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if not d:
        d = spark.conf.get("spark.checkpoint.dir", None)
        if not d:
            if not re.match(r"local(\[|$)", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        sc.setCheckpointDir(d)
        d = sc.getCheckpointDir() or d
    return d


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once a context (for operators that need Python)."""
    sc = spark.sparkContext
    if getattr(sc, "_tillpoint_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="ship-"), "tillpoint.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._tillpoint_shipped = True


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique path under the shared folder for a materialised table."""
    base = shared_dir(spark).rstrip("/")
    return f"{base}/tillpoint-{name}-{uuid.uuid4().hex[:12]}"
