"""Where jobs cut their lineage, and the local session that tests and the bench use."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where that is unset, a temporary one in a local session.

    A cluster's executors and driver share no local folder, so there the setting is needed.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not root:
        current = context.getCheckpointDir()
        if not current:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
            context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='auralake-')}")
            current = context.getCheckpointDir()
        return current
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below :func:`shared_dir`, never used before."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def local_session(cpus: int | None = None, app: str = "auralake") -> SparkSession:
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
