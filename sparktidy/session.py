"""Session helper and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from sparktidy.errors import TidyError


_local_root: str | None = None


def local_session(cores: str | int = 8, shuffle_partitions: int = 8, app: str = "sparktidy") -> SparkSession:
    """A local session for tests and the bench. On a cluster bring your own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder the cluster names in
    ``spark.checkpoint.dir``. Only a local master may fall back to a
    temporary folder, because there driver and executors share the disk."""
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise TidyError("set spark.checkpoint.dir to a folder every executor can reach")
        _local_root = _local_root or tempfile.mkdtemp(prefix="sparktidy-")
        root = _local_root
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialize(df, purpose: str):
    """Cut the lineage through a written table in the shared folder, which
    outlives any executor."""
    path = work_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
