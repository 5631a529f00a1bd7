"""Session defaults and lineage cutting."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str | None = None, app: str = "turnwise", **conf: str) -> SparkSession:
    """A session with the settings the operators rely on (UTC, AQE, skew joins)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoints at the cluster's shared folder.

    ``spark.checkpoint.dir`` names it on a cluster. A temporary folder is used
    only in local mode, where driver and executors share the machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="turnwise-checkpoint-"))
    else:
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, on storage every executor reaches; removed when it exits."""
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if not configured:
        ensure_checkpoint_dir(spark)
        configured = spark.sparkContext.getCheckpointDir()
    folder = f"{configured.rstrip('/')}/turnwise-{spark.sparkContext.applicationId}"
    if folder not in _SCRATCH:
        _SCRATCH.add(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


_SCRATCH: set[str] = set()


#: With it Spark drops a query's shuffle files when the query ends, not when the driver happens to collect garbage.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, **options: str) -> str:
    """Write the rows as Parquet; the folder's path. Nothing reads the query's shuffle files after that, so they go."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        df.write.options(**{"compression": "zstd", **options}).parquet(path)
    finally:
        spark.conf.unset(CLEANUP_CONF) if before is None else spark.conf.set(CLEANUP_CONF, before)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write the rows as Parquet and read them back: later plans read what they need of them instead of recomputing."""
    return df.sparkSession.read.schema(df.schema).parquet(stored(df))


def open_file_system(path: str):
    """The file system of a path or URI for use inside a task, and the path in it."""
    import pyarrow.fs as pafs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024


def checked_broadcast(table: DataFrame, row_bytes: int = 256) -> DataFrame:
    """Broadcast a table only when its counted rows, of about ``row_bytes`` each, are within the limits."""
    return counted_broadcast(table, table.count(), row_bytes)


def counted_broadcast(table: DataFrame, rows: int, row_bytes: int = 256) -> DataFrame:
    """``checked_broadcast`` of a table whose ``rows`` were counted before.

    A larger one is joined by shuffle: Spark judges it by its packed size on disk, and would send it through the driver.
    """
    return F.broadcast(table) if rows <= min(BROADCAST_ROWS, BROADCAST_BYTES // row_bytes) else table.hint("merge")


def lookup_side(df: DataFrame) -> DataFrame:
    """A lookup table for a join: written once, counted, broadcast when small; a larger
    one is joined by shuffle."""
    return checked_broadcast(materialize(df))
