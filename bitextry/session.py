"""Session helpers: scratch storage, balanced scans and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A table of at most this many short rows (ids, offsets, paths) may be broadcast.
BROADCAST_ROW_LIMIT = 200_000
_LOCAL_DIRS: dict[str, str] = {}


def build_session(app: str = "bitextry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job here relies on; cluster settings stay with the cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or one set on the context, or a temporary one in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_DIRS:
        _LOCAL_DIRS[application] = tempfile.mkdtemp(prefix="bitextry-")
    return _LOCAL_DIRS[application]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/bitextry/{label}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame, compression: str | None = None) -> DataFrame:
    """``df`` as a table written to the shared folder, which cuts its lineage.

    The table survives the loss of executors, freezes non-deterministic columns such as row ids, and is
    columnar, so later steps read only the columns they use.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition a scan by unique ``keys`` when it has fewer tasks than the cluster has cores.

    A large corpus already comes in more splits than there are cores and stays as it is. A small one
    may sit in a single row group, which would leave every later kernel to one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Hint a broadcast only when the known row count is within ``limit``; else leave the join to Spark."""
    return F.broadcast(df) if rows <= limit else df
