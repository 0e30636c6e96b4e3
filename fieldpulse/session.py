"""Session settings the library relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


_LOCAL: dict[str, str] = {}  # private folders of local sessions


def build_session(app: str = "fieldpulse", master: str | None = None, **extra: str) -> SparkSession:
    """A session with UTC calendar logic and adaptive execution.

    Shuffle width, executor memory and file sizes belong to the cluster and are taken from its own configuration;
    pass them through ``extra`` where none is given.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a private one only in a single local process that names none."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix=f"fieldpulse-{os.getpid()}-")
    return _LOCAL[context.applicationId]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a table of intermediate rows that outlives lost executors."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the files.

    A Parquet table survives lost executors like a checkpoint does, and later steps read only the columns they need
    and know its size when they choose how to join.
    """
    path = scratch(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
