"""Session set-up and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import uuid

import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession

# Runtime settings every plan in this package relies on.  All of them are SQL
# settings, so they can be applied to a session somebody else created.
PLAN_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot join key is worth one extra exchange further down the plan.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the plan settings to an existing session."""
    for key, value in PLAN_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(
    cpus: int | str = "*", partitions: int = 8, memory: str = "20g", stages: str | None = None
) -> SparkSession:
    """A single-machine session for tests and benchmarks; ``stages`` is the folder of intermediate tables."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("paddock")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    if stages:
        builder = builder.config("spark.checkpoint.dir", stages)
    spark = tune(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, else one in the warehouse, which all share too."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    named = named or context.getCheckpointDir() or f"{spark.conf.get('spark.sql.warehouse.dir')}/_stages"
    return named.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path inside the shared folder; what is there goes with ``drop_stages``."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def drop_stages() -> None:
    """Delete all intermediate tables of this process; frames that read them end with it.

    Called at the end of the process, or by its owner between independent jobs.
    """
    while _written:
        path = _written.pop()
        try:
            system, place = FileSystem.from_uri(path) if ":" in path else (LocalFileSystem(), path)
            system.delete_dir(place)
        except (OSError, pa.ArrowException):  # never written, or a store that only Spark reaches
            continue


atexit.register(drop_stages)


def cut_lineage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write a frame that several branches read to the shared folder, and read it back.

    Unlike a cached frame the table survives lost executors; unlike a
    checkpointed one it is columnar, so branches read only their columns, and
    its real size is known to the planner when it picks join strategies.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
