"""Threads: what a session runs at once. The shared folder: where lineage is cut."""

from __future__ import annotations

import tempfile

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

_PARTITIONS = "spark.sql.shuffle.partitions"


def get_threads(spark: SparkSession) -> int:
    """Tasks that shuffles are dealt to."""
    return int(spark.conf.get(_PARTITIONS))


def set_threads(spark: SparkSession, n: int) -> int:
    """Set it, 0 for all cores of the session; gives what was set before."""
    if n < 0:
        raise ValueError("number of threads must not be negative")
    before = get_threads(spark)
    spark.conf.set(_PARTITIONS, str(n or spark.sparkContext.defaultParallelism))
    return before


def current_task() -> int:
    """The partition that a task works on; 0 on the driver."""
    context = TaskContext.get()
    return context.partitionId() if context else 0


def is_parallel(spark: SparkSession) -> bool:
    return spark.sparkContext.defaultParallelism > 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one named in ``spark.checkpoint.dir``.

    Only where that is unset, and all runs on one machine, a temporary folder
    takes its place; on a cluster that is an error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tabloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def fixed(df: DataFrame) -> DataFrame:
    """The same rows in the same partitions, whatever becomes of executors: a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
