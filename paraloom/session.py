"""Session helpers shared by all operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; a Spark-written directory and a single file read alike."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's checkpoint folder and return it with its lineage cut.

    The folder is the one ``spark.checkpoint.dir`` names.  Only where that is unset, in local
    mode, a temporary folder is used.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, set from ``spark.checkpoint.dir`` if it has none; on a cluster that must be set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not (sc.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="paraloom-checkpoint-"))
    return sc.getCheckpointDir()


def task_count(spark: SparkSession, rows: int, per_task: int) -> int:
    """Partitions for ``rows`` at ``per_task`` rows each, at least one per core."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // per_task))
