"""Cutting lineage through storage that every executor can reach."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder and runs on one machine, as in local tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the session's own setting. On a cluster without one this is an error, as executors share no local folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or LOCAL_CHECKPOINTS)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder now and continue from the files.

    Replicated storage rather than executor disks, so a lost executor costs a
    reread and no recomputation of what stands before.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def ready(spark: SparkSession) -> None:
    """Let Python workers find this package wherever the driver was started; clusters ship it their own way."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).parents[2]))
