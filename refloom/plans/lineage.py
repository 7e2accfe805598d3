"""Cutting lineage through reliable checkpoints in the cluster's shared folder."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by ``spark.checkpoint.dir``; set a local one only where none is set.

    The fallback is for single-machine sessions (tests, notebooks) and goes when Python ends: on a cluster the setting is
    expected, since a machine-local folder would not survive the loss of that machine.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = sc.getConf().get("spark.checkpoint.dir")
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        folder = tempfile.mkdtemp(prefix="refloom-ckpt-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared folder and continue from there.

    Reliable (replicated by the file system), so a lost executor costs a re-read, not a recompute.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let go of shuffle files and checkpoints that nothing refers to any more: the driver's garbage collection frees them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
