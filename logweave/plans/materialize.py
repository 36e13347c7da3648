"""Cutting lineage: a reliable checkpoint in the folder that every executor shares."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, SparkSession] = {}  # those of this process that are to go at its end


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only a session on one machine may go without; it gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="logweave-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """The frame computed once and stored with copies that outlive executors; later reads run none of its plan again."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_folder(spark: SparkSession, kind: str) -> str:
    """A folder of its own in the shared one, removed when the process ends."""
    folder = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _folders[folder] = spark
    return folder


def remove(folder: str) -> None:
    spark = _folders.pop(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _remove_all() -> None:
    for folder in [*_folders]:
        with contextlib.suppress(Exception):  # the JVM may be gone
            remove(folder)


def store(df: DataFrame, compression: str | None = None) -> DataFrame:
    """As ``materialize``, in a compressed table of the shared folder: a few bytes a row where a checkpoint takes dozens."""
    folder = fresh_folder(df.sparkSession, "table")
    df.write.parquet(folder, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    out._folder = folder
    return out


def drop(*tables: DataFrame) -> None:
    """Removes what ``store`` wrote; nothing may read these tables any more."""
    for t in tables:
        remove(t._folder)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files, broadcasts and (with spark.cleaner.referenceTracking.cleanCheckpoints) checkpoints that nothing refers to any more.

    Spark's cleaner acts on references that the driver's garbage collection finds dead, and a driver with little to do collects
    rarely; called after a large step, the step's files go before the next one writes its own.
    """
    gc.collect()
    spark._jvm.System.gc()
