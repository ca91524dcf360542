"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job wants.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}
# A local master has few cores and one heap. A cluster starts wide, since AQE joins small partitions
# but splits only those of joins; its memory settings are its own.
LOCAL = {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"}
WIDE = {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": "4000"}


def build_session(master: str = "local[8]", app: str = "tarnscope", **extra) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    settings = {
        **DEFAULTS,
        **(LOCAL if master.startswith("local") else WIDE),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{k.replace("__", "."): v for k, v in extra.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings results depend on to a session someone else built."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a machine-local
    path would be invisible to the other executors.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, never reused by another run."""
    return os.path.join(shared_folder(spark), f"tarnscope-{name}-{uuid.uuid4().hex}")


def clear_scratch(spark: SparkSession) -> int:
    """Delete what ``scratch_path`` named below the shared folder and return how many paths. For the end
    of a job: results that were not written elsewhere are lost."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    pattern = hadoop.Path(os.path.join(shared_folder(spark), "tarnscope-*"))
    store = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    return sum(store.delete(found.getPath(), True) for found in store.globStatus(pattern) or [])


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss, unlike a local one."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
