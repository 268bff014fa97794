"""The folder that all executors share, and cutting of lineage there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; in local mode, where it is unset, a temporary folder that becomes the setting.

    On a cluster an unset folder is an error: a folder of one machine would lose
    data with that machine.
    """
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"{SETTING} must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lorewell-")
        spark.conf.set(SETTING, found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


_MADE: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which ``release`` deletes."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete what this process wrote at paths of ``shared_path``; for callers who are done with all results that were made from it.

    Checkpoints are Spark's own: it deletes them with their DataFrames where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _MADE:
        where = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        where.getFileSystem(conf).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
