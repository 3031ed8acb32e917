"""Cutting lineage in a folder that every executor can read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def use_shared_folder(spark: SparkSession) -> None:
    """Point checkpoints at ``spark.checkpoint.dir``.

    A session that names no folder gets a temporary one if it runs in one process; on a
    cluster, whose machines do not share that, it is refused.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and go on from a reliable checkpoint of it.

    The files survive lost executors and are removed with the last reference
    when ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    use_shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    For wide tables that are read more than once: columns are pruned on the way back.
    """
    path = f"{scratch(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def scratch(spark: SparkSession) -> str:
    """The path of a new folder in the shared one, deleted when the session's process ends."""
    use_shared_folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(file)
    system.deleteOnExit(file)
    return path
