"""Parquet tables of a test or production folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` under ``folder``; only columns that are used are read."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def state(spark: SparkSession, sf_dir: str) -> int:
    """A number that changes with the names, sizes or times of the files below ``sf_dir``."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hash(tuple(sorted(found)))
