"""Writing findings."""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusward.operators.report import diagnostic_json, run_envelope, run_json


def write_findings(found: DataFrame, path: str, fmt: str = "parquet", mode: str = "error") -> None:
    """Findings as files, a folder for each specification; JSON keeps absent optionals as nulls."""
    writer = found.write.mode(mode).partitionBy("spec_id")
    if fmt == "json":
        writer = writer.option("ignoreNullFields", "false")
    writer.format(fmt).save(path)


def findings_json(found: DataFrame) -> DataFrame:
    """Each finding as one JSON text, nulls kept."""
    return found.select("doc_id", "seq", F.to_json(F.struct(*found.columns), {"ignoreNullFields": "false"}).alias("json"))


def write_run(docs: DataFrame, found: DataFrame, path: str, policy: str = "never", mode: str = "error", **run) -> None:
    """A whole run as folders of JSON lines under ``path``: ``run`` (one line), ``documents`` and ``diagnostics``."""
    run_json(docs, found, policy, **run).write.mode(mode).text(f"{path}/run")
    run_envelope(docs, found, policy).select("json").write.mode(mode).text(f"{path}/documents")
    diagnostic_json(found).select("json").write.mode(mode).text(f"{path}/diagnostics")


#: What a published run holds.
PARTS = ("run", "documents", "diagnostics")


def publish_run(docs: DataFrame, found: DataFrame, path: str, policy: str = "never", run: str | None = None, **about) -> str:
    """A whole run below ``path``, or nothing that readers see; returns the run's id.

    The three tables of ``write_run`` go to a folder of the run's own.  Last a mark is
    written, as one small file, which makes the run visible to ``read_runs``; a job that ends
    before leaves a folder without a mark.  An id may be used once.
    """
    run = run or uuid.uuid4().hex
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", run):
        raise ValueError(f"no id of a run: {run}")
    write_run(docs, found, f"{path}/runs/{run}", policy, **about)
    docs.sparkSession.createDataFrame([(run,)], "value string").coalesce(1).write.text(f"{path}/published/{run}")
    return run


def published_runs(spark: SparkSession, path: str) -> list[str]:
    """The ids of all published runs, in order: a line for each run."""
    try:
        return sorted(r[0] for r in spark.read.text(f"{path}/published/*").collect())
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return []
        raise


def read_runs(spark: SparkSession, path: str, part: str) -> DataFrame:
    """run and json: the lines of one of PARTS of all published runs."""
    if part not in PARTS:
        raise ValueError(f"a run has {PARTS}")
    folders = [f"{path}/runs/{run}/{part}" for run in published_runs(spark, path)]
    if not folders:
        return spark.createDataFrame([], "run string, json string")
    return spark.read.text(folders).select(F.regexp_extract(F.col("_metadata.file_path"), r"/runs/([^/]+)/", 1).alias("run"), F.col("value").alias("json"))
