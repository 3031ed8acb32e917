"""Severities: an ordered scale kept as a name and a rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values, least severe first.
SEVERITIES = ("info", "warning", "error")


def rank_of(severity: Column) -> Column:
    """0, 1 or 2; null for anything else."""
    return F.when(severity == "info", 0).when(severity == "warning", 1).when(severity == "error", 2)


def name_of(rank: Column) -> Column:
    return F.when(rank == 0, "info").when(rank == 1, "warning").when(rank == 2, "error")


def _as_column(value, kind: str) -> Column:
    return value.cast(kind) if isinstance(value, Column) else F.lit(value).cast(kind)


def findings(rows: DataFrame, *, spec_id, severity: str, code, message, pointer=None, line=None, column=None, help_=None, spec_version=None, section=None, seq=0, doc_id="doc_id") -> DataFrame:
    """One finding for each row; arguments are columns or constants, ``doc_id`` may be a name."""
    doc = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return rows.select(
        doc.cast("string").alias("doc_id"),
        _as_column(spec_id, "string").alias("spec_id"),
        F.lit(severity).alias("severity"),
        F.lit(SEVERITIES.index(severity)).alias("severity_rank"),
        _as_column(code, "string").alias("code"),
        _as_column(message, "string").alias("message"),
        _as_column(line, "int").alias("line"),
        _as_column(column, "int").alias("column"),
        _as_column(pointer, "string").alias("pointer"),
        _as_column(help_, "string").alias("help"),
        _as_column(spec_version, "string").alias("spec_version"),
        _as_column(section, "string").alias("section"),
        _as_column(seq, "long").alias("seq"),
    )
