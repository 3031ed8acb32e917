"""Registries of vendored artefacts as TOML texts."""

from __future__ import annotations

import re
import tomllib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusward.functions.severity import findings
from corpusward.operators.registry import SCHEMA_VERSION
from corpusward.schemas import REGISTRY

#: What an entry, and its poll, may have and must have.
FIELDS = ("id", "name", "version", "homepage", "repository", "steward", "licence", "pinned_ref", "vendored_path", "sha256", "fetched_at", "notes")
REQUIRED = ("id", "name", "vendored_path", "sha256", "fetched_at")
POLL, POLL_REQUIRED = ("endpoint", "method", "field", "cadence"), ("endpoint",)

_ROWS = f"doc_id string, {REGISTRY}, code string, message string, line int, column int"
_TYPES = pa.schema(
    [("doc_id", pa.string()), *((n, pa.string()) for n in FIELDS), ("poll", pa.struct([(n, pa.string()) for n in POLL])), ("idx", pa.int32()), ("code", pa.string()), ("message", pa.string()), ("line", pa.int32()), ("column", pa.int32())]
)


def _checked(table, fields: tuple, required: tuple) -> dict:
    if not isinstance(table, dict):
        raise ValueError("an entry is a table")
    for name in table:
        if name not in fields:
            raise ValueError(f"unknown field {name}")
    for name in fields:
        if name in table and name != "poll" and not isinstance(table[name], str):
            raise ValueError(f"{name} is no string")
        if name in required and name not in table:
            raise ValueError(f"missing field {name}")
    return table


def entries_of(text: str) -> tuple[list[dict], int]:
    """The entries of a registry's text and its schema version; raises ValueError where it is malformed."""
    top = tomllib.loads(text)
    version, listed = top.get("schema_version"), top.get("spec", [])
    if type(version) is not int or version < 0 or set(top) - {"schema_version", "spec"} or not isinstance(listed, list):
        raise ValueError("a registry has a schema_version and specs")
    entries = [_checked(e, (*FIELDS, "poll"), REQUIRED) for e in listed]
    for e in entries:
        if "poll" in e:
            _checked(e["poll"], POLL, POLL_REQUIRED)
    return entries, version


def _read(batches):
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text is None:
                rows.append({"doc_id": doc_id, "code": "REG100", "message": "the registry cannot be read"})
                continue
            try:
                entries, version = entries_of(text)
            except (ValueError, RecursionError) as e:
                place = re.search(r"at line (\d+), column (\d+)", str(e))
                rows.append({"doc_id": doc_id, "code": "REG101", "message": f"malformed: {e}", "line": int(place[1]) if place else None, "column": int(place[2]) if place else None})
                continue
            if version != SCHEMA_VERSION:
                rows.append({"doc_id": doc_id, "code": "REG102", "message": f"schema_version {version} is not {SCHEMA_VERSION}"})
            else:
                rows += [e | {"doc_id": doc_id, "idx": i} for i, e in enumerate(entries)]
        yield pa.RecordBatch.from_pylist(rows, schema=_TYPES)


def read_registries(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entries of every registry of ``docs`` (doc_id, text: TOML), and the findings of the registries themselves.

    Entries have doc_id and the columns of REGISTRY, idx counting within the registry.  A
    null text is REG100, a text that is no TOML or of another shape REG101, with its place
    if the parser tells it, another schema version REG102 (all errors); such a registry has
    no entries.
    """
    rows = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInArrow(_read, _ROWS)
    bad = rows.where("code is not null")
    found = findings(bad, spec_id=None, severity="error", code=F.col("code"), message=F.col("message"), line=F.col("line"), column=F.col("column"), pointer=F.when(F.col("code") == "REG102", "/schema_version"))
    return rows.where("code is null").drop("code", "message", "line", "column"), found
