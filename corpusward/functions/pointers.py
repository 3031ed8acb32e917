"""JSON pointers and node predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pointer_escape(token: Column) -> Column:
    """A key as a pointer token: ``~`` becomes ``~0``, then ``/`` becomes ``~1``."""
    return F.replace(F.replace(token, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def pointer_unescape(token: Column) -> Column:
    """A pointer token as a key: ``~1`` becomes ``/``, then ``~0`` becomes ``~``."""
    return F.replace(F.replace(token, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def is_absent_or_empty(kind: Column, sval: Column, n_children: Column) -> Column:
    """No node, a null, an empty array or object, or a string of white space; false and 0 are present."""
    return kind.isNull() | (kind == "null") | (kind.isin("array", "object") & (n_children == 0)) | ((kind == "string") & ~sval.rlike(r"\S"))
