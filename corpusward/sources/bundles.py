"""Knowledge bundles: concepts grouped under the outermost folder with an ``index.md``."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusward.functions.batches import in_blocks
from corpusward.sources.documents import PROBLEMS, parse

#: Names that concepts may not have (a parameter of the format).
RESERVED = ("index.md", "log.md")
CONCEPTS = "bundle string, concept_id string, path string, frontmatter_json string, keys array<string>, body string, problem string"


def _owned(docs: DataFrame, only: str | None = None) -> DataFrame:
    """bundle, path (inside it) and text of each file (of the name ``only``) that lies below a folder with an index.md, the outermost one."""
    files, name = docs.select(F.col("doc_id").alias("file"), "text"), F.regexp_extract("file", "[^/]+$", 0)
    if only:
        files = files.where(name == only)
    roots = docs.select(F.col("doc_id").alias("file")).where(name == "index.md").select(F.regexp_replace("file", "/?index\\.md$", "").alias("bundle")).distinct()
    parts = F.split("file", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    owners = files.select("file", F.explode(ancestors).alias("bundle")).join(roots, "bundle").groupBy("file").agg(F.min_by("bundle", F.char_length("bundle")).alias("bundle"))
    path = F.when(F.col("bundle") == "", F.col("file")).otherwise(F.substring("file", F.char_length("bundle") + 2, F.char_length("file")))
    return files.join(owners, "file").select("bundle", path.alias("path"), "text")


def read_bundles(docs: DataFrame, reserved: tuple[str, ...] = RESERVED) -> tuple[DataFrame, DataFrame]:
    """concepts and index files of ``docs`` (doc_id: path, text).

    A file belongs to its outermost ancestor folder with an index.md.  concepts has the
    path inside the bundle, frontmatter as JSON with its keys in order, the body, and a
    problem where the frontmatter does not parse.  Lines may end as on any system.  A file
    of a reserved name is a concept only if its frontmatter has a type.  A null text reads
    as an empty one here; ``unreadable_bundles`` tells of it.
    """
    owned = _owned(docs)
    name = F.regexp_extract("path", "[^/]+$", 0)
    # Chosen before they meet their bundles: a file keeps its name there, and no text of another is made for it.
    index = _owned(docs, only="index.md").select("bundle", "path", F.col("text").alias("body"))
    rows = owned.where(F.col("path").endswith(".md")).mapInArrow(_split, CONCEPTS)
    return rows.where(~name.isin(list(reserved)) | F.array_contains("keys", "type")), index


def unreadable_bundles(docs: DataFrame) -> DataFrame:
    """bundle and files of each bundle that holds files without a text: what could not be read."""
    return _owned(docs).where(F.col("text").isNull()).groupBy("bundle").agg(F.count(F.lit(1)).alias("files"))


_FRONT = re.compile(r"\A\ufeff?---[ \t]*\r?\n(.*?)^---[ \t]*(?:\r?\n|\Z)", re.DOTALL | re.MULTILINE)


def _split(batches):
    for batch in in_blocks(batches, 2):
        out = []
        for bundle, path, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            front, keys, body, problem = "{}", [], text or "", None
            if m := _FRONT.match(body):
                body = body[m.end() :]
                try:
                    value = parse(m[1])
                    if not isinstance(value, dict):
                        raise ValueError("no mapping")
                    front, keys = json.dumps(value), list(value)
                except PROBLEMS as e:
                    problem = type(e).__name__
            out.append((bundle, path.removesuffix(".md"), path, front, keys, body, problem))
        columns = list(zip(*out, strict=True)) if out else [[]] * 7
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in CONCEPTS.split(", ")])


def front(path: str):
    """A string of the frontmatter, null where it is absent."""
    return F.get_json_object("frontmatter_json", f"$.{path}")
