"""Markdown structure: fenced blocks by a small line reader, headings and links outside them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusward.functions.batches import in_blocks

_OPEN = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")


def fences(body: str) -> Iterator[tuple[str, str, int, int]]:
    """(language, code, opening line, closing line) of each closed fence; lines count from 1."""
    mark, language, start, code = "", "", 0, []
    for number, line in enumerate(body.replace("\r\n", "\n").split("\n"), 1):
        m = _OPEN.match(line)
        if mark:
            if m and m[1][0] == mark[0] and len(m[1]) >= len(mark) and not m[2].strip():
                yield language, "\n".join(code), start, number
                mark = ""
            else:
                code.append(line)
        elif m and not (m[1][0] == "`" and "`" in m[2]):
            mark, start, code = m[1], number, []
            language = re.split(r"[, \t]", m[2].strip())[0]


def fenced_code_blocks(rows: DataFrame, text: str = "body") -> DataFrame:
    """``rows`` without ``text``, one row for each closed fenced block, plus language, code, start_line, end_line, seq."""
    keep = [f for f in rows.schema.fields if f.name != text]
    names, texts = [f.name for f in keep], rows.columns.index(text)

    def task(batches):
        for batch in in_blocks(batches, texts):
            at, found = [], []
            for i, body in enumerate(batch.column(batch.schema.get_field_index(text)).to_pylist()):
                for seq, block in enumerate(fences(body or "")):
                    at.append(i)
                    found.append((*block, seq))
            columns = list(zip(*found, strict=True)) if found else [[]] * 5
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
            own = [batch.column(batch.schema.get_field_index(n)).take(pa.array(at, pa.int64())) for n in names]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [*names, "language", "code", "start_line", "end_line", "seq"])

    new = [T.StructField("language", T.StringType()), T.StructField("code", T.StringType()), *(T.StructField(n, T.IntegerType()) for n in ("start_line", "end_line", "seq"))]
    return rows.mapInArrow(task, T.StructType([*keep, *new]))


def text_lines(concepts: DataFrame, blocks: DataFrame) -> DataFrame:
    """Lines of bodies outside closed fences: bundle, concept_id, line (from 1), text, level (0: no heading).

    ``blocks`` comes from ``fenced_code_blocks``.
    """
    lines = concepts.select("bundle", "concept_id", F.posexplode(F.split(F.coalesce("body", F.lit("")), r"\r?\n")).alias("at", "text")).withColumn("line", F.col("at") + 1)
    inside = blocks.select("bundle", "concept_id", F.explode(F.sequence("start_line", "end_line")).alias("line"))
    level = F.char_length(F.regexp_extract("text", r"^ {0,3}(#{1,6})(\s|$)", 1))
    return lines.join(inside, ["bundle", "concept_id", "line"], "left_anti").select("bundle", "concept_id", "line", "text", level.alias("level"))


def body_without_code(concepts: DataFrame, blocks: DataFrame) -> DataFrame:
    """bundle, concept_id, path, prose: bodies without their fenced blocks."""
    prose = text_lines(concepts, blocks).groupBy("bundle", "concept_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("prose"))
    return concepts.select("bundle", "concept_id", "path").join(prose, ["bundle", "concept_id"], "left").withColumn("prose", F.coalesce("prose", F.lit("")))
