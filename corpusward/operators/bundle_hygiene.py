"""Hygiene of knowledge bundles: reports only, never an error."""

from __future__ import annotations

import json
import shlex

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusward.functions.markdown import text_lines
from corpusward.operators.bundles import found, sources
from corpusward.operators.report import merge_reports
from corpusward.sources.documents import PROBLEMS
from corpusward.sources.bundles import front

#: Order of known frontmatter keys.
KEY_ORDER = ("type", "resource", "title", "description", "tags", "status", "stale_after", "generated", "verified", "sources", "usage_window")
ACTOR = r"^(human:\S+|process:\S+|[^\s/:]+/[^\s/]+)$"
PORTABLE = r"^(?!(?i)(con|prn|aux|nul|com[1-9]|lpt[1-9])(\.|$))[A-Za-z0-9][A-Za-z0-9._-]*$"
COMPUTATION = r"^ {0,3}#+\s+Computation\s*$"
#: What code blocks call a language, and its name.
LANGUAGES = {
    "python": "py python python3",
    "javascript": "js javascript node nodejs mjs cjs",
    "typescript": "ts typescript deno bun mts cts tsx jsx",
    "rust": "rs rust",
    "sql": "sql",
    "json": "json",
    "yaml": "yaml yml",
    "bash": "sh bash zsh shell",
}
#: Languages that can be checked here.
CHECKABLE = ("json", "yaml", "bash")


def language_name(tag: Column) -> Column:
    """The language that a tag means, whatever its case; null for other tags."""
    return F.coalesce(*(F.when(F.lower(F.trim(tag)).isin(tags.split()), F.lit(name)) for name, tags in LANGUAGES.items()))


def heading_structure(concepts: DataFrame, lines: DataFrame) -> DataFrame:
    """OKFL01 without a top-level heading; OKFL03 for each further one and each skipped level; OKFL04 for an empty heading.

    ``lines`` are those outside code, with their level.  A heading is empty if only blank
    lines, and no code, follow up to the next heading, and that is not deeper.
    """
    own = Window.partitionBy("bundle", "concept_id").orderBy("line")
    heads = lines.where("level > 0").select("*", F.lag("level").over(own).alias("before"), F.lead("level").over(own).alias("next"), F.lead("line").over(own).alias("next_line"), F.count_if(F.col("level") == 1).over(own).alias("top"))
    heads = heads.join(concepts.select("bundle", "concept_id", "path"), ["bundle", "concept_id"])
    none = concepts.join(heads.where("level = 1").select("bundle", "concept_id").distinct(), ["bundle", "concept_id"], "left_anti")
    again = heads.where("level = 1 and top > 1")
    skipped = heads.where("level > before + 1")
    # Lines with text, and lines of code, are the content of the heading before them.
    total = concepts.select("bundle", "concept_id", F.size(F.split(F.coalesce("body", F.lit("")), "\n")).alias("n_lines"))
    since = Window.partitionBy("bundle", "concept_id").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    content = lines.withColumn("head", F.max(F.when(F.col("level") > 0, F.col("line"))).over(since)).where("level = 0").groupBy("bundle", "concept_id", F.col("head").alias("line")).agg(F.count_if(F.col("text").rlike(r"\S")).alias("full"), F.count(F.lit(1)).alias("plain"))
    spans = heads.join(total, ["bundle", "concept_id"]).withColumn("span", F.coalesce(F.col("next_line") - 1, F.col("n_lines")) - F.col("line"))
    filled = spans.join(content, ["bundle", "concept_id", "line"], "left")
    empty = filled.where((F.coalesce("full", F.lit(0)) == 0) & (F.coalesce("plain", F.lit(0)) == F.col("span")) & ~F.coalesce(F.col("next") > F.col("level"), F.lit(False)))
    return merge_reports(
        found(none, "OKFL01", "warning", "no top-level heading"), found(again, "OKFL03", "warning", "a further top-level heading", F.col("line")), found(skipped, "OKFL03", "warning", "a heading level is skipped", F.col("line")), found(empty, "OKFL04", "warning", "a heading has no content", F.col("line"))
    )


def key_order(concepts: DataFrame, order: tuple[str, ...] = KEY_ORDER) -> DataFrame:
    """OKFL02 [info] once where known keys are out of order."""
    ranks = F.filter(F.transform("keys", lambda k: F.array_position(F.array(*map(F.lit, order)), k)), lambda r: r > 0)
    return found(concepts.where(ranks != F.array_sort(ranks)), "OKFL02", "info", "keys are out of order")


def actor_convention(concepts: DataFrame) -> DataFrame:
    """OKFL06 [info]: an author that is no human:<id>, process:<id> or <producer>/<version>."""
    return found(sources(concepts).where(F.col("author").isNotNull() & ~F.col("author").rlike(ACTOR)), "OKFL06", "info", F.concat(F.lit("author "), "author"), F.col("at"))


def under_computation(blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """``blocks`` whose last heading before them is ``Computation``."""
    heads = lines.where("level > 0").select("bundle", "concept_id", F.col("line").alias("start_line"), F.col("text").rlike(COMPUTATION).alias("_own"))
    before = Window.partitionBy("bundle", "concept_id").orderBy("start_line")
    both = blocks.withColumn("_own", F.lit(None).cast("boolean")).unionByName(heads, allowMissingColumns=True)
    return both.withColumn("_under", F.last("_own", ignorenulls=True).over(before)).where("_under and _own is null").select(*blocks.columns)


def untagged_computation(concepts: DataFrame, blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """OKFL07: a fenced block without a language under the ``Computation`` heading."""
    bare = under_computation(blocks, lines).where("language = ''")
    return found(bare.join(concepts.select("bundle", "concept_id", "path"), ["bundle", "concept_id"]), "OKFL07", "warning", "the computation names no language", F.col("start_line"))


def trailing_whitespace(concepts: DataFrame) -> DataFrame:
    """OKFL08 [info] once: how many lines end in white space (blank ones that are not empty too), and the first.

    A line ends at a newline, with the carriage return before it.
    """
    bad = F.filter(F.transform(F.split("body", r"\r?\n"), lambda x, i: F.when(x.rlike(r"(?U)\s\z"), i + 1)), lambda i: i.isNotNull())
    rows = concepts.withColumn("bad", bad).where(F.size("bad") > 0)
    return found(rows, "OKFL08", "info", F.concat(F.size("bad").cast("string"), F.lit(" lines, the first is "), F.col("bad")[0].cast("string")))


def portable_ids(concepts: DataFrame) -> DataFrame:
    """OKFR01 for each segment of an id that not every file system takes."""
    return found(concepts.select("*", F.posexplode(F.split("concept_id", "/")).alias("at", "segment")).where(~F.col("segment").rlike(PORTABLE)), "OKFR01", "warning", F.concat("segment", F.lit(" is not portable")), F.col("at"))


def unverified_and_draft(concepts: DataFrame) -> DataFrame:
    """OKFL11 [info]: nothing verified; OKFL12: a draft."""
    none = F.size(F.coalesce(F.from_json(front("verified"), "array<string>"), F.array().cast("array<string>"))) == 0
    return merge_reports(found(concepts.where(none), "OKFL11", "info", "never verified"), found(concepts.where(front("status") == "draft"), "OKFL12", "warning", "is a draft"))


def _reads_yaml(text: str) -> None:
    """Whether ``text`` is YAML, from its events alone: values, tags and depth do not matter."""
    anchors = set()
    for event in yaml.parse(text, Loader=yaml.CSafeLoader):
        if isinstance(event, yaml.AliasEvent) and event.anchor not in anchors:
            raise ValueError("an alias of nothing")
        if isinstance(event, yaml.DocumentStartEvent):
            anchors.clear()
        elif getattr(event, "anchor", None):
            anchors.add(event.anchor)


@F.pandas_udf(T.BooleanType())
def _parses(language: pd.Series, code: pd.Series) -> pd.Series:
    checks = {"json": json.loads, "yaml": _reads_yaml, "bash": lambda c: shlex.split(c, comments=True)}

    def ok(kind: str, text: str) -> bool:
        try:
            checks[kind](text)
            return True
        except PROBLEMS:
            return False

    return pd.Series([ok(k, c) for k, c in zip(language, code, strict=True)], dtype=bool)


def computation_blocks(concepts: DataFrame, blocks: DataFrame) -> DataFrame:
    """bundle, concept_id, start_line, code: the first block under a concept's ``Computation`` heading, if it names a language."""
    some = concepts.where(F.col("body").rlike(f"(?m){COMPUTATION}"))
    under = under_computation(blocks, text_lines(some, blocks))
    first = under.groupBy("bundle", "concept_id").agg(F.min(F.struct("start_line", "language", "code")).alias("b"))
    return first.select("bundle", "concept_id", "b.*").where("language <> ''").drop("language")


def code_block_syntax(concepts: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks in a checkable language (JSON, YAML, shell) that do not parse.

    The ``Computation`` block is OKF310 [warning], and blocks with its code are not
    reported again; all others are OKF007 [info].
    """
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    computed = computation_blocks(concepts, blocks).select("bundle", "concept_id", F.col("start_line").alias("own_line"), trimmed("code").alias("own_code"))
    rows = blocks.withColumn("kind", language_name(F.col("language"))).where(F.col("kind").isin(list(CHECKABLE)) & F.col("code").rlike(r"\S"))
    rows = rows.join(computed, ["bundle", "concept_id"], "left").withColumn("own", F.coalesce(F.col("start_line") == F.col("own_line"), F.lit(False)))
    rows = rows.where(F.col("own") | F.col("own_code").isNull() | (trimmed("code") != F.col("own_code")))
    rows = rows.where(~_parses("kind", "code")).join(concepts.select("bundle", "concept_id", "path"), ["bundle", "concept_id"])
    each = lambda rows, code, severity: found(rows, code, severity, F.concat("kind", F.lit(" does not parse")), F.col("start_line"))
    return merge_reports(each(rows.where("own"), "OKF310", "warning"), each(rows.where("not own"), "OKF007", "info"))


def language_coverage(blocks: DataFrame) -> DataFrame:
    """language (its name, else the tag in lower case), checkable, blocks, concepts."""
    name = F.coalesce(language_name(F.col("language")), F.lower("language"))
    return blocks.groupBy(name.alias("language")).agg(F.count(F.lit(1)).alias("blocks"), F.count_distinct("bundle", "concept_id").alias("concepts")).withColumn("checkable", F.col("language").isin(list(CHECKABLE)))
