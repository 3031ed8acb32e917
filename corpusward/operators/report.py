"""Report algebra: filtering, counting, ranking, gating and merging findings.

Reporting (what is true) and gating (what fails) stay apart: nothing here drops a
finding because of a policy.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusward.functions.order import positions
from corpusward.functions.severity import SEVERITIES, findings, name_of

#: What a policy may be.
POLICIES = ("never", *SEVERITIES)


def by_severity(found: DataFrame, severity: str) -> DataFrame:
    """Findings of exactly this severity."""
    return found.where(F.col("severity_rank") == SEVERITIES.index(severity))


def at_or_above(found: DataFrame, severity: str) -> DataFrame:
    """Findings of this severity or a worse one."""
    return found.where(F.col("severity_rank") >= SEVERITIES.index(severity))


def _counts() -> list[Column]:
    return [
        F.count_if(F.col("severity_rank") == 2).alias("errors"),
        F.count_if(F.col("severity_rank") == 1).alias("warnings"),
        F.count_if(F.col("severity_rank") == 0).alias("infos"),
        F.count(F.lit(1)).alias("total"),
    ]


def severity_counts(found: DataFrame) -> DataFrame:
    """Counts for each document, each specification and the run, in one pass.

    ``level`` is document, spec or run; the columns of other levels are null.
    """
    level = F.when(F.grouping("doc_id") == 0, "document").when(F.grouping("spec_id") == 0, "spec").otherwise("run").alias("level")
    return found.groupingSets([["doc_id"], ["spec_id"], []], "doc_id", "spec_id").agg(level, *_counts()).select("level", "doc_id", "spec_id", "errors", "warnings", "infos", "total")


def worst_severity(found: DataFrame, by: list[str]) -> DataFrame:
    """The worst severity of each group."""
    return found.groupBy(*by).agg(name_of(F.max("severity_rank")).alias("worst"))


def gate(found: DataFrame, policy: str = "error", by: list[str] | None = None, unusable: bool = False) -> DataFrame:
    """Whether each group (the run, without ``by``) is gated, its worst severity and exit code.

    The policy is ``never`` or a severity: a group with a finding at or above it is
    gated.  exit_code is 2 if the run is unusable, else 1 if gated, else 0.
    """
    if policy not in POLICIES:
        raise ValueError(f"a policy is one of {POLICIES}")
    worst = found.groupBy(*(by or [])).agg(F.max("severity_rank").alias("rank"))
    gated = F.lit(False) if policy == "never" else F.coalesce(F.col("rank") >= SEVERITIES.index(policy), F.lit(False))
    code = F.lit(2) if unusable else F.when(gated, 1).otherwise(0)
    return worst.select(*(by or []), name_of(F.col("rank")).alias("worst"), gated.alias("gated"), code.alias("exit_code"))


def merge_reports(*reports: DataFrame) -> DataFrame:
    """All findings of all reports; duplicates stay."""
    return reduce(DataFrame.unionByName, reports)


def merge_in_order(*reports: DataFrame) -> DataFrame:
    """All findings of all reports with ``position``, from 0: the first report's, then the next one's; within a report by document and ``seq``.

    Duplicates stay.  Findings that a report has twice at one place follow each other.
    """
    both = reduce(DataFrame.unionByName, (r.withColumn("_report", F.lit(i)) for i, r in enumerate(reports)))
    others = [c for c in reports[0].columns if c not in ("doc_id", "seq")]
    return positions(both, [F.col(c) for c in ("_report", "doc_id", "seq", *others)]).drop("_report")


def sort_by_severity(found: DataFrame) -> DataFrame:
    """``merge_in_order``'s findings with ``rank``, from 0: the most severe first, else in the order that they have."""
    return positions(found, [F.col("severity_rank").desc(), F.col("position")], "rank")


def sort_findings(found: DataFrame) -> DataFrame:
    """By document, most severe first, else in the order found (``seq``)."""
    return found.orderBy("doc_id", F.desc("severity_rank"), "seq", "code", "pointer")


def run_envelope(docs: DataFrame, found: DataFrame, policy: str = "never") -> DataFrame:
    """One row for each document of ``docs`` (doc_id), found in or not, as columns and as JSON.

    outcome is gated or reported; absent optionals are JSON nulls.
    """
    counts = found.groupBy("doc_id").agg(F.max("severity_rank").alias("rank"), *_counts())
    rows = docs.select("doc_id").distinct().join(counts, "doc_id", "left")
    gated = F.lit(False) if policy == "never" else F.coalesce(F.col("rank") >= SEVERITIES.index(policy), F.lit(False))
    rows = rows.select("doc_id", F.when(gated, "gated").otherwise("reported").alias("outcome"), name_of(F.col("rank")).alias("worst"), *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("errors", "warnings", "infos", "total")))
    body = F.struct("doc_id", "outcome", "worst", F.struct("errors", "warnings", "infos", "total").alias("counts"))
    return rows.withColumn("json", F.to_json(body, {"ignoreNullFields": "false"}))


def run_summary(docs: DataFrame, found: DataFrame, policy: str = "never") -> DataFrame:
    """The run in one row: outcome (not-performed without documents), counts, exit code."""
    n = docs.agg(F.count_distinct("doc_id").alias("documents"))
    totals = found.agg(F.max("severity_rank").alias("rank"), *_counts())
    # Two rows of one row each.
    both = n.join(totals, F.lit(True))
    gated = F.lit(False) if policy == "never" else F.coalesce(F.col("rank") >= SEVERITIES.index(policy), F.lit(False))
    outcome = F.when(F.col("documents") == 0, "not-performed").when(gated, "gated").otherwise("reported")
    return both.select(outcome.alias("outcome"), "documents", "errors", "warnings", "infos", "total", name_of(F.col("rank")).alias("worst"), F.when(F.col("documents") == 0, 2).when(gated, 1).otherwise(0).alias("exit_code"))


#: Fixed value: the version of the JSON that runs are written as.
SCHEMA_VERSION = 1


def run_json(docs: DataFrame, found: DataFrame, policy: str = "never", specs: list[dict] = (), command: str = "validate", tool: dict | None = None) -> DataFrame:
    """The run as one JSON text: schema version, tool, command, summary, gate, exit code and specifications.

    ``specs`` are the caller's own short list.  Documents and diagnostics, which grow with
    the corpus, are rows of their own: ``run_envelope`` and ``diagnostic_json``.
    """
    run = run_summary(docs, found, policy)
    threshold = F.lit(None).cast("string") if policy == "never" else F.lit(policy)
    body = F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(json.dumps(tool)).alias("tool"), F.lit(command).alias("command"),
        F.struct("outcome", F.lit(len(specs)).alias("specs"), "documents", F.col("total").alias("diagnostics"), F.col("errors").alias("error"), F.col("warnings").alias("warning"), F.col("infos").alias("info")).alias("summary"),
        F.struct(F.lit("never" if policy == "never" else "at-or-above").alias("policy"), threshold.alias("threshold"), (F.col("outcome") == "gated").alias("gated"), F.col("worst").alias("worst_severity")).alias("gate"),
        "exit_code", F.lit(json.dumps(list(specs))).alias("specs"),
    )
    text = F.to_json(body, {"ignoreNullFields": "false"})
    # The caller's own objects go in as they are.
    for key, value in (("tool", tool), ("specs", list(specs))):
        text = F.replace(text, F.lit(f'"{key}":{json.dumps(json.dumps(value))}'), F.lit(f'"{key}":{json.dumps(value)}'))
    return run.select(text.alias("json"))


def diagnostic_json(found: DataFrame) -> DataFrame:
    """doc_id, seq and each finding as the JSON of a diagnostic: location and spec_ref are objects, absent optionals nulls."""
    location = F.struct(F.col("doc_id").alias("document"), "line", "column", "pointer").alias("location")
    reference = F.when(F.col("spec_id").isNotNull(), F.struct(F.col("spec_id").alias("id"), F.col("spec_version").alias("version"), "section")).alias("spec_ref")
    return found.select("doc_id", "seq", F.to_json(F.struct("severity", "code", "message", "help", location, reference), {"ignoreNullFields": "false"}).alias("json"))


def findings_for_pointer(found: DataFrame, prefix: str) -> DataFrame:
    """Findings whose pointer starts with ``prefix``."""
    return found.where(F.col("pointer").startswith(prefix))


def documents_by_spec(docs: DataFrame, spec_id: str) -> DataFrame:
    """Documents of one specification (column ``standard``)."""
    return docs.where(F.col("standard") == spec_id)


def unattributed(docs: DataFrame) -> DataFrame:
    """Documents of no specification."""
    return docs.where(F.col("standard").isNull())


def render_finding() -> Column:
    """A finding as text: ``severity[code] doc:line:column (pointer): message``."""
    place = F.concat(F.coalesce("doc_id", F.lit("")), F.coalesce(F.concat(F.lit(":"), F.col("line").cast("string")), F.lit("")), F.when(F.col("line").isNotNull(), F.coalesce(F.concat(F.lit(":"), F.col("column").cast("string")), F.lit(""))).otherwise(""))
    pointer = F.coalesce(F.concat(F.lit(" ("), F.col("pointer"), F.lit(")")), F.lit(""))
    return F.concat(F.col("severity"), F.lit("["), F.col("code"), F.lit("] "), place, pointer, F.lit(": "), F.coalesce("message", F.lit("")))


def render_spec() -> Column:
    """A reference to a specification as text: ``id@version section``."""
    return F.concat(F.col("spec_id"), F.coalesce(F.concat(F.lit("@"), F.col("spec_version")), F.lit("")), F.coalesce(F.concat(F.lit(" "), F.col("section")), F.lit("")))


def checked_against(docs: DataFrame, schema_status: DataFrame) -> DataFrame:
    """What each routed document was validated against, or why it was not.

    ``schema_status`` has standard, version, causes (array of code and message; empty or
    null when the schema is usable): a row for each standard.  A usable schema gives
    ``*904`` [info]; any other CLI006 [error] and its causes [error].
    """
    status = schema_status.select(F.col("standard").alias("_standard"), "version", F.coalesce("causes", F.array().cast("array<struct<code:string,message:string>>")).alias("causes"))
    # Spark broadcasts the statuses if they are as small as they should be.
    rows = docs.where(F.col("standard").isNotNull()).join(status, F.col("standard") == F.col("_standard"), "left")
    usable = F.col("_standard").isNotNull() & (F.size("causes") == 0)
    ok = findings(rows.where(usable), spec_id=F.col("standard"), severity="info", code=F.concat(F.upper("standard"), F.lit("904")), message=F.concat(F.lit("validated against "), "standard", F.lit(" "), F.coalesce("version", F.lit("?"))), spec_version=F.col("version"))
    bad = rows.where(~usable)
    missing = findings(bad, spec_id=F.col("standard"), severity="error", code="CLI006", message="not checked: no usable schema")
    causes = bad.select("*", F.posexplode("causes").alias("at", "cause"))
    return merge_reports(ok, missing, findings(causes, spec_id=F.col("standard"), severity="error", code=F.col("cause.code"), message=F.col("cause.message"), seq=F.col("at") + 1))
