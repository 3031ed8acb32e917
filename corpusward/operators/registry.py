"""Provenance: what a registry of vendored artefacts says, and whether it is so."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusward.functions.lineage import cut, stored
from corpusward.functions.severity import findings
from corpusward.operators.report import gate, merge_reports
from corpusward.schemas import REGISTRY
from corpusward.sources.files import file_digests

#: Refs that move.
MOVING_REFS = ("latest", "head", "main", "master", "trunk", "default", "stable", "current", "edge", "tip", "release", "dev", "next")
GAPS = ("homepage", "repository", "steward", "licence", "pinned_ref")
SCHEMA_VERSION = 1
VALIDATED = ("odcs", "odps", "okf", "odcl")


def _blank(c: str | Column) -> Column:
    column = F.col(c) if isinstance(c, str) else c
    return column.isNull() | ~column.rlike(r"\S")


def registry_frame(spark: SparkSession, entries: list[tuple], schema_version: int | None = SCHEMA_VERSION) -> tuple[DataFrame, DataFrame]:
    """The registry's entries as a table and the problems of the registry itself.

    ``entries`` None: unreadable (REG100); a schema version other than 1: REG102; entries
    of another shape: REG101.
    """
    n_columns = len(spark.createDataFrame([], REGISTRY).columns)
    code = "REG100" if entries is None else "REG102" if schema_version != SCHEMA_VERSION else "REG101" if any(len(e) != n_columns for e in entries) else None
    table = spark.createDataFrame([] if code else entries, REGISTRY)
    problem = spark.range(0 if code is None else 1)
    return table, findings(problem, doc_id=F.lit("registry"), spec_id=None, severity="error", code=code or "", message="the registry cannot be used")


def _at(rows: DataFrame, code: str | Column, severity: str, message, field: Column) -> DataFrame:
    return findings(rows, doc_id="id", spec_id=None, severity=severity, code=code, message=message, pointer=F.concat(F.lit("/spec/"), F.col("idx").cast("string"), F.lit("/"), field), seq=F.col("idx"))


def registry_field_rules(registry: DataFrame) -> DataFrame:
    """Blank required fields 006, bad digests 007, unsafe paths 008, dates 010 (errors); links without https 009 (warning)."""
    required = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("id", "name", "vendored_path", "sha256", "fetched_at"))))
    rows = registry.select("id", "idx", required.alias("f")).select("id", "idx", "f.*")
    blank = _blank("value")
    path = (F.col("field") == "vendored_path") & (F.col("value").startswith("/") | F.array_contains(F.split("value", "/"), ".."))
    digest = (F.col("field") == "sha256") & ~F.col("value").rlike("^[0-9a-f]{64}$")
    date = (F.col("field") == "fetched_at") & ~F.col("value").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    code = F.when(blank, "REG006").when(path, "REG008").when(digest, "REG007").when(date, "REG010")
    bad = rows.withColumn("code", code).where("code is not null")
    links = F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.col(c).alias("value")) for n, c in (("homepage", "homepage"), ("repository", "repository"), ("poll/endpoint", "poll.endpoint")))))
    urls = registry.select("id", "idx", links.alias("f")).select("id", "idx", "f.*").where(~_blank("value") & ~F.col("value").startswith("https://"))
    return merge_reports(_at(bad, F.col("code"), "error", F.concat("field", F.lit(" is not usable")), F.col("field")), _at(urls, "REG009", "warning", F.concat("field", F.lit(" is not an https link")), F.col("field")))


def pin_rules(registry: DataFrame) -> DataFrame:
    """A moving ref is no pin (REG001, error); an absent one is REG002 (warning)."""
    moving = registry.where(F.lower(F.trim("pinned_ref")).isin(list(MOVING_REFS)))
    return merge_reports(_at(moving, "REG001", "error", F.concat("pinned_ref", F.lit(" moves")), F.lit("pinned_ref")), _at(registry.where(_blank("pinned_ref")), "REG002", "warning", "nothing is pinned", F.lit("pinned_ref")))


def _gaps() -> Column:
    return F.filter(F.array(*(F.when(_blank(c), F.lit(c)) for c in GAPS)), lambda c: c.isNotNull())


def provenance_gaps(registry: DataFrame) -> DataFrame:
    """REG003 [warning] for each gap but the pin; REG004 [error] where gaps are not explained in the notes."""
    each = registry.select("id", "idx", F.posexplode(_gaps()).alias("at", "gap")).where("gap <> 'pinned_ref'")
    silent = registry.where((F.size(_gaps()) > 0) & _blank("notes"))
    return merge_reports(_at(each, "REG003", "warning", F.concat("gap", F.lit(" is not recorded")), F.col("gap")), _at(silent, "REG004", "error", "gaps are not explained", F.lit("notes")))


def gap_totals(registry: DataFrame) -> DataFrame:
    """entries_with_gaps, total_gaps, pollable."""
    gaps = F.size(_gaps())
    return registry.agg(F.count_if(gaps > 0).alias("entries_with_gaps"), F.coalesce(F.sum(gaps), F.lit(0)).cast("long").alias("total_gaps"), F.count_if(F.col("poll").isNotNull()).alias("pollable"))


def duplicate_entry_ids(registry: DataFrame) -> DataFrame:
    """REG005 for each later entry of an id, naming the first."""
    same = Window.partitionBy("id").orderBy("idx")
    rows = registry.where(~_blank("id")).select("id", "idx", F.row_number().over(same).alias("n"), F.first("idx").over(same).alias("first")).where("n > 1")
    return _at(rows, "REG005", "error", F.concat(F.lit("the id is that of entry "), F.col("first").cast("string")), F.lit("id"))


def verify_digests(registry: DataFrame, artefacts: DataFrame) -> DataFrame:
    """id, idx, path, status (matched, drifted, missing, unreadable), bytes, actual.

    ``artefacts`` has path and content (null: unreadable).  Contents are hashed where they
    are read; only digests meet the registry.
    """
    hashed = artefacts.select("path", F.sha2("content", 256).alias("actual"), F.octet_length("content").cast("long").alias("bytes"), F.lit(True).alias("there"))
    return _verified(registry, hashed)


def verify_files(registry: DataFrame, root: str) -> DataFrame:
    """``verify_digests`` of artefacts that lie as files under ``root``: each is hashed as it is read, whatever its size."""
    return _verified(registry, file_digests(registry.select(F.col("vendored_path").alias("path")), root))


def _verified(registry: DataFrame, hashed: DataFrame) -> DataFrame:
    """``hashed`` has path, actual, bytes and there."""
    rows = registry.join(hashed.withColumnRenamed("path", "vendored_path"), "vendored_path", "left")
    status = F.when(~F.coalesce("there", F.lit(False)), "missing").when(F.col("actual").isNull(), "unreadable").when(F.trim("sha256") == F.col("actual"), "matched").otherwise("drifted")
    return rows.select("id", "idx", F.col("vendored_path").alias("path"), status.alias("status"), "bytes", "actual")


def digest_findings(verified: DataFrame) -> DataFrame:
    """REG020 missing, REG021 unreadable, REG022 drifted (errors), REG023 matched (info, with the number of bytes)."""
    code = F.when(F.col("status") == "missing", "REG020").when(F.col("status") == "unreadable", "REG021").otherwise("REG022")
    ok = verified.where("status = 'matched'")
    return merge_reports(_at(ok, "REG023", "info", F.concat(F.lit("matches, bytes: "), F.col("bytes").cast("string")), F.lit("sha256")), _at(verified.where("status <> 'matched'"), code, "error", F.concat(F.lit("artefact is "), "status"), F.lit("sha256")))


def reconcile_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """path and status (ok, drifted, missing, unlisted) of a manifest (path, sha256) and files (path, content)."""
    there = files.select(F.col("path").alias("file"), F.sha2("content", 256).alias("actual"))
    both = manifest.select(F.col("path").alias("listed"), "sha256").join(there, F.col("listed") == F.col("file"), "full_outer")
    status = F.when(F.col("file").isNull(), "missing").when(F.col("listed").isNull(), "unlisted").when(F.trim("sha256") == F.col("actual"), "ok").otherwise("drifted")
    return both.select(F.coalesce("listed", "file").alias("path"), status.alias("status"))


def verdict_agreement(recorded: DataFrame, computed: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id and status of recorded verdicts against ours.

    ``recorded`` has doc_id, sha256, verdict (ok or err); ``computed`` doc_id, digest,
    verdict; ``known`` the doc_ids of listed divergences.  A null verdict is as none.
    uncovered: nothing recorded; orphan: recorded, nothing computed; stale: another digest; then agree, converged-but-listed,
    known-divergence or unexpected-divergence.
    """
    r = recorded.select("doc_id", F.col("sha256").alias("recorded_digest"), F.col("verdict").alias("recorded_verdict"))
    c = computed.select("doc_id", "digest", "verdict")
    k = known.select("doc_id").distinct().withColumn("listed", F.lit(True))
    rows = c.join(r, "doc_id", "full_outer").join(k, "doc_id", "left")
    same = F.col("verdict") == F.col("recorded_verdict")
    listed = F.coalesce("listed", F.lit(False))
    status = (
        F.when(F.col("recorded_verdict").isNull(), "uncovered")
        .when(F.col("verdict").isNull(), "orphan")
        .when(F.col("digest") != F.col("recorded_digest"), "stale")
        .when(same & listed, "converged-but-listed")
        .when(same, "agree")
        .when(listed, "known-divergence")
        .otherwise("unexpected-divergence")
    )
    return rows.select("doc_id", status.alias("status"))


def own_verdicts(docs: DataFrame, validate: Callable[[DataFrame], DataFrame], rules: str, path: str, policy: str = "error") -> DataFrame:
    """doc_id, digest, verdict (ok or err) and validated of ``docs`` (doc_id, text), by a table at ``path`` of verdicts by digest.

    ``validate`` gives the findings of documents whose doc_id is their digest; a document
    whose findings ``policy`` gates is err.  ``rules`` names what they are validated
    against: verdicts on the same text under other rules are others.  Only texts without a
    verdict are validated, each once however many documents have it, and added to
    the table; validated says which documents had to wait for that.  A null text is an empty one.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.sha2("text", 256))
    schema = "digest string, verdict string, rules string"
    # A folder of this name keeps the table readable before its first verdict.
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    known = cut(spark.read.schema(schema).parquet(path).where(F.col("rules") == rules).select("digest", "verdict").distinct())
    new = stored(rows.join(known, "digest", "left_anti").select(F.col("digest").alias("doc_id"), "text").dropDuplicates(["doc_id"]))
    gated = gate(validate(new), policy, ["doc_id"]).select("doc_id", "gated")
    fresh = cut(new.select("doc_id").join(gated, "doc_id", "left").select(F.col("doc_id").alias("digest"), F.when(F.coalesce("gated", F.lit(False)), "err").otherwise("ok").alias("verdict")))
    fresh.withColumn("rules", F.lit(rules)).write.mode("append").parquet(path)
    all_ = known.withColumn("validated", F.lit(False)).unionByName(fresh.withColumn("validated", F.lit(True)))
    return rows.drop("text").join(all_, "digest").select("doc_id", "digest", "verdict", "validated")


def verdict_balance(recorded: DataFrame, computed: DataFrame, least: int = 2) -> DataFrame:
    """side (recorded, computed), passes, fails and whether each is at least ``least``: agreement means little otherwise."""
    verdicts = recorded.select(F.lit("recorded").alias("side"), "verdict").unionByName(computed.select(F.lit("computed").alias("side"), "verdict"))
    sides = recorded.sparkSession.createDataFrame([("recorded",), ("computed",)], "side string")
    counts = sides.join(verdicts, "side", "left").groupBy("side").agg(F.count_if(F.col("verdict") == "ok").alias("passes"), F.count_if(F.col("verdict") == "err").alias("fails"))
    return counts.withColumn("discriminates", (F.col("passes") >= least) & (F.col("fails") >= least))


def catalogue(registry: DataFrame, verified: DataFrame) -> DataFrame:
    """One row for each entry: trimmed optionals, gaps, digest status, has_validator, upstream link."""
    text = lambda c: F.nullif(F.trim(c), F.lit("")).alias(c)
    rows = registry.join(verified.select("idx", "status"), "idx", "left")
    upstream = F.coalesce(F.nullif(F.trim("homepage"), F.lit("")), F.nullif(F.trim("repository"), F.lit("")))
    return rows.select("idx", "id", "name", *(text(c) for c in ("version", *GAPS)), F.array_join(_gaps(), ",").alias("gaps"), "status", F.col("id").isin(list(VALIDATED)).alias("has_validator"), upstream.alias("upstream"))
