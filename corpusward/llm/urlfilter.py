"""Allow and block rules for URLs, matched through hashed expressions.

Every URL is expanded into (host suffix, path prefix) expressions.  These meet the
rules in an equi-join on the first bytes of a digest; the full digest confirms a
meeting, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of the digest that are joined on (4 bytes, as in public lists of unsafe URLs).
PREFIX = 8
#: Rules up to this many are broadcast (about 20 MB with their digests); more are joined by shuffle.
BROADCAST_RULES = 100_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    # The host's length keeps (host, path) apart from other splits of the same characters.
    return F.sha2(F.concat_ws("|", F.char_length(host).cast("string"), host, path), 256)


def resolve(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The winning rule of each distinct (host, path) of ``urls`` that any rule fits.

    ``rules`` has host, path and verdict; null parts count as empty, null verdicts as
    block, repeated rules as one.  A rule fits its host and all subdomains where the
    path starts with the rule's; an empty rule host fits every host.  The longest rule
    (host and path) wins, then the longer host, then block before allow.  Returns
    host, path, rule, verdict.
    """
    spark = urls.sparkSession
    rules = rules.select(*(F.coalesce(F.col(c).cast("string"), F.lit(d)).alias(c) for c, d in (("host", ""), ("path", ""), ("verdict", "block")))).distinct()
    rules = rules.select(_digest(F.col("host"), F.col("path")).alias("digest"), F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict"))
    rules = rules.withColumn("prefix", F.substring("digest", 1, PREFIX))
    few = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    lengths = sorted(r[0] for r in rules.select(F.char_length("rule_path")).distinct().collect())  # at most as many as a URL has characters

    pairs = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.", -1)
    n = F.size(labels)
    suffixes = F.array_distinct(F.concat(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), ".")), F.array(F.lit(""))))
    cuts = F.filter(F.array(*(F.lit(x) for x in lengths)) if lengths else F.array().cast("array<int>"), lambda k: k <= F.char_length("path"))
    expressions = (
        pairs.withColumn("suffix", F.explode(suffixes))
        .withColumn("k", F.explode(cuts))
        .select("host", "path", _digest(F.col("suffix"), F.substring(F.col("path"), F.lit(1), F.col("k"))).alias("seen"))
        .withColumn("prefix", F.substring("seen", 1, PREFIX))
    )
    met = expressions.join(F.broadcast(rules) if few else rules, "prefix").where(F.col("seen") == F.col("digest"))
    rank = F.struct(
        (F.char_length("rule_host") + F.char_length("rule_path")).alias("length"), F.char_length("rule_host").alias("host_length"), (F.col("verdict") == "block").alias("block"), F.concat("rule_host", "rule_path").alias("rule"), F.col("verdict")
    )
    best = met.groupBy("host", "path").agg(F.max(rank).alias("best"))
    return best.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))


def url_verdicts(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row for each row of ``pages``: page_id, host, path, rule (null if none fits), verdict.

    Null URLs and URLs without ``://`` have an empty host and path; null ids stay null,
    repeated rows are judged each, very long URLs whole.  Only the id and the URL are
    read.  Distinct addresses are resolved once; a very common address is one row there,
    and Spark splits its partition in the join back.  Rows without an address, however
    many, are not shuffled: they meet the one resolved row of the empty address.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    empty = (F.col("host") == "") & (F.col("path") == "")
    addressed = rows.where(~empty)
    bare = rows.where(empty).join(F.broadcast(resolve(rows.where(empty).limit(1), rules)), ["host", "path"], "left")
    out = addressed.join(resolve(addressed, rules), ["host", "path"], "left").unionByName(bare)
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
