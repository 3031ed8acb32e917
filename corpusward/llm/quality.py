"""Quality rules with host-level verdicts, in DataFrame functions only.

Documents are measured row by row with higher-order array functions.  Rule
failures are then counted by host, every host's rate is shrunk towards a beta
prior that is fitted to all hosts, and the verdicts of bad hosts are joined back:
a document that breaks a soft rule is forgiven on a good host and rejected on a
bad one.  Documents that break no rule stay whatever their host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusward.functions.lineage import cut

BLANKS = r"[\x20\x09-\x0D]+"
WINDOW = 5
#: Bad hosts up to this many are broadcast (a name of 1 kB each: 20 MB); more are joined by shuffle.
BROADCAST_HOSTS = 20_000


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """Number of words inside 5-word windows that occur twice or more in the text."""

    def covered(windows: Column) -> Column:
        ranked = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        repeated = let(
            ranked,
            lambda s: F.filter(
                F.transform(s, lambda e, i: F.when((F.get(s, i - 1)["x"] == e["x"]) | (F.get(s, i + 1)["x"] == e["x"]), e["i"])),
                lambda p: p.isNotNull(),
            ),
        )
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total"))
        return F.aggregate(
            F.sort_array(repeated),
            start,
            lambda a, p: F.struct(p.alias("last"), (a["total"] + F.least(F.lit(WINDOW), p - a["last"])).alias("total")),
            lambda a: a["total"],
        )

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.array_join(F.slice(words, i, WINDOW), " "))
    distinct = let(windows, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))
    return F.when(F.size(words) < WINDOW + 1, F.lit(0)).otherwise(distinct)


def measures(text: Column) -> Column:
    """Struct of a text's counts; a null text counts as one without words.

    n_words, word_chars (code points in words), n_symbols, n_lines (lines with a
    word), n_dup_lines (such lines that equal an earlier one), n_repeat_words.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(
        F.array_remove(F.split(text, BLANKS, -1), ""),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("all"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("again"))).alias("lines"),
            _repeated(w).cast("long").alias("n_repeat_words"),
        ),
    )


def judged(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``_q``: the counts and the rules that the text breaks.

    base_failed: under ten words, or over 20 % of the words repeated.  soft_failed:
    over one symbol in ten words, over 30 % repeated lines, or words of less than
    two or more than twelve code points on average.
    """
    m = measures(F.col(text))

    def rules(q: Column) -> Column:
        n = q["n_words"]
        base = (n < 10) | (100 * q["n_repeat_words"] > 20 * n)
        soft = (10 * q["n_symbols"] > n) | (100 * q["lines"]["again"] > 30 * q["lines"]["all"]) | (q["word_chars"] < 2 * n) | (q["word_chars"] > 12 * n)
        return F.struct(
            n.alias("n_words"), q["word_chars"].alias("word_chars"), q["n_symbols"].alias("n_symbols"), q["lines"]["all"].alias("n_lines"), q["lines"]["again"].alias("n_dup_lines"), q["n_repeat_words"].alias("n_repeat_words"), base.alias("base_failed"), soft.alias("soft_failed")
        )

    return docs.withColumn("_q", let(m, rules))


def host_rates(failures: DataFrame) -> DataFrame:
    """Shrunk failure rate of every host; ``failures`` has host and failed (boolean).

    The beta prior comes from the hosts themselves by the method of moments, with a
    strength held between 2 and 1000 documents.  Null hosts count as one host.
    Returns host, n_docs, n_failed, rate.  An empty input gives an empty table.
    """
    hosts = failures.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("failed").alias("n_failed"))
    raw = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg((F.sum("n_failed") / F.sum("n_docs")).alias("m"), F.var_pop(raw).alias("v"))
    strength = F.when(F.col("v") > 0, F.least(F.lit(1000.0), F.greatest(F.lit(2.0), F.col("m") * (1 - F.col("m")) / F.col("v") - 1))).otherwise(F.lit(1000.0))
    scalar = prior.select(F.struct(F.col("m"), strength.alias("k")).alias("p")).scalar()
    return hosts.withColumn("p", scalar).select("host", "n_docs", "n_failed", ((F.col("n_failed") + F.col("p")["m"] * F.col("p")["k"]) / (F.col("n_docs") + F.col("p")["k"])).alias("rate"))


def with_verdicts(rows: DataFrame, host: str, threshold: float = 0.5) -> DataFrame:
    """``rows`` (with the struct ``_q``) plus boolean ``_kept``.

    A hot host is one key for the counts, which are combined before the shuffle; on
    the way back only bad hosts are joined, by broadcast after their number was
    checked, else by a join whose large partitions Spark splits.
    """
    failures = rows.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), (F.col("_q")["base_failed"] | F.col("_q")["soft_failed"]).alias("failed"))
    bad = cut(host_rates(failures).where(F.col("rate") > threshold).select(F.col("host").alias("_bad_host")))
    bad = F.broadcast(bad) if bad.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS else bad
    joined = rows.join(bad, F.coalesce(rows[host].cast("string"), F.lit("")) == bad["_bad_host"], "left")
    kept = ~(F.col("_q")["base_failed"] | (F.col("_q")["soft_failed"] & F.col("_bad_host").isNotNull()))
    return joined.withColumn("_kept", kept).drop("_bad_host")


def quality_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row for each row of ``docs``: its counts, broken rules and verdict.

    Repeated rows are each judged; null ids stay null; null and empty texts have no
    words and fail.  Other columns are ignored.  The texts are read once: only the
    counts are kept and shuffled.
    """
    narrow = cut(judged(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(host).alias("host"))).select("doc_id", "host", "_q"))
    return with_verdicts(narrow, "host").select("doc_id", "host", "_q.*", F.col("_kept").alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, unchanged, whatever their columns are called; texts are never shuffled.

    Rows are measured once and kept, with their counts, in the shared folder, from where
    the hosts' rates and then the rows that stay are read.  Nulls, empty and very long
    texts, repeated rows and empty tables are as in ``quality_report``.
    """
    rows = docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text"), F.col(host).alias("_host"))
    measured = cut(judged(rows, "_text").drop("_text"))
    return with_verdicts(measured, "_host").where("_kept").select("_row.*")
