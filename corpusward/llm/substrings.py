"""Removal of repeated passages with a count-min prefilter.

A window of 50 words is repeated only if the smallest hash among the 8-word shingles
inside it is.  These minima, about one for 22 words, are counted in a count-min
sketch: its cells are rows, partial aggregation makes the sketch of a partition and
the shuffle merges them, and its width follows the number of minima.  The count of a
cell is never below that of any window in it, so windows in cells of one document
are left out and none that repeats is lost.  A second pass hashes the other windows
whole (128 bits) and finds the first document of each exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusward.functions.lineage import cut, stored
from corpusward.llm import words as W
from corpusward.llm.skew import few, join_hot

WINDOW = 50
SHINGLE = 8
#: Cells of the sketch for each counted minimum, and its rows.
CELLS, DEPTH = 16, 2
#: Rows of one cell, or of one window, that stay in one part of a join.
PART = 10_000
SECOND = 0xC2B2AE3D27D4EB4F | 1


def _minima(h: np.ndarray, window: int) -> np.ndarray:
    """For each window of words with hashes ``h``, the smallest hash of a shingle inside it."""
    at = np.arange(len(h) - SHINGLE + 1)
    x = W.mix(W.rolling(h, at, at + SHINGLE))
    span = window - SHINGLE + 1
    # Minima over ``span`` neighbours by doubling: two overlapping ranges of a power of two.
    width = 1
    while 2 * width <= span:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    rest = span - width
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _digests(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each text's sequence of word hashes."""
    n = np.diff(bounds).astype(W.U)
    return tuple(W.mix(W.sequences(v, bounds, b) + n).view(np.int64) for v, b in ((h, SECOND), (W.mix(h), SECOND + 2)))


def _all_windows(h: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start (in the block) and minimum of every window that lies in one text."""
    if len(h) < window:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, W.U)
    at = np.arange(len(h) - window + 1)
    text = np.searchsorted(bounds, at, "right") - 1
    inside = at + window <= bounds[text + 1]
    return text[inside], at[inside], _minima(h, window)[inside]


def scan(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, n_words, a 128-bit digest (d1, d2) of the words, and the distinct minima of the windows."""

    def task(batches):
        for batch in batches:
            names = batch.column(0)
            for first, block in W.text_blocks(batch.column(1)):
                found = W.split(block)
                h = found.hashes()
                text, _, m = _all_windows(h, found.bounds, window)
                if len(m):
                    new = np.r_[True, (m[1:] != m[:-1]) | (text[1:] != text[:-1])]  # neighbours mostly share theirs
                    text, m = text[new], m[new]
                    order = np.lexsort((m, text))
                    text, m = text[order], m[order]
                    new = np.r_[True, (m[1:] != m[:-1]) | (text[1:] != text[:-1])]
                    text, m = text[new], m[new]
                offsets = np.searchsorted(text, np.arange(len(block) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(m.view(np.int64)))
                yield pa.RecordBatch.from_arrays([names.slice(first, len(block)), pa.array(np.diff(found.bounds)), *map(pa.array, _digests(h, found.bounds)), lists], ["doc_id", "n_words", "d1", "d2", "minima"])

    return docs.mapInArrow(task, "doc_id long, n_words long, d1 long, d2 long, minima array<long>")


def _repeated(minima: DataFrame, cells: int, depth: int) -> DataFrame:
    """The rows (doc_id, d1, m) whose count, as the sketch has it, is over one."""
    for row in range(depth):
        minima = minima.withColumn("cell", F.pmod(F.xxhash64(F.lit(row), "m"), F.lit(cells)))
        full = cut(minima.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        minima = join_hot(minima, full, ["cell"], [F.col("doc_id"), F.col("d1")], PART).select("doc_id", "d1", "m")
    return minima


def _windows(texts: DataFrame, window: int) -> DataFrame:
    """128-bit hashes of the windows whose minimum is among the document's repeated ones.

    ``place`` is the window's start with 32 bits of the text's digest above it, which
    keep texts apart that share a doc_id.
    """

    def task(batches):
        for batch in batches:
            names, texts_, hot = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2)
            for first, block in W.blocks(texts_, W.BLOCK // 4):
                found = W.split(block)
                h = found.hashes()
                text, at, m = _all_windows(h, found.bounds, window)
                wanted = hot.slice(first, len(block))
                owner = np.repeat(np.arange(len(block), dtype=np.uint64), np.diff(wanted.offsets.to_numpy()))
                pairs = W.mix(wanted.flatten().to_numpy().view(np.uint64) + owner)
                keep = np.isin(W.mix(m + text.astype(np.uint64)), pairs)  # a chance match only adds a window to the exact pass
                text, at = text[keep], at[keep]
                tag = _digests(h, found.bounds)[0] & 0x7FFFFFFF
                ends = at + window
                h1, h2 = W.mix(W.rolling(h, at, ends, SECOND)), W.mix(W.rolling(W.mix(h), at, ends, SECOND + 2))
                place = (at - found.bounds[text]) + (tag[text] << 32)
                yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(names[first + text]), pa.array(place)], ["h1", "h2", "doc_id", "place"])

    return texts.mapInArrow(task, "h1 long, h2 long, doc_id long, place long")


def covered(docs: DataFrame, window: int = WINDOW, cells: int = CELLS, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """What is to be removed from ``docs`` (doc_id long, text).

    Returns two tables: doc_id, tag and starts (the repeated windows of that text), and
    the checkpointed scan with ``copy``, true where the whole text, of a window or more,
    is that of a smaller doc_id.
    """
    seen = cut(scan(docs, window))
    long_ = seen.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    # Copies of a whole text need no windows: all of them start in the first copy too.
    classes = cut(long_.groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    copied = classes.where("n > 1").select("d1", "d2", "first")
    flagged = seen.join(copied, ["d1", "d2"], "left").select("doc_id", "n_words", "d1", "minima", (F.col("first").isNotNull() & (F.col("n_words") >= window) & (F.col("first") < F.col("doc_id"))).alias("copy"))
    flagged = cut(flagged)
    firsts = flagged.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull() & ~F.col("copy"))
    minima = firsts.select("doc_id", "d1", F.explode("minima").alias("m"))
    n = firsts.agg(F.sum(F.size("minima"))).first()[0] or 0
    hot = cut(_repeated(minima, max(1024, cells * n), depth).groupBy("doc_id", "d1").agg(F.collect_list("m").alias("hot")))  # of one text at most
    ids = few(hot.select("doc_id").distinct())
    texts = stored(docs.join(ids, "doc_id", "left_semi").join(hot.groupBy("doc_id").agg(F.flatten(F.collect_list("hot")).alias("hot")), "doc_id").select("doc_id", "text", "hot"))
    windows = _windows(texts, window)
    first = cut(windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("n")).where("least < most").select("h1", "h2", "least", "n"))
    later = join_hot(windows, first, ["h1", "h2"], [F.col("doc_id"), F.col("place")], PART).where(F.col("doc_id") > F.col("least"))
    starts = later.groupBy("doc_id", F.shiftright("place", 32).alias("tag")).agg(F.collect_set(F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")).alias("starts"))
    return starts, flagged.select("doc_id", "n_words", "d1", "copy")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, kept (the words left, joined by one space), rest.

    ``rest`` is a struct of the columns named in ``carry`` (of the doc_id, if none).

    Every word covered by a window whose words also start in a document with a smaller
    doc_id goes; windows are judged on the input.  Null and empty texts have no words.
    Rows with a null doc_id neither lose nor cause anything.  Repeated rows are of one
    document and do not remove each other.  Only texts with repeated windows move, to
    meet their windows; ids are broadcast if they are few, after a count.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.struct(*(carry or (doc_id,))).alias("rest"))
    starts, seen = covered(rows.select("doc_id", "text"), window)
    starts = cut(starts)
    copies = seen.where("copy").select("doc_id", F.col("d1").bitwiseAND(F.lit(0x7FFFFFFF)).alias("tag"), F.lit(None).cast("array<int>").alias("starts"), F.lit(True).alias("copy")).distinct()
    changes = cut(starts.withColumn("copy", F.lit(False)).unionByName(copies).groupBy("doc_id").agg(F.collect_list(F.struct("tag", "starts", "copy")).alias("changes")))
    ids = few(changes.select("doc_id"))
    same = rows.join(ids, "doc_id", "left_anti").select("doc_id", "text", "rest").withColumn("changes", F.lit(None).cast(changes.schema["changes"].dataType))
    changed = rows.join(ids, "doc_id", "left_semi").join(changes, "doc_id").select("doc_id", "text", "changes", "rest")

    def task(batches):
        for batch in batches:
            names, all_changes = batch.column(0), batch.column(2)
            for first, block in W.text_blocks(batch.column(1)):
                found = W.split(block)
                some = all_changes.slice(first, len(block)).null_count < len(block)
                tags = _digests(found.hashes(), found.bounds)[0] & 0x7FFFFFFF if some else None
                counts, removed, kept = [], [], []
                for i in range(len(block)):
                    words, change = block[i].split(), all_changes[first + i]
                    gone = _gone(change, int(tags[i]), len(words), window) if change.is_valid else None
                    counts.append(len(words))
                    removed.append(0 if gone is None else int(gone.sum()))
                    kept.append(b" ".join(words if gone is None else [words[j] for j in np.flatnonzero(~gone)]))
                yield pa.RecordBatch.from_arrays([names.slice(first, len(block)), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), batch.column(3).slice(first, len(block))], ["doc_id", "n_words", "n_removed", "kept", "rest"])

    schema = T.StructType([*(T.StructField(n, k) for n, k in (("doc_id", T.LongType()), ("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept", T.StringType()))), T.StructField("rest", rows.schema["rest"].dataType)])
    return same.unionByName(changed).select("doc_id", "text", "changes", "rest").mapInArrow(task, schema)


def _gone(changes: pa.Scalar, tag: int, n: int, window: int) -> np.ndarray:
    """Which of a text's ``n`` words are covered."""
    edge = np.zeros(n + 1, np.int64)
    for change in changes.values:
        if change["tag"].as_py() == tag:
            if change["copy"].as_py():
                return np.ones(n, bool)
            at = change["starts"].values.to_numpy(zero_copy_only=False)
            edge[at] += 1
            edge[at + window] -= 1
    return np.cumsum(edge[:-1]) > 0


def digest(report: DataFrame) -> DataFrame:
    """``remove_repeats`` with the kept words as a digest."""
    return report.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the repeated words taken from ``text``; n_chars, if there, follows.

    A text that loses nothing stays as it is, white space included.
    """
    out = remove_repeats(docs, window=window, carry=tuple(docs.columns))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("rest.text"))
    new = {"text": text} | ({"n_chars": F.char_length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*(new.get(c, F.col("rest")[c]).alias(c) for c in docs.columns))
