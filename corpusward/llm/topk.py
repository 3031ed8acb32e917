"""Exact top-k search by distributed histogram selection.

A block of queries is scored against every row.  Each pass counts, for every query,
how many scores fall into each bin of its current range; the global counts locate
the bin that holds the k-th value, which becomes the next range, until the range is
one value.  Then rows above it are taken and ties at it are broken by id.  No score
matrix is stored or shuffled: only histograms and the rows that are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusward.functions.lineage import cut

BINS = 256
#: Numbers in one broadcast block of queries (8 bytes each: 8 MB); a block has at least one query.
BLOCK_NUMBERS = 1_000_000
#: Queries in a block at most: the driver sees BINS numbers for each in a pass.
BLOCK_QUERIES = 4096
#: Scores that a task holds at once (8 bytes each).
TILE = 2_000_000


def integer_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id and the vector as longs floor(scale * x).

    Null vectors, and vectors with a null or non-finite component, are left out, as are
    those with a component that a long cannot hold and rows without an id.  Scores are
    longs: inner products beyond 2**63 do not fit and wrap.
    """
    x = F.col(vector).cast("array<double>")
    kept = df.where(x.isNotNull() & F.col(vec_id).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(2.0**62 / scale))))
    return kept.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale)).alias("v"))


def _by_dimension(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and matrices of a batch's vectors, one pair for each dimension."""
    ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        yield ids[at], flat[(starts[at][:, None] + np.arange(dim)[None, :]).ravel()].reshape(len(at), dim)


class _Block:
    """Queries of one block, by dimension; sent to the tasks."""

    def __init__(self, rows):
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.parts = {}
        for dim in {len(r[1]) for r in rows}:
            at = [i for i, r in enumerate(rows) if len(r[1]) == dim]
            self.parts[dim] = (np.array(at, np.int64), np.array([rows[i][1] for i in at], np.int64).reshape(len(at), dim))

    def tiles(self, batches) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query numbers, row ids, scores [query, row]) for all rows that have a query of their dimension."""
        for batch in batches:
            for ids, rows in _by_dimension(batch):
                if rows.shape[1] not in self.parts:
                    continue
                at, queries = self.parts[rows.shape[1]]
                # Products of doubles are exact while every partial sum stays below 2**53.
                most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, rows.shape[1])
                kind = np.float64 if most < 2.0**53 else np.int64
                for i in range(0, len(at), 2048):
                    q = queries[i : i + 2048].astype(kind)
                    step = max(1, TILE // len(q))
                    for j in range(0, len(ids), step):
                        yield at[i : i + 2048], ids[j : j + step], (q @ rows[j : j + step].astype(kind).T).astype(np.int64)


def _histograms(vectors: DataFrame, block, low, high, width) -> DataFrame:
    """Counts of (query, bin) over all rows but a query's own; bin 0 is below the range, BINS + 1 above it."""

    def task(batches):
        b, lo, hi, w = block.value, low, high, width
        total = np.zeros((len(b.ids), BINS + 2), np.int64)
        for at, ids, scores in b.tiles(batches):
            bins = np.clip((scores - lo[at][:, None]) // w[at][:, None] + 1, 0, BINS + 1)
            bins[scores > hi[at][:, None]] = BINS + 1  # the last bins may reach beyond the range
            bins[b.ids[at][:, None] == ids[None, :]] = -1
            flat = bins + np.arange(len(at))[:, None] * (BINS + 2)
            total[at] += np.bincount(flat[bins >= 0], minlength=len(at) * (BINS + 2)).reshape(len(at), BINS + 2)
        q, k = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(k), pa.array(total[q, k])], ["q", "bin", "n"])

    return vectors.mapInArrow(task, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))


def _bounds(vectors: DataFrame, block) -> DataFrame:
    """Least and largest score, and the number of scores, of each query."""

    def task(batches):
        b, most = block.value, np.iinfo(np.int64)
        lo, hi, n = np.full(len(b.ids), most.max), np.full(len(b.ids), most.min), np.zeros(len(b.ids), np.int64)
        for at, ids, scores in b.tiles(batches):
            own = b.ids[at][:, None] == ids[None, :]
            lo[at] = np.minimum(lo[at], np.where(own, most.max, scores).min(1, initial=most.max))
            hi[at] = np.maximum(hi[at], np.where(own, most.min, scores).max(1, initial=most.min))
            n[at] += (~own).sum(1)
        q = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(lo[q]), pa.array(hi[q]), pa.array(n[q])], ["q", "lo", "hi", "n"])

    return vectors.mapInArrow(task, "q long, lo long, hi long, n long").groupBy("q").agg(F.min("lo"), F.max("hi"), F.sum("n"))


def _select(vectors: DataFrame, block, kth: np.ndarray, k: int) -> DataFrame:
    """Rows above the k-th value and, from each task, the k smallest ids at it."""

    def task(batches):
        b = block.value
        ties = np.empty((0, 2), np.int64)  # (query, id) at the k-th value, the k smallest of each query so far
        for at, ids, scores in b.tiles(batches):
            own = b.ids[at][:, None] == ids[None, :]
            q, r = np.nonzero((scores > kth[at][:, None]) & ~own)
            yield pa.RecordBatch.from_arrays([pa.array(at[q]), pa.array(ids[r]), pa.array(scores[q, r])], ["q", "vec_id", "score"])
            q, r = np.nonzero((scores == kth[at][:, None]) & ~own)
            ties = np.concatenate([ties, np.stack([at[q], ids[r]], 1)])
            if len(ties) > 4 * k * len(b.ids):
                ties = _smallest(ties, k)
        ties = _smallest(ties, k)
        yield pa.RecordBatch.from_arrays([pa.array(ties[:, 0]), pa.array(ties[:, 1]), pa.array(kth[ties[:, 0]])], ["q", "vec_id", "score"])

    return vectors.mapInArrow(task, "q long, vec_id long, score long")


def _smallest(ties: np.ndarray, k: int) -> np.ndarray:
    ties = ties[np.lexsort((ties[:, 1], ties[:, 0]))]
    if not len(ties):
        return ties
    new = np.r_[True, ties[1:, 0] != ties[:-1, 0]]
    first = np.maximum.accumulate(np.where(new, np.arange(len(ties)), 0))
    return ties[np.arange(len(ties)) - first < k]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block_numbers: int = BLOCK_NUMBERS) -> DataFrame:
    """The ``k`` rows of the largest integer inner product with each query.

    Both inputs have vec_id long and v array<long> (see ``integer_vectors``).  Returns
    query_id, rank (from 1), vec_id, score; fewer rows where fewer candidates exist.
    A query's own id is no candidate.  Ties go to the smaller id.  Repeated rows are
    candidates of their own; a repeated query (same id and vector) is asked once.
    Vectors meet only queries of their own dimension.  Empty inputs give no rows.

    Queries are dealt by hash into blocks of about ``block_numbers`` numbers and
    BLOCK_QUERIES queries; the driver sees one block, and at most BINS counts for each of
    its queries, at a time, as columns.
    """
    spark = vectors.sparkSession
    queries = cut(queries.distinct())
    numbers = queries.agg(F.count(F.lit(1)), F.sum(F.size("v") + 1)).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not numbers[0]:
        return spark.createDataFrame([], schema)
    blocks = max(-(-numbers[1] // block_numbers), -(-numbers[0] // BLOCK_QUERIES))
    done = []
    for i in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == i).collect()
        if rows:
            done.append(_block_top(vectors, rows, k))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("query_id", "rank", "vec_id", "score")


def _block_top(vectors: DataFrame, rows: list, k: int) -> DataFrame:
    spark = vectors.sparkSession
    # At most one block of queries, whose size the caller has bounded.
    block = spark.sparkContext.broadcast(_Block(rows))
    low, high, n = (np.zeros(len(rows), np.int64) for _ in range(3))
    q, *bounds = (c.to_numpy() for c in _bounds(vectors, block).toArrow().columns)
    low[q], high[q], n[q] = bounds
    need = np.minimum(k, n)  # the rank, from above, of the value that is sought within [low, high]
    open_ = (n > 0) & (low < high)
    while open_.any():
        # Python integers: the span of two longs may not fit one.
        width = np.array([max(1, -(-(int(h) - int(lo) + 1) // BINS)) for lo, h in zip(low, high, strict=True)], np.int64)
        seen = np.zeros((len(rows), BINS + 2), np.int64)
        # BINS rows for each query of one block at most.
        q, b, c = (x.to_numpy() for x in _histograms(vectors, block, low, high, width).where(F.col("bin").between(1, BINS)).toArrow().columns)
        seen[q, b] = c
        for q in np.flatnonzero(open_):
            above = np.cumsum(seen[q, ::-1])[::-1]  # scores in this bin or a higher one
            b = int(np.flatnonzero(above >= need[q]).max())
            need[q] -= above[b + 1] if b < BINS + 1 else 0
            high[q] = min(int(high[q]), int(low[q]) + b * int(width[q]) - 1)
            low[q] = int(low[q]) + (b - 1) * int(width[q])
        open_ &= low < high
    found = _select(vectors, block, low, k)
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    names = spark.createDataFrame([(i, int(r[0])) for i, r in enumerate(rows)], "q long, query_id long")  # one block
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(F.broadcast(names), "q")
