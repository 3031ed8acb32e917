"""The prefix trie of conversations, from neighbours in sorted order.

Conversations are sequences of turns, each a 128-bit digest and a number of code points.
Sorted, those that start alike lie next to each other, and the trie is given by the length
of the common prefix (LCP) of each two neighbours.  Every partition joins its conversations
along these edges in descending depth with union-find: a merge at depth d makes a node of
depth d with children, or gives the one that is there another child; the single chains
between such nodes need no work of their own.

A node that reaches over the end of a partition is open there: it lies on the path to the
partition's first or last conversation, no deeper than the LCP with the neighbour.  Every
partition contracts what lies below its open nodes to sums, and open nodes are merged by
the digest of their prefix; there are as many as partitions, times their depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusward.functions.lineage import cut, stored
from corpusward.llm.skew import few

#: Bytes of decimal ids in one row where a node's ends lie in several partitions.
CHUNK = 1 << 16
_NOTHING = hashlib.sha256(b"").hexdigest()


def rebuilt(conversations: DataFrame, block: int = 100, shared: int = 6) -> DataFrame:
    """conv_id, digests and chars: the turns of every conversation, the first ones taken from its block's first conversation.

    The first h turns, h = crc32(conv_id in decimal) % ``shared``, are those of conversation
    conv_id - conv_id % ``block`` (fewer if it has fewer, none if it is absent); the rest are
    its own after its first h.  Turns are ordered by ``turn`` (null first), then role,
    then the digest of role and text; repeated rows are turns of their own.  Rows without a conv_id take
    no part; null roles and texts are empty.
    """
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "digest", "chars")))
    own = rows.select("conv_id", "turn", "role", digest.alias("digest"), F.length("text").alias("chars")).groupBy("conv_id").agg(turns.alias("turns"))
    base = own.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, shared - 1).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).cast("int")
    both = own.withColumn("h", h).join(base, F.col("conv_id") - F.col("conv_id") % block == F.col("base"), "left")
    head = F.when(F.col("base").isNotNull(), F.slice("first", F.lit(1), F.col("h"))).otherwise(F.slice("turns", 1, 0))
    whole = F.concat(head, F.slice("turns", F.col("h") + 1, F.size("turns")))
    return both.select("conv_id", whole.alias("turns")).select("conv_id", F.col("turns.digest").alias("digests"), F.col("turns.chars").alias("chars"))


# ---------------------------------------------------------------- one partition


@dataclass
class _Paths:
    """Distinct sequences of a partition in order, with the conversations that have each."""

    lengths: list[int] = field(default_factory=list)
    lcps: list[int] = field(default_factory=list)  # with the sequence before; 0 for the first
    bounds: list[int] = field(default_factory=list)  # in ids
    ids: list[np.ndarray] = field(default_factory=list)
    sums: list[np.ndarray] = field(default_factory=list)  # code points of the first 0, 1, ... turns
    first: bytes = b""
    last: bytes = b""
    part: int = 0


def _digests(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The digests of a list column as rows of two 64-bit numbers, and where each list starts."""
    values = column.flatten()
    data = np.frombuffer(b"".join(values.to_pylist()), np.uint64).reshape(-1, 2)
    return data, np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


def _common(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many rows from a[i] on equal those from b[i] on, up to most[i]."""
    out = np.zeros(len(a), np.int64)
    open_ = np.flatnonzero(most > 0)
    depth = 0
    while len(open_):
        same = (data[a[open_] + depth] == data[b[open_] + depth]).all(1)
        open_ = open_[same]
        depth += 1
        out[open_] = depth
        open_ = open_[most[open_] > depth]
    return out


def _read(batches: Iterable[pa.RecordBatch]) -> _Paths:
    paths, before, n = _Paths(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        part, conv, digests, chars = batch.columns
        paths.part = part[0].as_py()
        data, starts = _digests(digests)
        if before is not None:
            data, starts = np.concatenate([before, data]), np.concatenate([[0], starts + len(before)])
            same_from = 1
        else:
            same_from = 0
            paths.first = data[starts[0] : starts[1]].tobytes()
        sizes = np.diff(starts)
        common = _common(data, starts[:-2], starts[1:-1], np.minimum(sizes[:-1], sizes[1:]))
        if not same_from:
            common = np.concatenate([[-1], common])
        sizes = sizes[same_from:]
        previous = np.concatenate([[len(before) if before is not None else -1], sizes[:-1]])
        new = np.flatnonzero((common < 0) | (common < sizes) | (common < previous))
        points = chars.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        for i in new.tolist():
            paths.lengths.append(int(sizes[i]))
            paths.lcps.append(max(0, int(common[i])))
            paths.bounds.append(n + i)
            paths.sums.append(np.concatenate([[0], np.cumsum(points[edges[i] : edges[i + 1]])]))
        paths.ids.append(conv.to_numpy(zero_copy_only=False))
        n += batch.num_rows
        before = data[starts[-2] : starts[-1]]
    if before is not None:
        paths.last = before.tobytes()
        paths.bounds.append(n)
    return paths


@dataclass
class _Forest:
    """The trie of one partition: columns of closed nodes, and rows of open ones."""

    paths: _Paths
    left: int
    right: int

    def __post_init__(self):
        self.closed: list[tuple] = []
        self.open: list[tuple] = []
        self.ends: list[tuple] = []
        self.keys = [_keys(self.paths.first, self.left), _keys(self.paths.last, self.right)]
        self._grow()

    def _grow(self) -> None:
        p = self.paths
        m = len(p.lengths)
        self.ids = np.concatenate(p.ids)
        starts = np.array(p.bounds[:-1])
        self.n = np.diff(p.bounds).tolist()
        self.low = self.ids[starts].tolist()  # conversations of one sequence are in order
        self.top, self.kids, self.any_kids = list(p.lengths), [0] * m, [0] * m
        self.leaves, self.saved, self.end = [0] * m, [0] * m, list(range(1, m + 1))
        self.waiting: list[list] = [[] for _ in range(m)]
        parent = list(range(m))

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        lcps = np.array(p.lcps[1:], np.int64)
        for k in np.argsort(-lcps, kind="stable").tolist():
            depth, a, b = int(lcps[k]), find(k), k + 1
            if self.top[a] > depth:
                self._branch(a, depth)
            closed, record = self._close(b, depth)
            self.n[a] += self.n[b]
            self.low[a] = min(self.low[a], self.low[b])
            self.leaves[a] += self.leaves[b]
            self.saved[a] += self.saved[b]
            self.kids[a] += closed
            self.any_kids[a] += 1
            self.waiting[a].append(record)
            self.end[a] = self.end[b]
            parent[b] = a
        if self.top[0] > 0:
            self._branch(0, 0)
        self._close(0, -1)
        shown = {(side, depth) for side, depth, *_ in self.open}
        for depth in range(self.right + 1):
            if (1, depth) not in shown:
                self.open.append((1, depth, self.keys[1][depth], 0, None, 0, 0, 0, 0))

    def _branch(self, a: int, depth: int) -> None:
        """A new node at ``depth`` above the top of component ``a``."""
        closed, record = self._close(a, depth)
        self.top[a], self.kids[a], self.any_kids[a], self.waiting[a] = depth, int(closed), 1, [record]

    def _close(self, x: int, depth: int) -> tuple[bool, list]:
        """Write the chain from the top of component ``x`` up to ``depth`` + 1.

        Returns whether its uppermost node is closed, and what is to know of its parent.
        """
        hi, n, low, sums = self.top[x], self.n[x], self.low[x], self.paths.sums[x]
        limit = max(self.left if x == 0 else -1, self.right if self.end[x] == len(self.paths.lengths) else -1)
        cut_ = max(depth, limit)  # closed nodes are deeper
        above = [None, None]  # of the uppermost closed node, if it is deeper than ``depth`` + 1 or its parent is open
        ended = x if self.paths.lengths[x] == hi else None
        leaf = not self.any_kids[x]
        side = lambda d: 0 if x == 0 and d <= self.left else 1
        here = (low, None) if hi > limit else (None, self.keys[side(hi)][hi])
        for record in self.waiting[x]:
            record[:] = here
        if hi > cut_:
            self.leaves[x] += leaf
            below = self.saved[x]
            self.closed.append((low, cut_, hi, n, self.kids[x], self.leaves[x], below, sums, above, self._hash(ended)))
            self.saved[x] = below + (n - 1) * int(sums[hi] - sums[max(cut_, 0)])
            if cut_ > depth:
                above[:] = (None, self.keys[side(cut_)][cut_])
        for d in range(min(limit, hi), depth, -1):
            kids = self.kids[x] if d == hi else int(d == limit)
            self.open.append((side(d), d, self.keys[side(d)][d], n, low, int(sums[d] - sums[d - 1]) if d else 0, kids, self.leaves[x], self.saved[x]))
            if d == hi and ended is not None:
                self._chunks(self.keys[side(d)][d], ended)
        return depth + 1 > limit, above if cut_ == depth else [None, None]

    def _run(self, x: int) -> np.ndarray:
        return self.ids[self.paths.bounds[x] : self.paths.bounds[x + 1]]

    def _hash(self, x: int | None) -> str | None:
        return None if x is None else hashlib.sha256(",".join(map(str, self._run(x).tolist())).encode()).hexdigest()

    def _chunks(self, key: bytes, x: int) -> None:
        run = self._run(x)
        each = CHUNK // 20
        self.ends += [(key, i, ",".join(map(str, run[i : i + each].tolist())).encode()) for i in range(0, len(run), each)]


def _keys(path: bytes, depth: int) -> list[bytes]:
    """Digests of the first 0 to ``depth`` turns."""
    hashed, out = hashlib.sha256(), []
    for d in range(depth + 1):
        hashed.update(path[16 * (d - 1) : 16 * d] if d else b"")
        out.append(hashed.digest())
    return out


_ROWS = "kind int, conv_id long, depth long, parent long, parent_key binary, n long, kids long, leaves long, saved long, ends string, part int, side int, key binary, chars long, seq long, data binary"
_NAMES = [x.split()[0] for x in _ROWS.split(", ")]


def _rows(size: int, /, **columns) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    types = [kinds[x.split()[1]] for x in _ROWS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in zip(_NAMES, types, strict=True)], _NAMES)


def _closed_rows(records: list[tuple]) -> pa.RecordBatch:
    """A row for each node of the chains, deepest first."""
    low, lo, hi, n, kids, leaves, below = (np.array(c, np.int64) for c in list(zip(*records, strict=True))[:7])
    size = hi - lo
    at = np.repeat(np.arange(len(records)), size)
    depth = hi[at] - (np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size))
    lowest, uppermost = depth == hi[at], depth == lo[at] + 1
    text = np.concatenate([s[h] - s[np.maximum(np.arange(h, a, -1) - 1, 0)] for (_, a, h, *_, s, _, _) in records])
    parent = low[at].astype(object)
    keys, ends = np.full(len(at), None, object), np.full(len(at), None, object)
    parent[uppermost], keys[uppermost] = [r[8][0] for r in records], [r[8][1] for r in records]
    ends[lowest] = [r[9] for r in records]
    return _rows(len(at), kind=np.zeros(len(at), np.int32), conv_id=low[at], depth=depth, parent=parent, parent_key=keys, n=n[at], kids=np.where(lowest, kids[at], 1), leaves=leaves[at], saved=below[at] + (n[at] - 1) * text, ends=ends)


def _forest_rows(forest: _Forest) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(forest.closed), 5000):
        yield _closed_rows(forest.closed[i : i + 5000])
    part = forest.paths.part
    if forest.open:
        side, depth, key, n, low, chars, kids, leaves, saved = zip(*forest.open, strict=True)
        size = len(side)
        yield _rows(size, kind=np.full(size, 1, np.int32), part=np.full(size, part, np.int32), side=np.array(side, np.int32), depth=depth, key=key, n=n, conv_id=low, chars=chars, kids=kids, leaves=leaves, saved=saved)
    for key, seq, data in forest.ends:
        yield _rows(1, kind=[2], key=[key], part=[part], seq=[seq], data=[data])


# ---------------------------------------------------------------- all partitions


def _overlaps(ordered: DataFrame) -> dict[int, tuple[int, int]]:
    """For each partition that has rows, the LCP with the one before and the one after; -1 at the ends.

    The driver sees one number for each partition.
    """

    def ends(batches):
        part = first = last = None
        for batch in batches:
            if batch.num_rows:
                part, last = batch.column(0)[0].as_py(), batch.column(1)[batch.num_rows - 1].as_py()
                first = batch.column(1)[0].as_py() if first is None else first
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first], pa.list_(pa.binary())), pa.array([last], pa.list_(pa.binary()))], ["part", "first", "last"])

    def compare(batches):
        for batch in batches:
            found = []
            for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) if b is not None else -1  # noqa: B905
                found.append(same)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["part", "lcp"])

    edges = ordered.select("part", "digests").mapInArrow(ends, "part int, first array<binary>, last array<binary>")
    after = edges.select("part", "last", F.lead("first").over(Window.orderBy("part")).alias("next"))  # a row for each partition
    found = sorted(map(tuple, after.mapInArrow(compare, "part int, lcp long").collect()))
    before = [-1, *(lcp for _, lcp in found)]
    return {part: (left, right) for (part, right), left in zip(found, before, strict=False)}


def _merged(rows: DataFrame) -> DataFrame:
    """Open nodes of all partitions: key, conv_id, depth, parent_key, n, kids, leaves, saved."""
    spine = Window.partitionBy("part", "side").orderBy("depth")
    open_ = cut(rows.where("kind = 1").select("part", "side", "depth", "key", "n", "conv_id", "chars", "kids", "leaves", "saved", F.lag("key").over(spine).alias("parent_key")))
    nodes = open_.groupBy("key").agg(
        F.min("depth").alias("depth"), F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars"), F.sum("kids").alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"),
        F.min(F.struct("part", "side")).alias("owner"), F.first("parent_key", ignorenulls=True).alias("parent_key"),
    )
    children = nodes.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("more"))
    nodes = nodes.join(children, "key", "left").withColumn("kids", F.col("kids") + F.coalesce("more", F.lit(0))).withColumn("own_saved", (F.col("n") - 1) * F.col("chars")).withColumn("own_leaf", (F.col("kids") == 0).cast("long"))
    nodes = cut(nodes.drop("more", "chars"))
    # An open node counts in one partition, and there for every open node above it.
    own = open_.select("part", "side", "depth", "key").join(nodes.select("key", "owner", "own_saved", "own_leaf"), "key")
    mine = (F.col("owner.part") == F.col("part")) & (F.col("owner.side") == F.col("side"))
    upward = Window.partitionBy("part", "side").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    below = own.select("key", F.sum(F.when(mine, F.col("own_saved")).otherwise(0)).over(upward).alias("s"), F.sum(F.when(mine, F.col("own_leaf")).otherwise(0)).over(upward).alias("l"))
    totals = below.groupBy("key").agg(F.sum("s").alias("s"), F.sum("l").alias("l"))
    return cut(nodes.join(totals, "key").select("key", "conv_id", "depth", "parent_key", "n", "kids", (F.col("leaves") + F.col("l")).alias("leaves"), (F.col("saved") + F.col("s")).alias("saved")))


def _hashes(rows: DataFrame) -> DataFrame:
    """key and ends: the digest of an open node's ids, read in order as a stream."""

    def task(batches):
        key, hashed, out = None, None, []
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key:
                    if key is not None:
                        out.append((key, hashed.hexdigest()))
                    key, hashed = k, hashlib.sha256(data)
                else:
                    hashed.update(b"," + data)
        if key is not None:
            out.append((key, hashed.hexdigest()))
        keys, ends = zip(*out, strict=True) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ends, pa.string())], ["key", "ends"])

    chunks = rows.where("kind = 2").select("key", "data", "part", "seq")
    return chunks.repartition("key").sortWithinPartitions("key", "part", "seq").select("key", "data").mapInArrow(task, "key binary, ends string")


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """Every node of the trie of ``sequences`` (conv_id, digests, chars; as ``rebuilt`` gives them).

    Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256, a row for each distinct prefix, the empty one included.
    Conversations of equal turns end in one node; one without turns is a member of the root
    alone; an empty table gives no rows.

    A conversation's digests (16 bytes a turn) are one row; a task holds the distinct
    sequences of its partition.  Copies of one sequence are dealt over partitions by
    conv_id.  Only the ids that end in one open node meet in one task, CHUNK bytes at a
    time, since their digest is sequential.
    """
    order = ["digests", "conv_id"]
    ordered = cut(sequences.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "conv_id", "digests", "chars"))
    overlaps = ordered.sparkSession.sparkContext.broadcast(_overlaps(ordered))

    def task(batches):
        paths = _read(batches)
        if paths.bounds:
            yield from _forest_rows(_Forest(paths, *overlaps.value[paths.part]))

    rows = stored(ordered.mapInArrow(task, _ROWS))
    open_ = few(_merged(rows))
    parents = open_.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("open_parent"))
    columns = [F.col("conv_id"), F.col("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(_NOTHING)).alias("ends_sha256")]
    closed = rows.where("kind = 0").join(parents, "parent_key", "left").withColumn("parent", F.coalesce("parent", "open_parent")).select(*columns)
    shared = open_.join(_hashes(rows), "key", "left").join(parents, "parent_key", "left").withColumn("parent", F.col("open_parent")).select(*columns)
    return closed.unionByName(shared)
