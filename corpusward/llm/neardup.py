"""Near-duplicate documents by a multi-index Hamming join over b-bit MinHash signatures.

A signature has 32 indexed symbols of 16 bits in 8 chunks.  By the pigeonhole
principle two signatures that differ in at most 15 symbols have a chunk with at most
one error; so each chunk is indexed under its four patterns with one symbol left out,
and every pair within that distance shares an index key.  At a similarity of 0.85 a
chunk has at most one error with probability 0.89, and all eight fail with 2e-8 (1e-6 at
0.8); 64 symbols in all then drop pairs that differ in more symbols than pairs at the
threshold do but once in a million.  What is left is confirmed on the full shingle sets.

The links that signatures miss are found by an exact join of the sets' prefixes: in any
order of shingles that is the same for all sets, two sets at the threshold share one of
their first n - ceil(t * n) + 1.  Rare shingles come first, by a bounded sample, which
decides the cost and not the result.  Only pairs of different components are made.

Only links that can change the components are looked for.  Documents of equal sets are
one node.  Each key's documents first meet its centre, the one that shares most keys
with others.  Documents with a common centre that are still apart meet each other in
tiles, so that a large group is spread over tasks: first by signature, which leaves the
documents with a near one, then with their sets, which gives links.  Pairs are made and
judged inside a task and never listed.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusward.functions.lineage import cut
from corpusward.llm import words as W
from corpusward.llm.graph import components
from corpusward.llm.skew import few, join_hot

SYMBOLS, CHUNK, INDEXED = 64, 4, 32
#: Documents, and shingles, of one centre in a tile; a task compares two tiles with each other.
TILE, TILE_SHINGLES = 512, 1_000_000
#: Parts over which the documents that meet one centre are dealt.
PARTS = 1024
#: Documents, about, and shingles of the sample that says which shingles are common.
SAMPLE, COMMON = 8_192, 1 << 18


def most_apart(percent: int) -> int:
    """The symbols, of SYMBOLS, in which a pair at the threshold differs at most, but once in a million."""
    p, tail = 1 - percent / 100, 1.0
    for k in range(SYMBOLS + 1):
        tail -= comb(SYMBOLS, k) * p**k * (1 - p) ** (SYMBOLS - k)
        if tail < 1e-6:
            return k
    return SYMBOLS


_FACTORS = W.numbers(SYMBOLS, 101) | W.U(1)
_TERMS = W.numbers(SYMBOLS, 202)


def _shingles(block: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text side by side, the text of each, and where each text's start.

    A text with fewer words than ``size`` has its whole sequence as one shingle.
    """
    found = W.split([W.lower(b) for b in block])
    h, bounds = found.hashes(), found.bounds
    n = np.diff(bounds)
    at = np.arange(len(h))
    text = np.repeat(np.arange(len(block)), n)
    ends = np.minimum(at + size, bounds[text + 1])
    whole = (ends - at == size) | ((n[text] < size) & (at == bounds[text]))
    at, ends, text = at[whole], ends[whole], text[whole]
    # The number of words keeps a short sequence apart from a shingle that starts alike.
    x = W.mix(W.rolling(h, at, ends) + (ends - at).astype(W.U))
    order = np.lexsort((x, text))
    x, text = x[order], text[order]
    new = np.r_[True, (x[1:] != x[:-1]) | (text[1:] != text[:-1])] if len(x) else np.empty(0, bool)
    x, text = x[new], text[new]
    return x, text, np.searchsorted(text, np.arange(len(block) + 1))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set (d1, d2) and the signature; null for an empty set."""

    def task(batches):
        for batch in batches:
            names = batch.column(0)
            for first, block in W.text_blocks(batch.column(1)):
                x, _, edges = _shingles(block, size)
                n = np.diff(edges)
                full = np.flatnonzero(n)
                starts = edges[:-1][full]
                sums = np.zeros((2, len(block)), np.uint64)
                symbols = np.zeros((len(block), SYMBOLS), "<u2")
                if len(full):
                    for k, v in enumerate((W.mix(x), W.mix(x ^ W.U(0x5851F42D4C957F2D)))):
                        sums[k, full] = np.add.reduceat(v, starts)
                    for k in range(SYMBOLS):
                        # low bits of the smallest value, spread again: the high ones are small
                        symbols[full, k] = W.mix(np.minimum.reduceat(x * _FACTORS[k] + _TERMS[k], starts)) & W.U(0xFFFF)
                yield pa.RecordBatch.from_arrays(
                    [names.slice(first, len(block)), pa.array(n), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array([s.tobytes() if k else None for s, k in zip(symbols, n, strict=True)], pa.binary())],
                    ["doc_id", "n_shingles", "d1", "d2", "signature"],
                )

    return docs.mapInArrow(task, "doc_id long, n_shingles long, d1 long, d2 long, signature binary")


def _symbols(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), SYMBOLS)


def index_keys(nodes: DataFrame) -> DataFrame:
    """(key, node): each chunk of the signature with each of its symbols left out."""

    def task(batches):
        for batch in batches:
            s = _symbols(batch.column(1)).astype(np.uint64)
            keys = []
            for chunk in range(INDEXED // CHUNK):
                for out in range(CHUNK):
                    rest = [s[:, chunk * CHUNK + i] for i in range(CHUNK) if i != out]
                    key = np.full(len(s), chunk * CHUNK + out, np.uint64)
                    for r in rest:
                        key = (key << W.U(16)) | r
                    keys.append(W.mix(key))
            width = len(keys)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, width * len(s) + 1, width, dtype=np.int32)), pa.array(np.stack(keys, 1).ravel().view(np.int64)))], ["node", "keys"])

    return nodes.select("node", "signature").mapInArrow(task, "node long, keys array<long>").select(F.explode("keys").alias("key"), "node")


def _near(pairs: DataFrame, apart: int) -> DataFrame:
    """Pairs (a, b) of ``pairs`` (a, b, sa, sb) whose signatures differ in few enough symbols."""

    def task(batches):
        for batch in batches:
            if batch.num_rows:
                near = (_symbols(batch.column(2)) != _symbols(batch.column(3))).sum(1) <= apart
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(near)) for i in range(2)], ["a", "b"])

    return pairs.select("a", "b", "sa", "sb").mapInArrow(task, "a long, b long")


def shingle_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """A checkpoint of (doc_id, shingles), sorted hashes, for the documents in ``ids``."""

    def task(batches):
        for batch in batches:
            names = batch.column(0)
            for first, block in W.text_blocks(batch.column(1)):
                x, _, edges = _shingles(block, size)
                x = (x ^ W.U(1 << 63)).view(np.int64)  # signed numbers in the order of the unsigned ones
                yield pa.RecordBatch.from_arrays([names.slice(first, len(block)), pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(x))], ["doc_id", "shingles"])

    return cut(docs.join(few(ids), "doc_id", "left_semi").mapInArrow(task, "doc_id long, shingles array<long>"))


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    The documents of one b are dealt over parts; its set goes once to each part and is
    held there while theirs stream past.
    """
    pairs = cut(pairs.distinct())
    sets = shingle_sets(docs, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), size)
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("a"), F.lit(PARTS)))
    centres = dealt.select("b", "part").distinct().join(sets, F.col("b") == F.col("doc_id")).withColumn("member", F.lit(False))
    members = dealt.join(sets, F.col("a") == F.col("doc_id")).withColumn("member", F.lit(True))
    met = centres.unionByName(members.drop("a")).repartition("b", "part").sortWithinPartitions("b", "part", "member")

    def compare(batches):
        at, held = None, []  # more than one set where texts share the doc_id
        for batch in batches:
            a, b = [], []
            for key, member, node, x in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                if key != at:
                    at, held = key, []
                x = x.values.to_numpy()
                if not member:
                    held.append(x.copy())
                elif any(_alike(x, y, percent) for y in held):
                    a.append(node)
                    b.append(key[0])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return met.select("b", "part", "member", "doc_id", "shingles").mapInArrow(compare, "a long, b long")


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted distinct numbers."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    place = np.searchsorted(y, x)
    both = int((y[np.minimum(place, len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _star_pairs(live: DataFrame) -> DataFrame:
    """Each document with the centres of its keys: (a, b) where b is a centre; a centre is with itself.

    Keys of many documents are dealt over parts by their numbers, which ``live`` holds.
    """
    shared = live.groupBy("node").agg(F.sum("n").alias("shared"))
    ranked = live.join(shared, "node")
    parts = F.ceil(F.col("n") / TILE).cast("int")
    centres = ranked.groupBy("key", "n").agg(F.max_by("node", F.struct("shared", -F.col("node"))).alias("centre")).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
    dealt = live.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int"))
    return dealt.join(centres, ["key", "part"]).select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()


def _dealt(rows: DataFrame, tiles) -> DataFrame:
    """``rows`` (centre, node, ...) as ``_tiled``, each next to its like and in one task."""
    return _together(_tiled(rows, tiles))


def _together(rows: DataFrame) -> DataFrame:
    return rows.repartition("centre", "low", "high").sortWithinPartitions("centre", "low", "high")


def _tiled(rows: DataFrame, tiles) -> DataFrame:
    """``rows`` (centre, node, ...) with (low, high): pairs of tiles.

    The documents of a centre are dealt over tiles by hash and each pair of tiles meets
    once, in a group that does not grow with the number of documents.
    """
    own = F.pmod(F.xxhash64("node"), tiles).cast("int")
    out = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), (tiles - 1).cast("int"))))
    return out.select("centre", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), *(c for c in rows.columns if c not in ("centre", "tiles")))


def _whole_groups(batches):
    """Batches that hold whole groups: rows of the last group wait for the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        group = _group(batch)
        change = np.flatnonzero((group[:, 1:] != group[:, :-1]).any(0)) + 1
        before = held[-2] if len(held) > 1 else None
        if before is not None and (_group(before.slice(before.num_rows - 1))[:, 0] != group[:, 0]).any():
            yield pa.concat_batches(held[:-1])
            held = held[-1:]
        if len(change):
            end = int(change[-1])
            yield pa.concat_batches([*held[:-1], batch.slice(0, end)])
            held = [batch.slice(end)]
    if held:
        yield pa.concat_batches(held)


def _group(table: pa.RecordBatch) -> np.ndarray:
    return np.stack([table.column(i).to_numpy() for i in range(3)])


def _near_in_groups(table: pa.RecordBatch, apart: int):
    """Pairs of rows of one group and different components whose signatures are near, a few at a time."""
    group, component, s = _group(table), table.column(4).to_numpy(), _symbols(table.column(5))
    live = np.arange(len(component))
    for d in range(1, len(component)):
        live = live[live + d < len(component)]
        live = live[(group[:, live] == group[:, live + d]).all(0)]
        if not len(live):
            return
        i = live[component[live] != component[live + d]]
        i = i[(s[i] != s[i + d]).sum(1) <= apart]
        if len(i):
            yield i, i + d


def _with_near_partner(rows: DataFrame, apart: int) -> DataFrame:
    """(centre, node) of the ``rows`` (centre, n, node, component, signature) with a near one in another component.

    Only documents come out, one row for each pair of tiles at most, never pairs.
    """

    def task(batches):
        for table in _whole_groups(batches):
            flag = np.zeros(table.num_rows, bool)
            for i, j in _near_in_groups(table, apart):
                flag[i] = flag[j] = True
            yield pa.RecordBatch.from_arrays([table.column(i).filter(pa.array(flag)) for i in (0, 3)], ["centre", "node"])

    tiles = F.ceil(F.col("n") / TILE)
    return _dealt(rows.withColumn("tiles", tiles).drop("n"), F.col("tiles")).mapInArrow(task, "centre long, node long").distinct()


def _links_in_tiles(rows: DataFrame, apart: int, percent: int) -> DataFrame:
    """Links (a, b) that join components, among ``rows`` (centre, tiles, node, component, signature, shingles).

    Near pairs are confirmed where they meet, on the full sets; a pair that links found
    so far have joined is left out, so a group gives fewer links than it has documents.
    """

    def task(batches):
        for table in _whole_groups(batches):
            node, component, sets = table.column(3).to_numpy(), table.column(4).to_numpy(), table.column(6)
            values, at = sets.flatten().to_numpy(), sets.offsets.to_numpy() - sets.offsets[0].as_py()
            up: dict[int, int] = {}

            def root(c, up=up):
                while c in up:
                    c = up[c]
                return c

            a, b = [], []
            for left, right in _near_in_groups(table, apart):
                for i, j in zip(left.tolist(), right.tolist(), strict=True):
                    p, q = root(component[i]), root(component[j])
                    if p == q:
                        continue
                    if _alike(values[at[i] : at[i + 1]], values[at[j] : at[j + 1]], percent):
                        up[max(p, q)] = min(p, q)
                        a.append(node[i])
                        b.append(node[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return _dealt(rows, F.col("tiles")).mapInArrow(task, "a long, b long")


def _residual_links(stars: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between documents that share a centre and are still in different components.

    Documents that share a key share its centre, so groups by centre miss no candidate.
    """
    apart = most_apart(percent)
    marks = classes.select("node", "signature")
    labelled = stars.where("a <> b").join(labels, stars["a"] == labels["node"], "left").select(F.col("b").alias("centre"), F.col("a").alias("node"), F.coalesce("component", "a").alias("component"))
    several = cut(labelled.groupBy("centre").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").select("centre", "n"))
    rest = cut(join_hot(labelled, several, ["centre"], [F.col("node")], TILE).join(marks, "node").select("centre", "n", "node", "component", "signature"))
    hot = cut(_with_near_partner(rest, apart))
    sets = shingle_sets(docs, hot.select(F.col("node").alias("doc_id")).distinct(), size)
    # Tiles hold a bounded number of documents and of shingles.
    weight = cut(hot.join(sets.select(F.col("doc_id").alias("node"), F.size("shingles").alias("k")), "node").groupBy("centre").agg(F.count(F.lit(1)).alias("n"), F.greatest(F.ceil(F.count(F.lit(1)) / TILE), F.ceil(F.sum("k") / TILE_SHINGLES)).alias("tiles")))
    full = join_hot(hot, weight, ["centre"], [F.col("node")], TILE).join(rest.select("centre", "node", "component", "signature"), ["centre", "node"]).join(sets.select(F.col("doc_id").alias("node"), "shingles"), "node")
    return _links_in_tiles(full.select("centre", "tiles", "node", "component", "signature", "shingles"), apart, percent)


def _shingle_rows(docs: DataFrame, size: int) -> DataFrame:
    """The distinct shingles of each text, one a row."""

    def task(batches):
        for batch in batches:
            for _, block in W.text_blocks(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(_shingles(block, size)[0].view(np.int64))], ["shingle"])

    return docs.select("text").mapInArrow(task, "shingle long")


def _common(docs: DataFrame, size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that occur twice or more in a sample of the ``n`` documents, sorted, and how often; the most frequent ones, up to COMMON."""
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // SAMPLE))) == 0)
    counts = _shingle_rows(sample, size).groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "shingle").limit(COMMON).toArrow()
    shingles = counts.column(0).to_numpy().view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], counts.column(1).to_numpy()[order]


def _sketch(shingles: np.ndarray) -> bytes:
    """Parities of the numbers of shingles by their low bits, half as many to as many bits as shingles.

    Two sets differ in as many shingles, at least, as their sketches differ in bits.
    """
    bits = max(64, 1 << (len(shingles).bit_length() - 1))
    odd = np.bincount((shingles & W.U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _bits_apart(x: bytes, y: bytes) -> int:
    """Bits in which two sketches differ, the longer one folded."""
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        half = len(x) // 2
        x = (int.from_bytes(x[:half], "little") ^ int.from_bytes(x[half:], "little")).to_bytes(half, "little")
    return (int.from_bytes(x, "little") ^ int.from_bytes(y, "little")).bit_count()


def _prefixes(docs: DataFrame, size: int, percent: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """node, the set's size k, its sketch, how many of the prefix are not common, and the prefix: the rarest shingles, by sample and then by hash."""
    known = docs.sparkSession.sparkContext.broadcast(common)

    def task(batches):
        shingles, often = known.value
        for batch in batches:
            names = batch.column(0)
            for first, block in W.text_blocks(batch.column(1)):
                x, text, edges = _shingles(block, size)
                k = np.diff(edges)
                count = np.zeros(len(x), np.int64)
                if len(shingles):
                    place = np.minimum(np.searchsorted(shingles, x), len(shingles) - 1)
                    count = np.where(shingles[place] == x, often[place], 0)
                order = np.lexsort((count, text))  # stable: by hash among equals
                take = np.where(k > 0, k - (percent * k + 99) // 100 + 1, 0)
                kept = order[np.arange(len(x)) - edges[:-1][text] < take[text]]
                rare = np.bincount(text[kept[count[kept] == 0]], minlength=len(block))
                ends = np.concatenate([[0], np.cumsum(take)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [names.slice(first, len(block)), pa.array(k.astype(np.int32)), pa.array([_sketch(x[s:e]) if e > s else None for s, e in zip(edges[:-1], edges[1:], strict=True)], pa.binary()), pa.array(rare.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(x[kept].view(np.int64)))],
                    ["node", "k", "sketch", "rare", "keys"],
                )

    return docs.where(F.col("doc_id").isNotNull()).mapInArrow(task, "node long, k int, sketch binary, rare int, keys array<long>").where("k > 0")


def _may_be_alike(table: pa.RecordBatch, percent: int):
    """Pairs of rows of one group and different components whose first common shingle the group's may be, a few at a time.

    Columns: centre, low, high, node, component, k and the shingle's place in the set.
    What stands behind the first common shingle is all that a pair can share besides.
    """
    group, component, k, at = _group(table), *(table.column(i).to_numpy().astype(np.int64) for i in (4, 5, 6))
    starts = np.flatnonzero(np.r_[True, (group[:, 1:] != group[:, :-1]).any(0)])
    number = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(k)]))
    mixed = np.minimum.reduceat(component, starts) < np.maximum.reduceat(component, starts)
    rest = np.flatnonzero(mixed[number])
    live = np.arange(len(rest))
    for d in range(1, len(rest)):
        live = live[live + d < len(rest)]
        live = live[number[rest[live]] == number[rest[live + d]]]
        if not len(live):
            return
        i, j = rest[live], rest[live + d]
        apart = component[i] != component[j]
        i, j = i[apart], j[apart]
        near = (100 + percent) * np.minimum(k[i] - at[i], k[j] - at[j]) >= percent * (k[i] + k[j])
        if near.any():
            yield i[near], j[near]


def _with_partner(rows: DataFrame, percent: int) -> DataFrame:
    """The ``rows`` (centre, low, high, node, component, k, at) that may be alike to another of their group; never pairs."""

    def task(batches):
        for table in _whole_groups(batches):
            flag = np.zeros(table.num_rows, bool)
            for i, j in _may_be_alike(table, percent):
                flag[i] = flag[j] = True
            yield table.filter(pa.array(flag))

    return rows.mapInArrow(task, "centre long, low int, high int, node long, component long, k int, at int")


def _near_by_sketch(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``rows`` (centre, low, high, node, component, k, at, sketch) that may be alike by their sketches too."""

    def task(batches):
        for table in _whole_groups(batches):
            node, k, sketch = table.column(3).to_numpy(), table.column(5).to_pylist(), table.column(7).to_pylist()
            for left, right in _may_be_alike(table, percent):
                near = [(i, j) for i, j in zip(left.tolist(), right.tolist(), strict=True) if (100 + percent) * _bits_apart(sketch[i], sketch[j]) <= (100 - percent) * (k[i] + k[j])]
                if near:
                    a, b = np.array(near).T
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[a], node[b])), pa.array(np.maximum(node[a], node[b]))], ["a", "b"])

    return rows.mapInArrow(task, "a long, b long")


def _missed_links(docs: DataFrame, classes: DataFrame, labels: DataFrame, n: int, size: int, percent: int) -> DataFrame:
    """Links (a, b) between different components of ``labels``: all there are, on the full sets.

    Documents that share a key first meet without their sketches, which leaves those with
    a possible partner.  A key of many documents is common in the sample and dealt over tiles.
    """
    named = classes.select("node").distinct().join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    marked = cut(_prefixes(docs, size, percent, _common(docs, size, n)).join(few(named), "node"))
    keys = lambda start, length: F.posexplode(F.slice("keys", start, length)).alias("at", "centre")
    rare = marked.where("rare > 0").select(keys(F.lit(1), F.col("rare")), "node", "component", "k").select("centre", F.lit(0).alias("low"), F.lit(0).alias("high"), "node", "component", "k", "at")
    often = marked.where("rare < size(keys)").select(keys(F.col("rare") + 1, F.size("keys") - F.col("rare")), "node", "component", "k", "rare").withColumn("at", F.col("at") + F.col("rare")).drop("rare")
    several = cut(often.groupBy("centre").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").select("centre", "n"))
    tiled = _tiled(join_hot(often, several, ["centre"], [F.col("node")], TILE).select("centre", "node", "component", "k", "at", F.ceil(F.col("n") / TILE).alias("tiles")), F.col("tiles"))
    left = _with_partner(_together(rare.unionByName(tiled)), percent)
    sketched = left.join(marked.select("node", "k", "sketch"), ["node", "k"]).select("centre", "low", "high", "node", "component", "k", "at", "sketch")
    return confirmed(_near_by_sketch(_together(sketched), percent), docs, size, percent)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    Texts are lower-cased (A-Z) and their sets are the distinct shingles of ``size``
    words.  Documents with 100 * intersection >= percent * union are linked;
    component_id is the smallest doc_id reachable, kept says that it is the row's own.
    Null and empty texts have an empty set and are linked with nothing.  Rows that share
    a doc_id are one document.  A null doc_id takes no part: no component, and kept.

    All links between components are found, whatever the signatures miss.  For
    ``percent`` below 80 they would miss more than a millionth, which the exact join of
    prefixes would have to find, so lower values are refused.
    """
    if percent < 80:
        raise ValueError("the signatures are made for a similarity of 0.8 or more")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    seen = cut(signatures(rows, size))
    classes = cut(seen.where(F.col("signature").isNotNull() & F.col("doc_id").isNotNull()).groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.any_value("signature").alias("signature")))
    index = index_keys(classes)
    sizes = cut(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))  # so that Spark can split the join's large partitions
    live = cut(index.join(sizes, "key").select("key", "n", "node"))
    stars = cut(_star_pairs(live))
    marks = classes.select(F.col("node").alias("a"), F.col("signature").alias("sa"))
    pairs = stars.where("a <> b").join(marks, "a").join(marks.select(F.col("a").alias("b"), F.col("sa").alias("sb")), "b")
    links = cut(confirmed(_near(pairs, most_apart(percent)), rows, size, percent))
    more = cut(_residual_links(stars, components(links), classes, rows, size, percent))
    found = links.union(more)
    labels = components(found)
    missed = cut(_missed_links(rows, classes, labels, seen.count(), size, percent))
    if not missed.isEmpty():
        labels = components(found.union(missed))
    named = classes.join(labels, "node", "left").select("d1", "d2", F.coalesce("component", "node").alias("component"))
    # The smallest doc_id is that of a class, so a component's label is the answer for its rows.
    out = seen.join(named, ["d1", "d2"], "left")
    component = F.when(F.col("signature").isNull() | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, unchanged.

    Only the ids that go are joined; texts are shuffled only if those are too many to
    be broadcast.
    """
    gone = near_duplicates(docs, size, percent).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(few(gone), "doc_id", "left_anti").select(*docs.columns)
