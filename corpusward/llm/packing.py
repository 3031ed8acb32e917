"""Packing tokenised documents into sequences: shortest-pack-first over the length histogram.

Documents are tokenised and cut at multiples of the sequence length.  Only the
histogram of piece lengths goes to the driver, at most one number for each length.
There lengths are placed longest first, each into the open packing pattern with the
most room, and patterns carry counts, so the work does not grow with the number of
documents.  What room is left in all packs together is then filled: packs that hold least
are dissolved, and their pieces, one after the other, are cut where a room ends; less
than one sequence of padding is left.  Pieces are ranked within their length and take
their places by rank.
"""

from __future__ import annotations

import zlib
from bisect import insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusward.functions.lineage import cut, stored
from corpusward.llm import bytepairs


def token_pieces(docs: DataFrame, path: str, max_tokens: int, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of every document's ids (with ``end_id`` last), of at most ``max_tokens`` ids.

    Returns doc_id, row (of the document, its own), start, length, ids_crc32 (of the ids as
    unsigned little-endian 32-bit numbers), doc_tokens, ids (little-endian, 2 bytes each
    where the model's ids fit, else 4); other columns are dropped.  A null or empty text has the
    end id alone, a very long one as many pieces as it needs; repeated rows have pieces of
    their own; ids of any type, null too, stay as they are; an empty table gives no rows.
    """

    def task(batches):
        kind = f"<u{id_bytes(path, end_id)}"
        for batch in batches:
            names, numbers = batch.column(0), batch.column(1)
            for first, block in bytepairs.blocks(batch.column(2).to_pylist()):
                rows = []
                for i, ids in enumerate(bytepairs.text_ids(block, path)):
                    ids = np.append(ids, end_id).astype("<u4")
                    small = ids.astype(kind)
                    rows += [(first + i, s, min(max_tokens, len(ids) - s), zlib.crc32(ids[s : s + max_tokens]), len(ids), small[s : s + max_tokens].tobytes()) for s in range(0, len(ids), max_tokens)]
                at, *rest, raw = zip(*rows, strict=True)
                at = pa.array(at)
                yield pa.RecordBatch.from_arrays([names.take(at), numbers.take(at), *(pa.array(x, pa.int64()) for x in rest), pa.array(raw, pa.binary())], ["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    longs = [T.StructField(n, T.LongType()) for n in ("row", "start", "length", "ids_crc32", "doc_tokens")]
    return rows.mapInArrow(task, T.StructType([rows.schema["doc_id"], *longs, T.StructField("ids", T.BinaryType())]))


def id_bytes(path: str, end_id: int) -> int:
    return 2 if max(end_id, max(bytepairs.vocabulary(path).bytes), *bytepairs.added_tokens(path)[1].values(), 0) < 1 << 16 else 4


def packed_documents(docs: DataFrame, path: str, max_tokens: int, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``token_pieces`` of ``docs``, packed: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Ids are written once; only pieces that packing cuts read theirs again.
    """
    pieces = stored(token_pieces(docs, path, max_tokens, end_id, doc_id, text))
    placed = cut(pack(pieces.drop("ids"), max_tokens))
    whole = placed.where(F.col("taken") == F.col("length"))
    parts = cut(placed.where(F.col("taken") < F.col("length")).select("row", "start", "skip", "taken", "sequence_id", "offset"))
    ids = pieces.select("doc_id", "row", "start", "doc_tokens", "ids")
    both = ids.join(F.broadcast(parts) if parts.limit(MOST_PARTS + 1).count() <= MOST_PARTS else parts, ["row", "start"])
    each = id_bytes(path, end_id)

    def checksums(batches):
        for batch in batches:
            at = batch.schema.get_field_index("ids_crc32")
            sums = pa.array([zlib.crc32(np.frombuffer(x.as_buffer(), f"<u{each}").astype("<u4")) for x in batch.column(at)], pa.int64())
            yield batch.set_column(at, "ids_crc32", sums)

    own = F.expr(f"substring(ids, cast(skip * {each} + 1 AS int), cast(taken * {each} AS int))")
    cut_ = both.select("doc_id", (F.col("start") + F.col("skip")).alias("start"), F.col("taken").alias("length"), own.alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
    again = cut_.mapInArrow(checksums, T.StructType([T.StructField("ids_crc32", T.LongType()) if f.name == "ids_crc32" else f for f in cut_.schema]))
    return whole.select(*again.columns).unionByName(again)


#: Parts of cut pieces that are broadcast (48 bytes each).
MOST_PARTS = 300_000


def patterns(histogram: dict[int, int], max_tokens: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Packing patterns and how many sequences follow each; a pattern is runs of (length, times), longest first.

    Lengths are taken longest first.  A piece joins the shortest open pack if that has
    room for it, and opens a new pack else; so all copies of a pattern take pieces of a
    length together, one after the other for as long as they are the shortest, and new
    packs are filled with the length that opens them.  There are a few patterns for each
    distinct length, whatever the counts.
    """
    room: list[int] = []  # distinct amounts of room, ascending
    packs: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    done: list[tuple[list[tuple[int, int]], int]] = []

    def put(left: int, pattern: list[tuple[int, int]], n: int) -> None:
        if not n:
            return
        if not left:
            done.append((pattern, n))
            return
        if left not in packs:
            packs[left] = []
            insort(room, left)
        packs[left].append((pattern, n))

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            if not room or room[-1] < length:
                each = max_tokens // length
                full, rest = divmod(n, each)
                put(max_tokens - each * length, [(length, each)], full)
                put(max_tokens - rest * length, [(length, rest)], 1 if rest else 0)
                break
            left = room[-1]
            pattern, copies = packs[left].pop()
            if not packs[left]:
                del packs[left]
                room.pop()
            # So many pieces a pack takes until another one is shorter.
            each = min(left // length, max(1, -(-(left - (room[-1] if room else 0)) // length)))
            full, rest = min(copies, n // each), 0
            if full < copies:
                rest = n - full * each
            put(left, pattern, copies - full - (1 if rest else 0))
            put(left - each * length, [*pattern, (length, each)], full)
            put(left - rest * length, [*pattern, (length, rest)], 1 if rest else 0)
            n -= full * each + rest
    return done + [p for left in room for p in packs[left]]


#: A run of places: pieces of ``length`` with ranks from ``low`` on, ``times`` in a pack, in packs from ``first`` on at ``offset``.  Dissolved ones (times 0) come from ``first`` on in the stream that fills the rooms.
Run = tuple[int, int, int, int, int]


def filled(found: list[tuple[list[tuple[int, int]], int]], max_tokens: int) -> tuple[list[Run], list[tuple[int, int, int, int]]]:
    """Runs of places, and rooms (place in the stream, size, first pack, packs) that the pieces of dissolved packs fill one after the other.

    All rooms together hold as many packs as may be dissolved; those that hold least are.
    """
    held = lambda pattern: sum(length * times for length, times in pattern)
    spare = sum((max_tokens - held(p)) * n for p, n in found) // max_tokens
    kept, dissolved = [], []
    for pattern, n in sorted(found, key=lambda f: held(f[0])):
        gone = min(n, spare)
        spare -= gone
        dissolved += [(pattern, gone)] if gone else []
        kept += [(pattern, n - gone)] if n > gone else []
    runs, rooms, used, first, stream = [], [], {}, 0, 0
    for pattern, n in kept:
        offset = 0
        for length, times in pattern:
            low = used.get(length, 0)
            runs.append((length, low, times, first, offset))
            used[length] = low + n * times
            offset += length * times
        if offset < max_tokens and dissolved:
            rooms.append((stream, max_tokens - offset, first, n))
            stream += (max_tokens - offset) * n
        first += n
    stream = 0
    for pattern, n in dissolved:
        for length, times in pattern:
            low = used.get(length, 0)
            runs.append((length, low, 0, stream, 0))
            used[length] = low + n * times
            stream += length * n * times
    return runs, rooms


def _numbered(pieces: DataFrame) -> DataFrame:
    """``pieces`` with _part and _local: their partition, and their number within it among those of their length, in the order of all columns.

    Rows are dealt by range, so that a very common length is spread over partitions.
    """
    order = ["length", *(c for c in pieces.columns if c != "length")]
    at = pieces.columns.index("length")
    # Dealing by range reads its input twice, the first time for a sample of the keys.
    rows = cut(pieces).repartitionByRange(*order).sortWithinPartitions(*order)

    def number(batches):
        part, counts = TaskContext.get().partitionId(), {}
        for batch in batches:
            key = batch.column(at).to_numpy(zero_copy_only=False)
            local = np.empty(len(key), np.int64)
            # sorted by the key: equal keys are runs
            edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
            for i, j in zip(edges, np.r_[edges[1:], len(key)], strict=False):
                seen = counts.get(key[i], 0)
                local[i:j] = np.arange(seen, seen + j - i)
                counts[key[i]] = seen + int(j - i)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(key), part, np.int32)), pa.array(local)], [*batch.schema.names, "_part", "_local"])

    return cut(rows.mapInArrow(number, T.StructType([*pieces.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_local", T.LongType())])))


def pack(pieces: DataFrame, max_tokens: int) -> DataFrame:
    """``pieces`` (with a long ``length`` from 1 to ``max_tokens``) plus sequence_id, offset, skip and taken.

    Every piece has one place, or several if it is cut: a row for each part, which leaves
    ``skip`` of the piece before it and has ``taken``.  Places in a sequence follow each
    other without a gap from offset 0, and all but one sequence are full.  A piece's rank among
    those of its length is its number in its partition and the numbers of earlier
    partitions; the runs of patterns that hold the length are found by rank with a
    binary search.
    """
    numbered = _numbered(pieces)
    # A row for each partition and length: partitions hold ranges, so they share lengths at their ends only.
    sizes = numbered.groupBy("length", "_part").agg((F.max("_local") + 1).alias("n")).toPandas().sort_values(["length", "_part"])
    histogram = {int(k): int(n) for k, n in sizes.groupby("length").n.sum().items()}  # max_tokens entries at most
    base = (sizes.groupby("length").n.cumsum() - sizes.n).to_numpy(np.int64)
    parts = (sizes.length.to_numpy(np.int64) << 32) + sizes._part.to_numpy(np.int64)
    runs, rooms = filled(patterns(histogram, max_tokens), max_tokens)
    # A few runs for each of max_tokens lengths.
    runs = np.array(sorted(runs), np.int64).reshape(-1, 5)
    rooms = np.array(rooms, np.int64).reshape(-1, 4)
    starts = np.searchsorted(runs[:, 0], np.arange(max_tokens + 2))
    shared = pieces.sparkSession.sparkContext.broadcast((parts, base, runs, rooms, starts))
    names, schema = pieces.columns, pieces.schema

    def room_of(x: np.ndarray, rooms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The run of rooms that holds each place of the stream, and the room's number in the run."""
        k = np.searchsorted(rooms[:, 0], x, "right") - 1
        return k, (x - rooms[k, 0]) // rooms[k, 1]

    def place(batches):
        parts, base, runs, rooms, starts = shared.value
        before = np.cumsum(rooms[:, 3]) - rooms[:, 3]
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            length, part, local = column("length"), column("_part"), column("_local")
            rank = base[np.searchsorted(parts, (length << 32) + part)] + local
            at = np.empty(len(rank), np.int64)
            for k in np.unique(length):  # ranges hold few lengths, but for the first ones
                own = length == k
                at[own] = starts[k] - 1 + np.searchsorted(runs[starts[k] : starts[k + 1], 1], rank[own], "right")
            _, low, times, first, offset = runs[at].T
            inside, packed = rank - low, np.maximum(times, 1)
            rows, skip, taken = np.arange(len(rank)), np.zeros(len(rank), np.int64), length
            sequence, place_ = first + inside // packed, offset + inside % packed * length
            loose = np.flatnonzero(times == 0)
            if len(loose):
                x, n = first[loose] + inside[loose] * length[loose], length[loose]
                (k0, i0), (k1, i1) = room_of(x, rooms), room_of(x + n - 1, rooms)
                some = before[k1] + i1 - before[k0] - i0 + 1  # rooms that each piece lies in
                piece = np.repeat(np.arange(len(loose)), some)
                room = np.arange(len(piece)) - np.repeat(np.cumsum(some) - some, some) + (before[k0] + i0)[piece]
                k = np.searchsorted(before, room, "right") - 1
                begin = rooms[k, 0] + (room - before[k]) * rooms[k, 1]
                start, end = np.maximum(begin, x[piece]), np.minimum(begin + rooms[k, 1], (x + n)[piece])
                fixed = np.flatnonzero(times > 0)
                rows = np.concatenate([fixed, loose[piece]])
                skip = np.concatenate([skip[fixed], start - x[piece]])
                taken = np.concatenate([length[fixed], end - start])
                sequence = np.concatenate([sequence[fixed], rooms[k, 2] + room - before[k]])
                place_ = np.concatenate([place_[fixed], max_tokens - rooms[k, 1] + start - begin])
            kept = batch.take(pa.array(rows)) if len(loose) else batch
            yield pa.RecordBatch.from_arrays([*(kept.column(kept.schema.get_field_index(c)) for c in names), *(pa.array(c) for c in (sequence, place_, skip, taken))], [*names, "sequence_id", "offset", "skip", "taken"])

    return numbered.mapInArrow(place, T.StructType([*schema.fields, *(T.StructField(c, T.LongType()) for c in ("sequence_id", "offset", "skip", "taken"))]))
