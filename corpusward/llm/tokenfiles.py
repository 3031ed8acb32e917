"""Token files: documents' ids in blocks, coded by a static range asymmetric numeral system.

A folder holds two tables.  ``table`` has the frequency of every id, scaled to a power of
two and shared by all blocks.  ``blocks`` has a row for each block of at most BLOCK ids:
which documents it holds pieces of, the coded words, checkpoints and a checksum.  Ids of
a block are dealt to LANES interleaved coders, so that numpy takes a step of all lanes of
many blocks at once.  A checkpoint holds the lanes' states and the place in the words
every STEPS steps; decoding may start at any of them, and a task decodes the stretches
between checkpoints of all its blocks side by side.

Files are in order: ``part`` numbers ranges of doc_id, blocks are numbered within a part,
and documents lie in ascending order of doc_id (null first) within and across them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusward.functions.lineage import stored
from corpusward.llm.bytepairs import blocks as text_blocks

LANES, STEPS, BLOCK = 128, 256, 65_536
#: Blocks that a task codes side by side.
TOGETHER = 32
_U = np.uint64
_LOW, _WORD = _U(1 << 31), _U(32)

# ---------------------------------------------------------------- the coder


@dataclass(frozen=True)
class Frequencies:
    """Scaled frequencies of ids 0 to n - 1; they add up to 2**bits."""

    scaled: np.ndarray
    bits: int

    @staticmethod
    def of(counts: np.ndarray) -> Frequencies:
        """Every id that occurs gets a share of at least one; what rounding leaves over goes to the most frequent ids."""
        counts = np.asarray(counts, np.int64)
        bits = max(16, int(np.count_nonzero(counts)).bit_length() + 3)
        if bits > 30:
            raise ValueError("more ids than shares of a 30-bit table")
        if not counts.any():
            return Frequencies(np.zeros(len(counts), np.int64), bits)
        total = int(counts.sum())
        scaled = np.array([0 if not c else max(1, (int(c) << bits) // total) for c in counts], np.int64)
        over = int(scaled.sum()) - (1 << bits)
        for i in np.argsort(-scaled, kind="stable"):
            if not over:
                break
            step = min(over, int(scaled[i]) - 1) if over > 0 else over
            scaled[i] -= step
            over -= step
        return Frequencies(scaled, bits)

    @cached_property
    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Frequency and first slot of each id, and the id of each slot."""
        first = np.cumsum(self.scaled) - self.scaled
        return self.scaled.astype(_U), first.astype(_U), np.repeat(np.arange(len(self.scaled), dtype=np.uint32), self.scaled)


def encode_blocks(ids: list[np.ndarray], table: Frequencies) -> list[tuple[bytes, bytes]]:
    """(words, checkpoints) of each array of ids.

    A checkpoint is the number of words before it and the states of its lanes, as 64-bit numbers.
    """
    if not ids:
        return []
    freq, first, _ = table.tables
    sizes = np.array([len(x) for x in ids])
    steps = -(-int(sizes.max()) // LANES)
    grid = np.zeros((len(ids), steps * LANES), np.int64)
    for row, x in zip(grid, ids, strict=True):
        row[: len(x)] = x
    there = (np.arange(steps * LANES)[None, :] < sizes[:, None]).reshape(len(ids), steps, LANES)
    f = np.where(there, freq[grid].reshape(there.shape), _U(1))
    c = first[grid].reshape(there.shape)
    if not f.all():
        raise ValueError("an id that the table has no share for")
    words, out = np.zeros(there.shape, np.uint32), np.zeros(there.shape, bool)
    marks = np.zeros((len(ids), -(-steps // STEPS), LANES), _U)
    state = np.full((len(ids), LANES), _LOW)
    bits, top = _U(table.bits), _U(63 - table.bits)
    for t in range(steps - 1, -1, -1):
        now, fs = there[:, t], f[:, t]
        full = now & (state >= fs << top)
        words[:, t], out[:, t] = state.astype(np.uint32), full
        x = np.where(full, state >> _WORD, state)
        q = x // fs
        state = np.where(now, (q << bits) + (x - q * fs) + c[:, t], state)
        if t % STEPS == 0:
            marks[:, t // STEPS] = state
    before = np.zeros((len(ids), steps + 1), np.int64)
    np.cumsum(out.sum(2), 1, out=before[:, 1:])
    found = []
    for i, n in enumerate(sizes.tolist()):
        k = -(-n // (LANES * STEPS))
        head = np.concatenate([before[i, : k * STEPS : STEPS].astype("<u8")[:, None], marks[i, :k].astype("<u8")], 1)
        found.append((words[i][out[i]].astype("<u4").tobytes(), head.tobytes()))
    return found


def decode_blocks(blocks: list[tuple[int, bytes, bytes]], table: Frequencies, first: int = 0) -> list[np.ndarray]:
    """The ids of blocks (number of ids, words, checkpoints), from checkpoint ``first`` on."""
    freq, start, slots = table.tables
    words = np.concatenate([*(np.frombuffer(w, "<u4") for _, w, _ in blocks), np.zeros(1, "<u4")]).astype(_U)
    base = np.cumsum([0, *(len(w) // 4 for _, w, _ in blocks)])
    heads = [np.frombuffer(h, "<u8").reshape(-1, 1 + LANES)[first:] for _, _, h in blocks]
    counts = [len(h) for h in heads]
    sizes = np.concatenate([np.minimum(LANES * STEPS, n - LANES * STEPS * (first + np.arange(k))) for (n, _, _), k in zip(blocks, counts, strict=True)])
    if not len(sizes):
        return [np.empty(0, np.uint32) for _ in blocks]
    state = np.concatenate([h[:, 1:] for h in heads]).astype(_U)
    at = np.concatenate([h[:, 0].astype(np.int64) + b for h, b in zip(heads, base, strict=False)])
    steps = -(-int(sizes.max()) // LANES)
    ids = np.zeros((steps, len(sizes), LANES), np.uint32)
    bits, mask = _U(table.bits), _U((1 << table.bits) - 1)
    lane = np.arange(LANES)
    for t in range(steps):
        now = (t * LANES + lane)[None, :] < sizes[:, None]
        slot = state & mask
        s = slots[slot.astype(np.int64)]
        x = freq[s] * (state >> bits) + slot - start[s]
        low = now & (x < _LOW)
        place = at[:, None] + np.cumsum(low, 1) - 1
        x = np.where(low, x << _WORD | words[np.where(low, place, -1)], x)
        at += low.sum(1)
        state = np.where(now, x, state)
        ids[t] = s
    rows = ids.transpose(1, 0, 2).reshape(len(sizes), -1)
    edges = np.cumsum([0, *counts])
    return [np.concatenate([*(rows[j, : sizes[j]] for j in range(a, b)), np.empty(0, np.uint32)]).astype(np.uint32) for a, b in zip(edges[:-1], edges[1:], strict=True)]


_POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """The product of two polynomials over GF(2), bits reversed as CRC-32 has them, modulo its polynomial."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = b >> 1 ^ (_POLYNOMIAL if b & 1 else 0)
    return out


def join_crc(one: int, two: int, size: int) -> int:
    """The CRC-32 of two byte strings one after the other, from theirs and the second's length."""
    power, square = 1 << 31, 1 << 23  # x**0 and x**8, the shift by a byte
    while size:
        if size & 1:
            power = _times(power, square)
        square = _times(square, square)
        size >>= 1
    return _times(one, power) ^ two


# ---------------------------------------------------------------- tokens


class _Cached:
    """The ids that the tokenizers library gives for what stands between blanks, kept for each worker."""

    #: Entries; beyond it the cache starts anew.
    MOST = 600_000
    #: Characters of the longest entry.
    LONG = 48
    #: Words that the library codes in one call.
    CALL = 256

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        if not all(t.content.startswith("<|") for t in self.library.get_added_tokens_decoder().values()):
            raise ValueError("added tokens that do not start with <|")
        self.known: dict[str, bytes] = {"": b""}
        self.signs: dict[str, bytes] = {}

    def _each(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def _together(self, words: list[str]) -> list[bytes]:
        """The same for words of Latin letters alone, each one token of the splitting pattern: many in one call."""
        out = []
        calls = [words[i : i + self.CALL] for i in range(0, len(words), self.CALL)]
        for part, e in zip(calls, self.library.encode_batch_fast([" ".join(p) for p in calls], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            edges = [0, *(np.flatnonzero(self.ends[ids]) + 1).tolist()]
            if len(edges) == len(part) + 1 and edges[-1] == len(ids):
                data = ids.tobytes()
                out += [data[4 * a : 4 * b] for a, b in zip(edges, edges[1:])]  # noqa: B905
            else:
                out += self._each(part)
        return out

    def sign(self, x: str) -> bytes:
        if x not in self.signs:
            self.signs[x] = self._each([x])[0]
        return self.signs[x]

    def learn(self, new: list[str]) -> dict[str, bytes]:
        """The ids of words that are not known; a sign after letters is a token of its own, so words with and without one share theirs."""
        stems: dict[str, list[str]] = {}
        plain, signed = [], []
        for x in new:
            if not _LATIN.fullmatch(x):
                plain.append(x)
            elif x[-1] not in _SIGNS:
                stems[x] = []
            else:
                signed.append(x)
        out = {}
        for x in signed:
            if (ids := self.known.get(x[:-1])) is not None:
                out[x] = ids + self.sign(x[-1])
            else:
                stems.setdefault(x[:-1], []).append(x)
        out.update(zip(plain, self._each(plain), strict=True))
        for (stem, more), ids in zip(stems.items(), self._together(list(stems)), strict=True):
            out[stem] = ids
            for x in more:
                out[x] = ids + self.sign(x[-1])
        return out

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text.

        Blanks (U+0020, U+0009, U+000A, U+000D) end every token and leave none, so what lies between
        them is coded apart.  A-Z are lower-cased first, as the library does after it composed
        characters; texts with marks that letters may compose with, or with what could spell an added token, are left to it.
        """
        split = []
        for t in texts:
            if not ("<|" in t or _MARKS.search(t)):
                t = t.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
            split.append(t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))
        if len(self.known) > self.MOST:
            self.known = {"": b""}
        new = set().union(*split).difference(self.known)
        learnt = self.learn(list(new)) if new else {}
        self.known.update(learnt)
        for parts in split:
            yield np.frombuffer(b"".join(map(self.known.__getitem__, parts)), "<u4")
        for x in learnt:
            if len(x) > self.LONG:
                del self.known[x]


#: Marks that compose with ASCII letters.
_MARKS = re.compile("[\u0300-\u036f]")
_SIGNS = frozenset(".,;:!?")
#: Letters that are themselves when composed and one letter in lower case, and a sign that is a token of its own after them.
_LATIN = re.compile("[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+[.,;:!?]?")


@cache
def _cached(path: str) -> _Cached:
    return _Cached(path)


#: Characters of the texts that a task codes at once.
_AT_ONCE = 1_000_000


def width(path: str, end_id: int) -> int:
    """Bytes of an id: 2 where all ids of the model fit, else 4."""
    return 2 if max(end_id, len(_cached(path).ends) - 1) < 1 << 16 else 4


def token_rows(docs: DataFrame, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ``ids`` (unsigned little-endian numbers of ``width`` bytes, ``end_id`` last) of each row.

    A null text is empty and has the end id alone; ids may be of any type and null;
    other columns are dropped.
    """

    def task(batches):
        coder, kind = _cached(path), f"<u{width(path, end_id)}"
        end = np.array([end_id], kind).tobytes()
        for batch in batches:
            for first, block in text_blocks(batch.column(1).to_pylist(), _AT_ONCE):
                ids = [x.astype(kind).tobytes() + end for x in coder.encode(block)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(block)), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(task, T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("ids", T.BinaryType())]))


def frequencies(tokens: DataFrame, each: int = 4) -> Frequencies:
    """Counts of all ids of ``each`` bytes, at most one number for each id of the vocabulary on the driver, scaled."""

    def task(batches):
        counts = np.zeros(0, np.int64)
        for batch in batches:
            new = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), f"<u{each}"), minlength=len(counts))
            new[: len(counts)] += counts
            counts = new
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], ["id", "n"])

    found = tokens.select("ids").mapInArrow(task, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(found.id.max()) + 1 if len(found) else 0, np.int64)
    counts[found.id.to_numpy(np.int64)] = found.n
    return Frequencies.of(counts)


# ---------------------------------------------------------------- files


def _block_schema(kind: T.DataType) -> T.StructType:
    plain = [("part", T.IntegerType()), ("block", T.LongType()), ("first", T.LongType()), ("n", T.IntegerType())]
    lists = [("numbers", T.ArrayType(T.LongType())), ("doc_ids", T.ArrayType(kind)), ("sizes", T.ArrayType(T.IntegerType()))]
    coded = [("words", T.BinaryType()), ("checkpoints", T.BinaryType()), ("crc32", T.LongType())]
    return T.StructType([T.StructField(n, k) for n, k in plain + lists + coded])


def write(tokens: DataFrame, folder: str, each: int = 4) -> None:
    """``tokens`` (doc_id, ids of ``each`` bytes) as a folder of token files in ascending order of doc_id.

    Equal doc_ids lie next to each other, in the order of their ids' hashes.  Rows are
    dealt by range with a number of their own last, so that very many rows of one
    doc_id are spread over files.  A task holds TOGETHER blocks and one document.
    """
    spark = tokens.sparkSession
    kept = stored(tokens.withColumn("row", F.monotonically_increasing_id()))
    table = frequencies(kept, each)
    spark.createDataFrame([(i, int(n)) for i, n in enumerate(table.scaled) if n], "id int, frequency int").coalesce(1).write.parquet(f"{folder}/table")
    shared = spark.sparkContext.broadcast(table)
    order = ["doc_id", "hash", "row"]
    rows = kept.withColumn("hash", F.xxhash64("ids")).repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "doc_id", "ids")
    schema = _block_schema(tokens.schema["doc_id"].dataType)

    def task(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, table = to_arrow_schema(schema), shared.value
        open_, done, left, number, first, part = [], [], BLOCK, 0, 0, 0

        def coded():
            nonlocal first
            ids = [np.concatenate([x for _, _, x in b]) for b in done]
            out = []
            for block, (b, x, (words, marks)) in enumerate(zip(done, ids, encode_blocks(ids, table), strict=True), coded.blocks):
                out.append((part, block, first, len(x), [i for i, _, _ in b], [d for _, d, _ in b], [len(p) for _, _, p in b], words, marks, zlib.crc32(x.astype("<u4"))))
                first += len(x)
            coded.blocks += len(done)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

        coded.blocks = 0
        for batch in batches:
            for part, name, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):  # noqa: B007
                ids, at = np.frombuffer(raw, f"<u{each}"), 0
                while at < len(ids):
                    piece = ids[at : at + left]
                    open_.append((number, name, piece))
                    at, left = at + len(piece), left - len(piece)
                    if not left:
                        done.append(open_)
                        open_, left = [], BLOCK
                        if len(done) == TOGETHER:
                            yield coded()
                number += 1
        if open_:
            done.append(open_)
        if done:
            yield coded()

    rows.mapInArrow(task, schema).write.option("compression", "none").parquet(f"{folder}/blocks")


def _table(spark: SparkSession, folder: str) -> Frequencies:
    found = spark.read.parquet(f"{folder}/table").toPandas()  # an entry for each id of the vocabulary
    scaled = np.zeros(int(found["id"].max()) + 1 if len(found) else 0, np.int64)
    scaled[found["id"].to_numpy(np.int64)] = found["frequency"]
    return Frequencies(scaled, max(0, int(scaled.sum()).bit_length() - 1))


def read(spark: SparkSession, folder: str, with_ids: bool = True, blocks: DataFrame | None = None) -> DataFrame:
    """Pieces of documents: part, number (of the document in its part), doc_id, start, length, crc32, ids.

    ``start`` counts the ids of all documents before the piece.  Blocks are decoded
    independently; one whose checksum does not hold raises ValueError.  ``blocks`` may be some rows of
    the folder's ``blocks`` table, to read only these.
    """
    all_blocks = spark.read.parquet(f"{folder}/blocks")
    # A row for each file of the folder.
    sizes = sorted(map(tuple, all_blocks.groupBy("part").agg(F.sum("n")).collect()))
    before = dict(zip((p for p, _ in sizes), np.cumsum([0, *(n for _, n in sizes)]).tolist(), strict=False))
    shared = spark.sparkContext.broadcast((_table(spark, folder), before))
    kind = all_blocks.schema["doc_ids"].dataType.elementType
    fields = [("part", T.IntegerType()), ("number", T.LongType()), ("doc_id", kind), ("start", T.LongType()), ("length", T.LongType()), ("crc32", T.LongType())]
    schema = T.StructType([T.StructField(n, k) for n, k in fields + ([("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])

    def task(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        (table, before), arrow = shared.value, to_arrow_schema(schema)
        for batch in batches:
            for i in range(0, batch.num_rows, TOGETHER):
                rows = batch.slice(i, TOGETHER).to_pylist()
                out = []
                for row, ids in zip(rows, decode_blocks([(r["n"], r["words"], r["checkpoints"]) for r in rows], table), strict=True):
                    ids, at = ids.astype("<u4"), 0
                    if zlib.crc32(ids) != row["crc32"]:
                        raise ValueError(f"block {row['block']} of part {row['part']} is damaged")
                    for number, name, size in zip(row["numbers"], row["doc_ids"], row["sizes"], strict=True):
                        piece = ids[at : at + size]
                        out.append((row["part"], number, name, before[row["part"]] + row["first"] + at, size, zlib.crc32(piece), *([piece.astype(np.int32)] if with_ids else [])))
                        at += size
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    wanted = (all_blocks if blocks is None else blocks).select("part", "block", "first", "n", "numbers", "doc_ids", "sizes", "words", "checkpoints", "crc32")
    return wanted.mapInArrow(task, schema)


def document_digests(pieces: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of ``read``'s pieces.

    A document of several blocks has several pieces, whose checksums are joined; ids are
    never brought together.
    """

    @F.pandas_udf("long")
    def joined(parts):
        out = []
        for p in parts:
            crc = int(p[0]["crc32"])
            for x in p[1:]:
                crc = join_crc(crc, int(x["crc32"]), 4 * int(x["length"]))
            out.append(crc)
        import pandas as pd

        return pd.Series(out, dtype="int64")

    one = pieces.groupBy("part", "number").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("start", "length", "crc32"))).alias("parts"))
    return one.select("doc_id", "start", "n_tokens", joined("parts").alias("ids_crc32"))


def round_trip(docs: DataFrame, path: str, end_id: int, folder: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``docs`` to token files in ``folder``, read them back, and return ``document_digests``.

    One row for each row of ``docs``; an empty table gives an empty folder and no rows.
    """
    write(token_rows(docs, path, end_id, doc_id, text), folder, width(path, end_id))
    return document_digests(read(docs.sparkSession, folder, with_ids=False))
