"""Byte-level BPE: pre-tokenisation by transition-function scans, cached pair merging.

The splitting pattern of byte-level vocabularies (contractions; an optional space
before letters, digits or other signs; white space, of which the last before other
text stands apart) is a small automaton.  Characters become classes by one table
look-up, classes become transition functions, and since composing functions is
associative, the state before every character comes from a prefix scan.  Slices are
looked up in a cache; new ones are merged together, one merge of each slice a round.
"""

from __future__ import annotations

import base64
import heapq
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Classes of characters. White space (fixed values): the code points with the property White_Space.
_WHITE = [0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, *range(0x09, 0x0E), 0x20, *range(0x2000, 0x200B)]
_LETTER, _DIGIT, _OTHER, _SPACE, _BLANK = range(5)  # _SPACE is U+0020

# Symbols: a class together with what bounded look-ahead shows.
_SYMBOLS = ["letter", "digit", "other", "space before text", "blank before text", "white before white or the end", "apostrophe before s t m d", "apostrophe before re ve ll"]
# States: what the token under way is.
_OVER, _IN_L, _IN_N, _IN_O, _IN_W, _PREFIX, _ONE_MORE, _TWO_MORE = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a token starts at the symbol."""
    if symbol == 0:
        if state == _TWO_MORE:
            return _ONE_MORE, False
        if state == _ONE_MORE:
            return _OVER, False
        return _IN_L, state not in (_IN_L, _PREFIX)
    if symbol == 1:
        return _IN_N, state not in (_IN_N, _PREFIX)
    if symbol in (6, 7) and state not in (_IN_O, _PREFIX):
        return (_ONE_MORE if symbol == 6 else _TWO_MORE), True
    if symbol in (2, 6, 7):
        return _IN_O, state not in (_IN_O, _PREFIX)
    if symbol == 3:
        return _PREFIX, True
    if symbol == 4:
        return _OVER, True
    return _IN_W, state != _IN_W


@cache
def _machine() -> tuple[np.ndarray, bytes, bytes, bytes, bytes]:
    """Class of each code point, and four byte tables.

    The tables give the symbol of class | 8 * (text follows); the function of symbol | 8 *
    (a text starts), where the state before is _OVER; the composition of functions
    f << 4 | g; and whether a token starts at f << 3 | symbol.  There are few enough
    functions for every argument to be one byte, so a look-up is bytes.translate.
    """
    kinds = np.full(sys.maxunicode + 1, _OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            kinds[c] = _LETTER
        elif k == "N":
            kinds[c] = _DIGIT
    # The libraries' Unicode is a later one: they are asked for what is unassigned here, on the planes that have letters.
    from tokenizers import Regex, pre_tokenizers

    points = np.array([c for c in range(0x40000) if unicodedata.category(chr(c)) == "Cn"])
    whole = "".join(map(chr, points.tolist()))
    for k, kind in ((_LETTER, "L"), (_DIGIT, "N")):
        for _, (start, end) in pre_tokenizers.Split(Regex(rf"\p{{{kind}}}+"), "removed", invert=True).pre_tokenize_str(whole):
            kinds[points[start:end]] = k
    kinds[_WHITE] = _BLANK
    kinds[0x20] = _SPACE
    states = range(8)
    basic = [tuple(_step(s, x)[0] for s in states) for x in range(8)] + [(_step(_OVER, x)[0],) * 8 for x in range(8)]
    known = {f: i for i, f in enumerate(dict.fromkeys(basic))}
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in basic:
            if (h := tuple(g[s] for s in f)) not in known:
                known[h] = len(known)
                todo.append(h)
    if len(known) > 16:
        raise AssertionError("more functions than four bits can name")
    symbols, functions, compose, starts = (bytearray(256) for _ in range(4))
    for k in range(5):
        symbols[k], symbols[k | 8] = (5, k) if k >= _SPACE else (k, k)
    functions[:16] = bytes(known[f] for f in basic)
    for f, i in known.items():
        for g, j in known.items():
            compose[i << 4 | j] = known[tuple(g[s] for s in f)]
        for x in range(8):
            starts[i << 3 | x] = _step(f[_OVER], x)[1]
    return kinds, bytes(symbols), bytes(functions), bytes(compose), bytes(starts)


def _look(table: bytes, at: np.ndarray) -> np.ndarray:
    return np.frombuffer(at.tobytes().translate(table), np.uint8)


def _prefixes(f: np.ndarray, compose: bytes) -> np.ndarray:
    """The composition of the first 1, 2, ... functions, by an associative scan in linear work."""
    if len(f) < 2:
        return f
    half = _prefixes(_look(compose, f[0:-1:2] << 4 | f[1::2]), compose)
    out = np.empty_like(f)
    out[1::2] = half
    out[0] = f[0]
    rest = f[2::2]
    out[2::2] = _look(compose, half[: len(rest)] << 4 | rest)
    return out


def token_starts(text: str, text_starts: np.ndarray) -> np.ndarray:
    """Where slices start in ``text``, the concatenation of texts that start at ``text_starts``."""
    if not text:
        return np.empty(0, np.int64)
    kinds, symbol_of, function_of, compose, starts = _machine()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds[points]
    first = np.zeros(len(points) + 1, np.uint8)
    first[text_starts[text_starts < len(points)]] = 1
    first[-1] = 1
    text_next = np.zeros(len(points), np.uint8)  # the next character is of the same text and not white
    text_next[:-1] = (kind[1:] < _SPACE) & (first[1:-1] == 0)
    symbols = _look(symbol_of, kind | text_next << 3).copy()
    for i in np.flatnonzero(points == 0x27):
        pair = text[i + 1 : i + 3]
        if pair and not first[i + 1]:
            if pair[0] in "stmd":
                symbols[i] = 6
            elif pair in ("re", "ve", "ll") and not first[i + 2]:
                symbols[i] = 7
    scanned = _prefixes(_look(function_of, symbols | first[:-1] << 3), compose)
    out = first[:-1].copy()
    out[1:] |= _look(starts, scanned[:-1] << 3 | symbols[1:])
    return np.flatnonzero(out)


class Vocabulary:
    """Ranks of a byte-level vocabulary, with a cache of merged slices.

    ``ranks`` maps byte strings to ids; any two neighbours whose joined bytes are in
    it can be merged, the lowest id first and the leftmost of equal ones first.
    """

    #: Slices kept in the cache; beyond it the cache starts anew.
    CACHED = 400_000
    #: Slices of more bytes than this are merged one by one with a heap.
    LONG = 64

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {i: b for b, i in ranks.items()}
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = [(ranks[b[:i]] << 32 | ranks[b[i:]], r) for b, r in ranks.items() for i in range(1, len(b)) if b[:i] in ranks and b[i:] in ranks]
        table = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        # Open addressing: a look-up is a few gathers, cheaper than a binary search.
        self.bits = int(4 * max(1, len(table)) - 1).bit_length()
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, _NO_PAIR, np.int32)
        rest, shift = np.arange(len(table)), 0
        at = self._slot(table[:, 0])
        while len(rest):
            free = self.keys[at] == -1
            place, first = np.unique(at[free], return_index=True)
            chosen = np.flatnonzero(free)[first]
            self.keys[place], self.values[place] = table[rest[chosen]].T
            left = np.ones(len(rest), bool)
            left[chosen] = False
            rest, at = rest[left], (at[left] + 1) & ((1 << self.bits) - 1)
            shift += 1
        self.probes = shift + 1
        self.cache: dict[bytes, bytes] = {}  # ids as native 32-bit numbers

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id of each merged pair, or _NO_PAIR."""
        key = left.astype(np.int64) << 32 | right
        at = self._slot(key)
        out = np.full(len(key), _NO_PAIR, np.int32)
        open_ = np.arange(len(key))
        for _ in range(self.probes):
            found = self.keys[at]
            hit = found == key[open_]
            out[open_[hit]] = self.values[at[hit]]
            on = ~hit & (found != -1)
            if not on.any():
                break
            open_, at = open_[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def learn(self, slices: list[bytes]) -> None:
        """Merge slices that are not cached yet."""
        short = []
        for b in slices:
            if b in self.ranks:
                self.cache[b] = array("i", (self.ranks[b],)).tobytes()
            elif len(b) > self.LONG:
                self.cache[b] = array("i", self._merge_long(b)).tobytes()
            else:
                short.append(b)
        short.sort(key=len)
        for i in range(0, len(short), 20_000):
            part = short[i : i + 20_000]
            self.cache.update(zip(part, self._merge(part), strict=True))

    def _merge(self, pieces: list[bytes]) -> list[bytes]:
        """All pieces side by side: each round makes the best merge of every piece that has one."""
        sizes = np.array([len(b) for b in pieces])
        width = int(sizes.max())
        columns = np.arange(width)
        ids = np.full((len(pieces), width + 1), -1, np.int32)
        ids[:, :-1][columns[None, :] < sizes[:, None]] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = np.full((len(pieces), width), _NO_PAIR, np.int32)
        rows, cols = np.nonzero(ids[:, 1:] >= 0)
        rank[rows, cols] = self._rank(ids[rows, cols], ids[rows, cols + 1])
        out: list[bytes] = [b""] * len(pieces)
        names = np.arange(len(pieces))
        while True:
            at = rank.argmin(1)
            best = rank[np.arange(len(rank)), at]
            go = best < _NO_PAIR
            if not go.all():
                over = ~go
                sizes = (ids[over] >= 0).sum(1).tolist()
                flat, wide = ids[over].tobytes(), 4 * ids.shape[1]
                for k, (name, n) in enumerate(zip(names[over].tolist(), sizes, strict=True)):
                    out[name] = flat[k * wide : k * wide + 4 * n]
                ids, rank, names, at, best = ids[go], rank[go], names[go], at[go], best[go]
            if not len(names):
                return out
            # Drop the right half of the pair and close the gap; then two pairs are new.
            late = columns[None, :] > at[:, None]
            ids[:, :-1] = np.where(late, ids[:, 1:], ids[:, :-1])
            rank[:, :-1] = np.where(late[:, :-1], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = _NO_PAIR
            row = np.arange(len(names))
            ids[row, at] = best
            right = ids[row, at + 1]
            rank[row, at] = np.where(right >= 0, self._rank(best, right), _NO_PAIR)
            inner = np.flatnonzero(at > 0)
            rank[inner, at[inner] - 1] = self._rank(ids[inner, at[inner] - 1], best[inner])

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """One long piece: a heap of pairs over a linked list, n log n."""
        n = len(piece)
        part: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, 1, 1) for i in range(n - 1) if (r := self.ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if part[i] is not None else n
            if j >= n or len(part[i]) != a or len(part[j]) != b:
                continue
            part[i], part[j] = part[i] + part[j], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := self.ranks.get(part[x] + part[y])) is not None:
                    heapq.heappush(heap, (r, x, len(part[x]), len(part[y])))
        return tuple(self.ranks[x] for x in part if x is not None)

    def encode(self, texts: list[str]) -> Iterator[tuple[list[bytes], np.ndarray]]:
        """For each text, the ids of its slices (native 32-bit numbers) and the slices' starts (code points)."""
        firsts = np.cumsum([0, *map(len, texts)])
        whole = "".join(texts)
        at = token_starts(whole, firsts[:-1])
        data = whole.encode("utf-8", "surrogatepass")
        leads = at if len(data) == len(whole) else np.flatnonzero((np.frombuffer(data, np.int8) >= -64))[at]  # other bytes continue a character
        edges = [*leads.tolist(), len(data)]
        slices = [data[i:j] for i, j in zip(edges, edges[1:])]  # noqa: B905
        if len(self.cache) > self.CACHED:
            self.cache.clear()
        coded = list(map(self.cache.get, slices))
        if None in coded:
            self.learn(list({s for s, c in zip(slices, coded, strict=True) if c is None}))
            coded = list(map(self.cache.__getitem__, slices))
        bounds = np.searchsorted(at, firsts)
        for i in range(len(texts)):
            yield coded[bounds[i] : bounds[i + 1]], at[bounds[i] : bounds[i + 1]] - firsts[i]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


_NO_PAIR = 1 << 30


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 bytes and id on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def read_json(path: str) -> dict[bytes, int]:
    """Ranks of a byte-level BPE model saved as JSON, whose ids follow the order of its merges.

    Tokens are spelled in printable stand-ins for bytes; special tokens are left out.
    """
    import json

    with open(path, encoding="utf-8") as f:
        saved = json.load(f)
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    stand_in = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = {t["content"] for t in saved.get("added_tokens", [])}
    ranks = {bytes(stand_in[c] for c in token): i for token, i in saved["model"]["vocab"].items() if token not in special}
    last = -1
    for merge in saved["model"]["merges"]:
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        if (now := saved["model"]["vocab"][a + b]) < last:
            raise ValueError("ids do not follow the order of the merges")
        last = now
    return ranks


@cache
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary in a file, once for each Python worker."""
    return Vocabulary(read_json(path) if path.endswith(".json") else read_ranks(path))


def blocks(texts: list[str], most: int = 250_000) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about ``most`` characters together; a longer text is a block alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, texts[start:]


@cache
def added_tokens(path: str) -> tuple[re.Pattern | None, dict[str, int]]:
    """Tokens that a saved model reads whole wherever a text spells them, leftmost and longest first, and their ids."""
    import json

    if not path.endswith(".json"):
        return None, {}
    with open(path, encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f).get("added_tokens", [])}
    return re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None, added


def text_ids(texts: list[str], path: str) -> Iterator[np.ndarray]:
    """The ids of each text; the added tokens of a saved model stand for themselves, and what lies between them is coded apart."""
    v = vocabulary(path)
    pattern, added = added_tokens(path)
    for _, block in blocks(texts):
        split = {i: pattern.split(t) for i, t in enumerate(block) if any(a in t for a in added)}
        plain = [t if i not in split else "" for i, t in enumerate(block)]
        for i, (coded, _) in enumerate(v.encode(plain)):
            if i in split:
                parts = [np.array([added[t]], np.int32) if k % 2 else np.frombuffer(b"".join(next(v.encode([t]))[0]), np.int32) for k, t in enumerate(split[i])]
                yield np.concatenate(parts)
            else:
                yield np.frombuffer(b"".join(coded), np.int32)


def coded_texts(texts: list[str], path: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text: ids, number of ids of each slice, start of each slice (code points)."""
    v = vocabulary(path)
    for _, block in blocks(texts):
        for coded, starts in v.encode(block):
            yield np.frombuffer(b"".join(coded), np.int32), np.fromiter(map(len, coded), np.int32, len(coded)) // 4, starts


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.empty(0), kind))


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids, and for each id the start of its slice in the text (code points).

    One row for each row of ``docs``; a null text counts as empty and has no ids, very
    long texts are whole, other columns are ignored.  Nothing is shuffled; a task
    holds a few hundred thousand characters, or one text, at a time.
    """

    def task(batches):
        for batch in batches:
            names = batch.column(0)
            for first, block in blocks(batch.column(1).to_pylist()):
                ids, at = [], []
                for i, sizes, starts in coded_texts(block, path):
                    ids.append(i)
                    at.append(np.repeat(starts, sizes))
                yield pa.RecordBatch.from_arrays([names.slice(first, len(block)), _lists(ids, pa.int32()), _lists(at, pa.int32())], ["doc_id", "ids", "starts"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(task, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, starts array<int>")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """``coded`` (doc_id, ids, ...) with ``decoded``, the bytes that the ids stand for; null ids give null."""

    def task(batches):
        v = vocabulary(path)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            decoded = [None if x is None else v.decode(x.values.to_numpy(zero_copy_only=False).tolist()) for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], [*batch.schema.names, "decoded"])

    return coded.mapInArrow(task, T.StructType([*coded.schema.fields, T.StructField("decoded", T.BinaryType())]))
