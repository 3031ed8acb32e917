"""Words of many texts at once, as numpy arrays of positions and 64-bit hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes that tasks take at once; a longer text is a block alone.
BLOCK = 2_000_000
#: The same for tasks whose arrays have many bytes for each of a text.
SMALL = 500_000
#: Bytes from which on a word's polynomial hash is not trusted.
LONG = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def numbers(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(bits: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """At least 2**bits powers of ``base`` and of its inverse; the longest asked for are kept, since shorter ones are their beginnings."""
    n = 1 << bits
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        inverse = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inverse):
            p = np.full(n, b, U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[base] = out[0], out[1]
    return _POWERS[base]


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = 0x9E3779B97F4A7C15 | 1) -> np.ndarray:
    """Polynomial hashes, modulo 2**64, of values[start:end] for many ranges in linear time.

    Thue-Morse sequences of 1,024 values and their complements are equal for every base: for short ranges only.
    """
    power, inverse = _powers(max(10, int(len(values)).bit_length()), base)
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * power[: len(values)], out=total[1:])
    return (total[ends] - total[starts]) * inverse[starts]


def sequences(values: np.ndarray, bounds: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of values[bounds[i]:bounds[i + 1]], of any length, whose values are hashes themselves."""
    values, bounds = values[bounds[0] : bounds[-1]], bounds - bounds[0]
    place = np.arange(len(values)) - np.repeat(bounds[:-1], np.diff(bounds))
    total = np.zeros(len(values) + 1, U)
    np.cumsum(mix(values + place.astype(U) * U(0x9E3779B97F4A7C15) + U(seed)), out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


@dataclass
class Words:
    """``starts`` and ``ends`` of words in ``data``; words of text i are bounds[i] to bounds[i + 1]."""

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def hashes(self) -> np.ndarray:
        bytes_ = _BYTES[np.frombuffer(self.data, np.uint8)]
        return self.digested(mix(rolling(bytes_, self.starts, self.ends) + (self.ends - self.starts).astype(U)), b"first")

    def digested(self, hashes: np.ndarray, key: bytes) -> np.ndarray:
        """``hashes`` of the words, with digests in place of those of words from LONG bytes on."""
        for i in np.flatnonzero(self.ends - self.starts >= LONG).tolist():
            hashes[i] = int.from_bytes(hashlib.blake2b(self.data[self.starts[i] : self.ends[i]], digest_size=8, key=key).digest(), "little")
        return hashes

    def text(self, i: int) -> np.ndarray:
        return np.arange(self.bounds[i], self.bounds[i + 1])


_BYTES = numbers(256, 11)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True

#: All but ASCII letters and digits, and bytes of other characters.
PUNCTUATION = np.array([not (0x30 <= i <= 0x39 or 0x41 <= i <= 0x5A or 0x61 <= i <= 0x7A or i >= 0x80) for i in range(256)])


def split(texts: list[bytes], between: np.ndarray = _BLANK) -> Words:
    """The runs of bytes that ``between`` does not mark: those outside U+0020 and U+0009 to U+000D."""
    data = b"\n".join([*texts, b""])
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~between[np.frombuffer(data, np.uint8)]
    change = np.diff(inside)
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return Words(data, starts, ends, np.searchsorted(starts, edges))


def lower(text: bytes) -> bytes:
    """A-Z lower-cased, nothing else: bytes.lower knows only ASCII."""
    return text.lower()


def blocks(texts: list[str | None], most: int = BLOCK) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts (null: empty) as UTF-8, of about ``most`` bytes together."""
    start, size, out = 0, 0, []
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass")
        if size and size + len(b) > most:
            yield start, out
            start, size, out = i, 0, []
        out.append(b)
        size += len(b)
    if out:
        yield start, out


def text_blocks(column: pa.Array, most: int = SMALL) -> Iterator[tuple[int, list[bytes]]]:
    """As ``blocks``, of a column of texts: never more of it than a block is held as Python's own bytes."""
    start = size = 0
    sizes = pc.binary_length(column).fill_null(0).to_pylist()
    column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    for end, n in enumerate([*sizes, most]):
        if size + n > most and end > start or end == len(sizes) > start:
            yield start, [b or b"" for b in column.slice(start, end - start).to_pylist()]
            start, size = end, 0
        size += n
