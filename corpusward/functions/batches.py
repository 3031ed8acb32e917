"""Arrow batches in slices of a bounded number of bytes."""

from __future__ import annotations

import pyarrow.compute as pc

#: Bytes of texts that a task works on at once; a longer text is alone.
BLOCK = 1_000_000


def in_blocks(batches, text: int, most: int | None = None):
    """Consecutive slices of ``batches`` with about ``most`` bytes (BLOCK) in column ``text``: what a task makes of a batch is not held whole."""
    most = most or BLOCK
    for batch in batches:
        start = size = 0
        for i, n in enumerate(pc.binary_length(batch.column(text)).to_pylist()):
            if size and size + (n or 0) > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n or 0
        yield batch.slice(start)
