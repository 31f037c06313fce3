"""Vectorised work on many texts at once inside a task.

Texts of an Arrow batch are laid out in slabs of a few megabytes: one buffer of
UTF-8 bytes in which every text is followed by a newline. Words, lines and
n-grams of a whole slab are then found and hashed by a handful of numpy
operations. Memory follows the slab size, or the longest text if that is longer.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Hashes are
64-bit polynomials over random byte values, finished by a mixer; equal words
have equal hashes on every machine because all constants are fixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLAB_BYTES = 2 << 20
GOLDEN = 0x9E3779B97F4A7C15

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BASE = 0xD6E8FEB86659FD93
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below ``n``."""
    if len(_powers[0]) < n:
        size = max(n, SLAB_BYTES + 4096)
        for k, base in enumerate((BASE, BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def combine(*parts: np.ndarray) -> np.ndarray:
    """Order-dependent hash of several 64-bit columns."""
    h = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        h = mix((h ^ p) * np.uint64(GOLDEN) + np.uint64(0x632BE59BD9B4E019))
    return h


class Slab:
    """A buffer of texts: text i occupies bytes ``start[i]`` to ``end[i]`` of ``data``."""

    def __init__(self, texts: list, rows: np.ndarray):
        self.rows = rows
        self.raw = b"\n" + b"\n".join(texts) + b"\n"
        self.data = np.frombuffer(self.raw, np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.end = np.cumsum(sizes + 1)
        self.start = self.end - sizes

    def __len__(self) -> int:
        return len(self.start)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of every word, and the index of its text."""
        solid = ~SPACE[self.data]
        turn = np.flatnonzero(solid[1:] != solid[:-1]) + 1
        first, last = turn[::2], turn[1::2]
        per_text = np.searchsorted(first, self.end) - np.searchsorted(first, self.start)
        return first, last, np.repeat(np.arange(len(self)), per_text)

    def hashes(self, first: np.ndarray, last: np.ndarray, lower: bool) -> np.ndarray:
        """Hash of each byte span; ``lower`` folds A-Z."""
        up, down = powers(len(self.data))
        values = BYTE_VALUES[LOWER] if lower else BYTE_VALUES
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(values[self.data] * up, out=sums[1:])
        return mix((sums[last] - sums[first]) * down[first])


def starts_of(owner: np.ndarray, n: int) -> np.ndarray:
    """Offsets (n + 1 of them) of each owner's run in a sorted owner column."""
    return np.searchsorted(owner, np.arange(n + 1))


def windows(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``n`` items that stays within one owner, and its first index."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = len(hashes) - n + 1
    at = np.flatnonzero(owner[:size] == owner[n - 1:])
    return combine(*[hashes[k:k + size][at] for k in range(n)]), at


def slabs(batch: pa.RecordBatch, column: str = "text", limit: int = SLAB_BYTES) -> Iterator[Slab]:
    """Cut a batch into slabs of about ``limit`` bytes. NULL counts as an empty text."""
    col = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_null(col.type):
        col = col.cast(pa.string())
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    if not n:
        return
    _, offsets, data = col.buffers()
    edges = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset:col.offset + n + 1]
    edges = edges.astype(np.int64)
    view = memoryview(data) if data is not None else memoryview(b"")
    missing = np.asarray(col.is_null())
    begin = 0
    while begin < n:
        end = int(np.searchsorted(edges, edges[begin] + limit, "right")) - 1
        end = min(max(end, begin + 1), n)
        texts = [b"" if missing[i] else view[edges[i]:edges[i + 1]] for i in range(begin, end)]
        yield Slab(texts, np.arange(begin, end))
        begin = end


def fields(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)],
        schema=schema)
