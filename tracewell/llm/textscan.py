"""Vectorised scans of text columns: words, their hashes and windows of them.

Everything works on the UTF-8 bytes of an Arrow string column. Words are
maximal runs of bytes other than the six ASCII white-space characters
``\\x20 \\x09-\\x0D``; those bytes never occur inside a multi-byte character,
so byte runs equal character runs. A word's hash is a polynomial over a
table of random 64-bit values, taken from prefix sums modulo 2**64 and mixed.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_MIX_A, _MIX_B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)

SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


#: caches that a worker keeps from task to task, by the operator's name
CACHES: dict[str, dict] = {}


def tidy(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], cache: str | None = None) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function for mapInArrow; when its task ends, freed memory goes back to the system.

    Python workers stay for later tasks, also of other operators, and would
    keep it; of the caches, the one named ``cache`` alone stays.
    """

    def kept_tidy(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for name, held in CACHES.items():
                if name != cache:
                    held.clear()
            release()

    return kept_tidy


class Seen:
    """Digests that a task has met; beyond a bound it forgets them all, which costs repeats only."""

    def __init__(self, most: int = 500_000):
        self.most, self.held = most, set()

    def first(self, digest: object) -> bool:
        """Whether a digest is met for the first time."""
        if digest in self.held:
            return False
        if len(self.held) >= self.most:
            self.held = set()
        self.held.add(digest)
        return True

    def fresh(self, found: np.ndarray) -> np.ndarray:
        """The same for an array of them."""
        return np.fromiter((self.first(x) for x in found.tolist()), bool, len(found))


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library than glibc


def _byte_table(fold: bool) -> np.ndarray:
    table = np.random.default_rng(20240229).integers(1, 2**64 - 1, 256, dtype=np.uint64)
    if fold:
        table[65:91] = table[97:123]
    return table


EXACT, FOLDED = _byte_table(False), _byte_table(True)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; kept up to a few chunks, else made anew."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        made = []
        for base in (_P, _P_INV):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        if size > 4 * CHUNK_BYTES:
            return made[0], made[1]
        _powers[:] = made
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX_A
    h = h ^ (h >> np.uint64(29))
    h = h * _MIX_B
    return h ^ (h >> np.uint64(32))


@dataclass
class Words:
    """Words of a run of documents. first[d]:first[d + 1] are the words of document d."""

    data: np.ndarray  # uint8 of all documents
    offsets: np.ndarray  # byte offsets of the documents in data
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def docs(self) -> int:
        return len(self.offsets) - 1

    def hashes(self, fold: bool = False) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        up, down = _power_tables(len(self.data) + 1)
        sums = np.empty(len(self.data) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((FOLDED if fold else EXACT)[self.data] * up[: len(self.data)], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts])


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive values; position i covers i..i+n-1."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(_P) + h[k : len(h) - n + 1 + k]
    return mix(out)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and 64-bit offsets of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if off is not None and len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past row, bytes, offsets) of runs of rows of about CHUNK_BYTES."""
    raw, offsets = buffers(column)
    at, n = 0, len(column)
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1
        to = min(max(to, at + 1), n)
        lo, hi = int(offsets[at]), int(offsets[to])
        yield at, to, raw[lo:hi], offsets[at : to + 1] - lo
        at = to


def texts(column: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, past row, their bytes) of runs of rows of about CHUNK_BYTES; null is empty."""
    for lo, hi, data, offsets in chunks(column):
        raw = data.tobytes()
        yield lo, hi, [raw[i:j] for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def scan(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Find the words of documents that lie end to end in data."""
    n = len(data)
    inside = np.empty(n + 1, bool)
    inside[:n] = ~SPACE[data]
    inside[n] = False
    before = np.empty(n + 1, bool)
    before[0] = False
    before[1:] = inside[:n]
    edge = offsets[:-1]
    edge = edge[edge < n]
    starts_mask = inside & ~before
    ends_mask = before & ~inside
    # a document's edge parts words that touch it
    touching = edge[inside[edge] & before[edge]]
    starts_mask[touching] = True
    ends_mask[touching] = True
    starts, ends = np.flatnonzero(starts_mask), np.flatnonzero(ends_mask)
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))
