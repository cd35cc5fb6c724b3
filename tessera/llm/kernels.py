"""Vectorised text kernels on UTF-8 bytes: a chunk of documents is one byte array plus offsets.

Splitting, case folding, word hashes and shingles are numpy passes over that array; there is no
Python loop over words. Chunks are cut at a byte budget, so the working arrays stay a fixed multiple
of it (a single longer document makes its own chunk).
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 20

#: Bytes A-Z become a-z, all others stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER.setflags(write=False)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes in the inclusive ranges."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Words between ASCII white space: [^\x20\x09-\x0D]+
SPACED = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Words of digits, a-z and everything beyond ASCII (after lower-casing): [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))

_STEP = 0x9E3779B97F4A7C15 | 5
_STEP_INV = pow(_STEP, -1, 1 << 64)
_BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_SHIFTS = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)


class _Powers:
    """Powers of the hash step and of its inverse, as long as any chunk has needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(16, int(n).bit_length())
            out = []
            for step in (_STEP, _STEP_INV):
                p = np.full(size, step, np.uint64)
                p[0] = 1
                out.append(np.multiply.accumulate(p))
            self.up, self.down = out
        return self.up, self.down


_POWERS = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def byte_view(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1] if at is not None and len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets.astype(np.int64)


def chunks(column: pa.Array, most: int = CHUNK_BYTES, rows: int = 8192) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of at most `rows` rows with about `most` bytes."""
    raw, offsets = byte_view(column)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = min(max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1), lo + rows)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(buf: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (one more at the end)."""
    n = len(buf)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(len(offsets), np.int64)
    inside = kind[buf]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = before
    after[-1] = False
    after[:-1] = inside[1:]
    cuts = offsets[1:]
    after[cuts[(cuts > 0)] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hasher(buf: np.ndarray):
    """A function (starts, ends) that hashes spans of buf: 64 bits, the same wherever the bytes stand."""
    up, down = _POWERS.upto(len(buf) + 1)
    total = np.empty(len(buf) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTES[buf] * up[: len(buf)], out=total[1:])
    return lambda starts, ends: mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word."""
    return span_hasher(buf)(starts, ends) if len(starts) else np.zeros(0, np.uint64)


class Lookup:
    """Values of a bounded set of hashes; most misses end at a table of bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.bits = max(12, int(16 * max(1, len(keys))).bit_length())
        slot = self.keys >> U64(64 - self.bits)
        self.some = np.zeros(1 << self.bits, bool)
        self.some[slot] = True
        #: where the keys of each slot begin, and how many the fullest slot has
        self.first = np.searchsorted(slot, np.arange(1 << self.bits, dtype=np.uint64)).astype(np.int32)
        self.most = int(np.bincount(slot.astype(np.int64)).max()) if len(keys) else 0

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indices into h, indices into values) of those that are there."""
        slot = h >> U64(64 - self.bits)
        near = np.flatnonzero(self.some[slot])
        if not len(near):
            return near, near
        wanted, at = h[near], self.first[slot[near]].astype(np.int64)
        same = self.keys[at] == wanted
        for _ in range(self.most - 1):
            on = np.flatnonzero(~same)
            at[on] = np.minimum(at[on] + 1, len(self.keys) - 1)
            same[on] = self.keys[at[on]] == wanted[on]
        return near[same], at[same]


def sequence_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive word hashes (also across rows; see `shingles`)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1] * _SHIFTS[0]
    for k in range(1, n):
        out += h[k : len(h) - n + 1 + k] * _SHIFTS[k]
    return mix(out)


def shingles(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each row and the index of each row's first one.

    A row of fewer than n words, but not none, has one shingle: its whole sequence.
    """
    count = np.diff(first)
    made = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    start = np.zeros(len(first), np.int64)
    np.cumsum(made, out=start[1:])
    out = np.zeros(int(start[-1]), np.uint64)
    whole = count >= n
    if whole.any():
        every = sequence_hashes(h, n)
        keep = np.zeros(len(h) + 1, np.int32)
        np.add.at(keep, first[:-1][whole], 1)
        np.add.at(keep, first[1:][whole] - n + 1, -1)
        inside = np.cumsum(keep[:-1]).astype(bool)[: len(every)]
        slot = np.repeat(whole, made)
        out[slot] = every[inside]
    for i in np.flatnonzero((count > 0) & ~whole):
        x = h[first[i] : first[i + 1]]
        out[start[i]] = mix(np.array([int(len(x)) * 0x9E37 + 1], np.uint64) + (x * _SHIFTS[32 : 32 + len(x)]).sum(dtype=np.uint64).reshape(1))[0]
    return out, start


def distinct_by_row(values: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row and the new row starts."""
    row = np.repeat(np.arange(len(start) - 1), np.diff(start))
    order = np.lexsort((values, row)) if len(start) > 2 else np.argsort(values, kind="stable")
    v, r = values[order], row[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    at = np.zeros(len(start), np.int64)
    np.cumsum(np.bincount(r[new], minlength=len(start) - 1), out=at[1:])
    return v[new], at


def sum_by_row(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sum of the values of each row; 0 for empty rows. A row's sum depends on its own values only."""
    out = np.zeros((len(start) - 1, *values.shape[1:]), values.dtype)
    some = np.flatnonzero(start[1:] > start[:-1])
    if len(some):
        out[some] = np.add.reduceat(values, start[:-1][some], axis=0)
    return out


@lru_cache(maxsize=1)
def _trimmer() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # not glibc: its allocator decides
        return None


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    if trim := _trimmer():
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """run, giving back the memory of a batch's working arrays when it asks for the next one and when it ends.

    Workers are reused by later tasks, so what they keep adds up to the executor's memory.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                _trim()

        yield from run(each())
        _trim()

    return wrapped


@lru_cache(maxsize=8)
def hash_family(n: int, seed: int = 1) -> np.ndarray:
    """n odd multipliers."""
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * U64(2) + U64(1)
