"""Benchmark decontamination by Wu-Manber search over words.

A test item's windows of `window` consecutive words are the patterns (an item of fewer words is one
pattern). Patterns of one length m share a shift table over blocks of two words: the scan looks at the
block that ends at the current position and moves on by the block's shift, up to m - 1 words, so most
positions are never looked at. Where the shift is 0 the block selects the bucket of patterns that end
with it; their window hashes are compared, and what agrees is confirmed by comparing the words' bytes.
Many stretches of text are scanned in step, one numpy pass for each move.

The texts are scanned where they are: no shuffle. The patterns are built and sent to the tasks in blocks
of at most `block_bytes` of test text, a few at a time; more blocks only mean more scans.

Defined results: a null or empty text, or one without words, has no words and no hit; an item without
words never occurs; an occurrence of an item whose id is null marks words but no item; items that
repeat a text all count; an empty benchmark hits nothing; carried columns keep their names inside the
struct `row`, so names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm import shared

_PASS = 4
_STRETCH = 512


def _split(text: str) -> list[bytes]:
    arr = pa.array([text])
    raw, at = K.byte_view(arr)
    buf = K.LOWER[raw[at[0] : at[1]]]
    s, e, _ = K.words(buf, np.array([0, len(buf)]), K.ALNUM)
    data = buf.tobytes()
    return [data[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)]


def _hashes_of(word_list: list[bytes]) -> np.ndarray:
    buf = np.frombuffer(b"".join(word_list), np.uint8)
    ends = np.cumsum([len(w) for w in word_list])
    return K.word_hashes(buf, ends - [len(w) for w in word_list], ends)


class Patterns:
    """Shift table and suffix buckets of the patterns of one length."""

    def __init__(self, m: int, texts: list[bytes], items: list[list[int]]) -> None:
        self.m, self.texts, self.items = m, texts, items
        h = np.stack([_hashes_of(t.split(b" ")) for t in texts])
        self.block = min(2, m)
        ends = np.arange(self.block - 1, m)
        blocks = np.stack([self._blocks(h, np.full(len(h), j), rows=True) for j in ends], axis=1)
        self.bits = max(12, int(4 * blocks.size).bit_length())
        self.shift = np.full(1 << self.bits, m - self.block + 1, np.int32)
        for k, j in enumerate(ends):
            np.minimum.at(self.shift, blocks[:, k] >> K.U64(64 - self.bits), m - 1 - j)
        last, whole = blocks[:, -1], self._whole(h.reshape(-1), np.arange(len(h)) * m)
        self.order = np.lexsort((whole, last))
        self.last, self.whole = last[self.order], whole[self.order]

    def _blocks(self, h: np.ndarray, at: np.ndarray, rows: bool = False) -> np.ndarray:
        """Hash of the block that ends at each position."""
        own = h[np.arange(len(h)), at] if rows else h[at]
        if self.block == 1:
            return K.mix(own.copy())
        return K.mix((h[np.arange(len(h)), at - 1] if rows else h[at - 1]) * K._SHIFTS[62] + own * K._SHIFTS[63])

    def _whole(self, h: np.ndarray, start: np.ndarray) -> np.ndarray:
        out = np.zeros(len(start), np.uint64)
        for k in range(self.m):
            out += h[start + k] * K._SHIFTS[k]
        return K.mix(out)

    def scan(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position of the first word, pattern) of all agreements of hashes."""
        m = self.m
        lo, hi = first[:-1] + m - 1, first[1:]
        lo, hi = lo[lo < hi], hi[lo < hi]
        if not len(lo):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        n = -(-(hi - lo) // _STRETCH)
        nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        pos = np.repeat(lo, n) + nth * _STRETCH
        end = np.minimum(pos + _STRETCH, np.repeat(hi, n))
        at, what = [], []
        while len(pos):
            block = self._blocks(h, pos)
            move = self.shift[block >> K.U64(64 - self.bits)]
            zero = np.flatnonzero(move == 0)
            if len(zero):
                a = np.searchsorted(self.last, block[zero], "left")
                b = np.searchsorted(self.last, block[zero], "right")
                zero, a, b = zero[a < b], a[a < b], b[a < b]
                whole = self._whole(h, pos[zero] - m + 1)
                while len(zero):
                    same = self.whole[a] == whole
                    at.append(pos[zero[same]] - m + 1)
                    what.append(self.order[a[same]])
                    a = a + 1
                    more = a < b
                    zero, a, b, whole = zero[more], a[more], b[more], whole[more]
            pos = pos + np.maximum(move, 1)
            on = pos < end
            pos, end = pos[on], end[on]
        return (np.concatenate(at), np.concatenate(what)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def build(items: list[tuple[str | None, str | None]], window: int) -> list[Patterns]:
    """Pattern sets by length, of (item_id, text)."""
    by: dict[int, dict[bytes, list]] = {}
    for item, text in items:
        w = _split(text or "")
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            ids = by.setdefault(m, {}).setdefault(b" ".join(w[i : i + m]), [])
            if item is not None and item not in ids:
                ids.append(item)
    return [Patterns(m, list(d), list(d.values())) for m, d in sorted(by.items())]


def _merge(spans: list[tuple[int, int]]) -> list[int]:
    """Flat, sorted, disjoint [start, end, start, end ...]."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _blocks_of(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list]:
    held, block = 0, []
    for r in benchmark.select(F.col(item_col).cast("string"), F.col(text_col)).toLocalIterator():
        block.append((r[0], r[1]))
        held += len(r[1] or "") + 50
        if held > block_bytes:
            yield block
            held, block = 0, []
    if block:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, item_col: str = "item_id", item_text_col: str = "text", window: int = 13, block_bytes: int = 8 << 20, carry: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, items, spans.

    items: sorted ids of the test items with a window in the text. spans: flat, sorted, disjoint word
    ranges [start, end, ...) that occurrences cover; n_hit is their total. carry: adds the whole input
    row as the struct `row`.
    """
    spark = docs.sparkSession
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    out = docs.select(*row, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("body"), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<string>").alias("items"), F.array().cast("array<long>").alias("spans"))
    blocks = _blocks_of(benchmark, item_col, item_text_col, block_bytes)
    first = True
    while group := list(islice(blocks, _PASS)) or ([[]] if first else []):
        if not first:  # what a scan has found is stored before the next one, so that the patterns of one scan only are held
            out = shared.table(out, "scanned")
            for s in sets:
                s.unpersist()
        sets = [spark.sparkContext.broadcast(build(b, window)) for b in group]
        out = out.mapInArrow(K.lean(_scanner(sets)), out.schema)
        first = False
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: x - a)  # ... - start + end, pair by pair
    return out.select(*(["row"] if carry else []), "doc_id", "n_words", n_hit.alias("n_hit"), "items", "spans")


def _scanner(sets: list):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [p for s in sets for p in s.value]
        for batch in batches:
            n_words = np.zeros(len(batch), np.int64)
            items: dict[int, set] = {}
            spans: dict[int, list] = {}
            body = batch.column(batch.schema.get_field_index("body"))
            for lo, _, buf, offsets in K.chunks(body):
                buf = K.LOWER[buf]
                s, e, first = K.words(buf, offsets, K.ALNUM)
                n_words[lo : lo + len(offsets) - 1] = np.diff(first)
                h, data = K.word_hashes(buf, s, e), None
                for p in patterns:
                    at, what = p.scan(h, first)
                    if not len(at):
                        continue
                    data = data or buf.tobytes()
                    row = np.searchsorted(first, at, "right") - 1
                    for a, q, r in zip(at.tolist(), what.tolist(), row.tolist(), strict=True):
                        if b" ".join([data[x:y] for x, y in zip(s[a : a + p.m].tolist(), e[a : a + p.m].tolist(), strict=True)]) == p.texts[q]:
                            items.setdefault(lo + r, set()).update(p.items[q])
                            spans.setdefault(lo + r, []).append((a - int(first[r]), a - int(first[r]) + p.m))
            yield _with(batch, n_words, items, spans)

    return scan


def _with(batch: pa.RecordBatch, n_words: np.ndarray, items: dict, spans: dict) -> pa.RecordBatch:
    """The batch with what this pass has found added to what earlier passes had."""
    index = batch.schema.get_field_index
    old_items, old_spans = batch.column(index("items")).to_pylist(), batch.column(index("spans")).to_pylist()
    for r, found in items.items():
        old_items[r] = sorted(found.union(old_items[r]))
    for r, found in spans.items():
        old = old_spans[r]
        old_spans[r] = _merge(found + list(zip(old[::2], old[1::2], strict=True)))
    columns = list(batch.columns)
    columns[index("n_words")] = pa.array(n_words, pa.int64())
    columns[index("items")] = pa.array(old_items, pa.list_(pa.string()))
    columns[index("spans")] = pa.array(old_spans, pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
