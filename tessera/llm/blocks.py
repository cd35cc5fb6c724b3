"""Questions and answers between chunks of documents and tables that are partitioned by hash.

A relational plan that explodes documents to n-grams, groups these by hash and joins the groups back
moves a row for every n-gram twice. Here rows hold blocks. A chunk holds the words of many documents as
indices into its own distinct word hashes. It asks about each of its distinct n-grams once, in one row a
bucket of hashes; a task that has all rows of a bucket answers each in the order of its question; the
chunk joins the answers by place. A frequent n-gram is one entry a chunk, however many rows have it.

Chunks are stored before they are asked, so what asks and what joins see the same n-grams even if an
executor is lost between. Rows are (chunk, bucket, a, b, c, d); a chunk itself and what it has learned have
numbers below those of the buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm import shared

_CHUNK_WORDS = 200_000  # rows of some 100 kB: larger ones crowd the JVM heap
_BUCKET_KEYS = 2_000_000
_TASK_WORDS = 1_500_000
ROW = "chunk string, bucket long, a binary, b binary, c binary, d binary"
#: Instead of a bucket: a chunk itself, and what it has learned in earlier rounds.
CHUNK, KNOWN = -2, -1
_NAMES = ["chunk", "bucket", "a", "b", "c", "d"]


def packed(x: np.ndarray) -> bytes:
    """Compressed, byte planes apart."""
    import zstandard

    size = x.dtype.itemsize
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, size).T
    return np.int64(len(x)).tobytes() + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes, dtype) -> np.ndarray:
    import zstandard

    n, size = int(np.frombuffer(data[:8], np.int64)[0]), np.dtype(dtype).itemsize
    raw = zstandard.ZstdDecompressor().decompress(data[8:], max_output_size=max(n * size, 1))
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(dtype).reshape(n)


def packed_sorted(keys: np.ndarray) -> bytes:
    """Sorted 64-bit values by their differences."""
    return packed(np.diff(keys, prepend=K.U64(0)))


def unpacked_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)


def joined(parts: list[bytes]) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def parts_of(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=_NAMES)


def chunk_row(name: str, ids: list[int | None], sizes: np.ndarray, words: np.ndarray, more: bytes = b"") -> tuple:
    """A chunk's row: a = identifiers and words of its documents, b = its distinct word hashes, c = words as indices, d = more."""
    vocabulary, index = np.unique(words, return_inverse=True)
    who = np.array([0 if i is None else i for i in ids], np.int64)
    docs = np.stack([who, np.where([i is None for i in ids], -1 - sizes, sizes)]).reshape(-1)
    return name, CHUNK, packed(docs), packed_sorted(vocabulary), packed(index.astype(np.int32)), more


def _encode(kind: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, held = TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        sizes: list[np.ndarray] = []
        hashes: list[np.ndarray] = []
        for batch in batches:
            own = batch.column(0).to_pylist()
            for lo, hi, buf, offsets in K.chunks(batch.column(1)):
                buf = K.LOWER[buf]
                s, e, first = K.words(buf, offsets, kind)
                ids += own[lo:hi]
                sizes.append(np.diff(first))
                hashes.append(K.word_hashes(buf, s, e))
                held += len(s) + (hi - lo)
                if held > _CHUNK_WORDS:
                    yield batch_of([chunk_row(f"{part}-{n}", ids, np.concatenate(sizes), np.concatenate(hashes))])
                    n, held, ids, sizes, hashes = n + 1, 0, [], [], []
        if ids:
            yield batch_of([chunk_row(f"{part}-{n}", ids, np.concatenate(sizes), np.concatenate(hashes))])

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = 0
        for a in batch.column(0).to_pylist():
            size = unpacked(a, np.int64).reshape(2, -1)[1]
            n += int(np.where(size < 0, -1 - size, size).sum())
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})


class Layout:
    """Chunks of (doc_id, body) rows, and how many tasks and buckets they need."""

    def __init__(self, texts: DataFrame, kind: np.ndarray, keys_per_word: float) -> None:
        shared.rest(texts.sparkSession)
        self.chunks = shared.table(texts.mapInArrow(K.lean(_encode(kind)), ROW), "chunks")
        shared.rest(texts.sparkSession)
        self.words = self.chunks.select("a").mapInArrow(K.lean(_count), "n long").agg(F.sum("n")).first()[0] or 0
        self.tasks = max(8, shared.rows_hint(texts), -(-self.words // _TASK_WORDS))
        self.buckets = 1 << max(2 * self.tasks - 1, int(keys_per_word * self.words) // _BUCKET_KEYS).bit_length()

    def answered(self, asked: DataFrame, answer) -> DataFrame:
        """The stored answers to questions. answer: a function of a bucket's rows to their answers, in order."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in runs(batches, 1):
                for r, a in zip(rows, answer(rows), strict=True):
                    yield batch_of([(r[0], r[1], a, b"", b"", b"")])

        return shared.table(asked.repartition(self.tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(K.lean(run), ROW), "answers")

    def together(self, chunks: DataFrame, *more: DataFrame) -> DataFrame:
        """Each chunk's row, followed by what it knows and by its answers in order of their buckets; read them with `runs(batches, 0)`."""
        for rows in more:
            chunks = chunks.unionByName(rows)
        return chunks.repartition(self.tasks, "chunk").sortWithinPartitions("chunk", "bucket")


def runs(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[list[tuple]]:
    """Rows in runs of equal values of a column."""
    run: list[tuple] = []
    for batch in batches:
        for row in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
            if run and row[key] != run[0][key]:
                yield run
                run = []
            run.append(row)
    if run:
        yield run


class Chunk:
    """A chunk's documents and words, from its row."""

    def __init__(self, a: bytes, b: bytes, c: bytes) -> None:
        docs = unpacked(a, np.int64).reshape(2, -1)
        #: documents without an identifier
        self.none = docs[1] < 0
        self.ids, self.sizes = docs[0], np.where(self.none, -1 - docs[1], docs[1])
        self.first = np.zeros(len(self.sizes) + 1, np.int64)
        np.cumsum(self.sizes, out=self.first[1:])
        self.words = unpacked_sorted(b)[unpacked(c, np.int32)]
        self.row = np.repeat(np.arange(len(self.sizes)), self.sizes)
        #: words before each position in its document
        self.depth = np.arange(len(self.words)) - self.first[:-1][self.row]


def questions(chunk: str, keys: np.ndarray, extra: list[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """One row for each bucket of the sorted keys, with what else is told about each key (three columns at most)."""
    edge = np.searchsorted(keys >> K.U64(64 - (buckets.bit_length() - 1)), np.arange(buckets + 1, dtype=np.uint64))
    held: list[tuple] = []
    for k, (lo, hi) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
        if lo < hi:
            told = [packed(x[lo:hi]) for x in extra]
            held.append((chunk, k, packed_sorted(keys[lo:hi]), *told, *[b""] * (3 - len(told))))
        if len(held) == 64:
            yield batch_of(held)
            held = []
    if held:
        yield batch_of(held)
