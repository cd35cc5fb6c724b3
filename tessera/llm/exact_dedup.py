"""Exact deduplication by a log-structured merge index of text digests.

Each task fills a memtable, a map from normalised text to the identifiers that have it. A full
memtable is flushed as a run: entries (digest, identifiers) in digest order. Because the map's keys
are the texts, two texts share an entry only if their bytes are equal. Compaction deals the runs out by
digest and merges them: entries come in digest order, those of one digest become one, and the smallest
identifier in the chosen order stays; nothing is held but the entry at hand. A merged entry that several
runs had is a hit; the hits' filter, sized by their number, lets a second scan send only the texts that
need it, once per memtable, to a comparison of bytes. Digests whose texts turn out to differ are
resolved by the texts themselves.

Only digests and identifiers are shuffled, besides the texts of hits. A group of copies, however
large, is one entry per memtable, so no task gets its rows together. The filter grows with the hits up to
`most_bits`; beyond that it lets more texts through than need be, and the result is the same.

Defined results: a null text counts as empty; a null identifier counts as the last choice to stay;
of rows that repeat both identifier and text, exactly one stays; an empty table gives no rows; other
columns, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm import shared

_ENTRY = "digest binary, sha binary, run string, slot int, best long, ids array<long>"
_ENTRY_ARROW = pa.schema([("digest", pa.binary()), ("sha", pa.binary()), ("run", pa.string()), ("slot", pa.int32()), ("best", pa.int64()), ("ids", pa.list_(pa.int64()))])
_SEGMENTS = 64


def _texts(column: pa.Array) -> Iterator[bytes]:
    """Lower-cased (A-Z only) bytes of each text."""
    raw, offsets = K.byte_view(column)
    data = memoryview(raw)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield bytes(data[a:b]).lower()


def _positions(digest: bytes, bits: int) -> list[int]:
    h = hashlib.blake2b(digest, digest_size=32).digest()
    return [int.from_bytes(h[i : i + 8], "little") % bits for i in range(0, 32, 8)]


def _flush(table: dict[bytes, list], run: str, pick, cut: int) -> Iterator[pa.RecordBatch]:
    """The memtable as a run in digest order."""
    rows = sorted((hashlib.sha256(t).digest(), ids) for t, ids in table.items())
    best = [next((i for i in ids if i is None), None) if all(i is None for i in ids) else pick(i for i in ids if i is not None) for _, ids in rows]
    slot = [ids.index(b) for (_, ids), b in zip(rows, best, strict=True)]
    for lo in range(0, len(rows), 20_000):
        part = rows[lo : lo + 20_000]
        columns = [[s[:cut] for s, _ in part], [s for s, _ in part], [run] * len(part), slot[lo : lo + 20_000], best[lo : lo + 20_000], [i for _, i in part]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _ENTRY_ARROW, strict=True)], schema=_ENTRY_ARROW)


def _runs(docs: DataFrame, keep: str, cut: int, memtable_bytes: int) -> DataFrame:
    pick = max if keep == "max" else min

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        table: dict[bytes, list] = {}
        held = 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), strict=True):
                ids = table.get(text)
                if ids is None:
                    table[text] = [i]
                    held += len(text) + 200
                else:
                    ids.append(i)
                    held += 40
                if held > memtable_bytes:
                    yield from _flush(table, f"{part}-{n}", pick, cut)
                    table, held, n = {}, 0, n + 1
        if table:
            yield from _flush(table, f"{part}-{n}", pick, cut)

    return docs.mapInArrow(K.lean(fill), _ENTRY)


def bloom(digests: DataFrame, bits: int) -> bytes:
    """Bloom filter of a one-column binary frame. Its size is the parameter's, whatever the input's."""
    each = bits // 8 // _SEGMENTS

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for d in batch.column(0).to_pylist():
                for p in _positions(d, bits):
                    own[p >> 3] |= 1 << (p & 7)
        rows = own.reshape(_SEGMENTS, each)
        some = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_pydict({"segment": pa.array(some, pa.int32()), "bits": pa.array([rows[i].tobytes() for i in some], pa.binary())})

    def join(frame):
        import pandas as pd

        out = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in frame["bits"]], axis=0)
        return pd.DataFrame({"segment": [frame["segment"].iloc[0]], "bits": [out.tobytes()]})

    schema = "segment int, bits binary"
    parts = digests.mapInArrow(K.lean(local), schema).groupBy("segment").applyInPandas(join, schema).collect()  # at most bits / 8 bytes
    whole = np.zeros((_SEGMENTS, each), np.uint8)
    for r in parts:
        whole[r["segment"]] = np.frombuffer(r["bits"], np.uint8)
    return whole.tobytes()


def _hit_texts(docs: DataFrame, hits: bytes, bits: int, cut: int, memtable_bytes: int) -> DataFrame:
    """(digest, text) of rows that the filter lets through, once per memtable."""
    sent = docs.sparkSession.sparkContext.broadcast(hits)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held = 0
        for batch in batches:
            digests, texts = [], []
            for text in _texts(batch.column(1)):
                if text in seen:
                    continue
                digest = hashlib.sha256(text).digest()[:cut]
                if all(sent.value[p >> 3] >> (p & 7) & 1 for p in _positions(digest, bits)):
                    seen.add(text)
                    held += len(text) + 100
                    digests.append(digest)
                    texts.append(text)
                if held > memtable_bytes:
                    seen, held = set(), 0
            yield pa.RecordBatch.from_pydict({"digest": pa.array(digests, pa.binary()), "body": pa.array(texts, pa.binary())})

    return docs.mapInArrow(K.lean(probe), "digest binary, body binary")


def filter_bits(keys: DataFrame, most: int) -> int:
    """Bits of a filter that lets few others than the keys through: 16 a key, a power of two, up to a bound."""
    return min(most, 1 << max(15, (16 * keys.count() - 1).bit_length()))


def _better(keep: str):
    """Order of the entries of a digest: the least one's identifier stays. Null identifiers lose to all others."""
    if keep == "max":
        return lambda best, run: (best is None, 0 if best is None else -best, run)
    return lambda best, run: (best is None, 0 if best is None else best, run)


def _merged(runs: DataFrame, keep: str, by: list[str]) -> DataFrame:
    """(by ..., winner, group_size, entries): the runs' entries of each key as one, by a merge in key order."""
    better, n = _better(keep), len(by)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None  # the key at hand, and [order, best, run, rows, entries]
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            keys = [pa.array([k[i] for k, _ in out], pa.binary()) for i in range(n)]
            rest = [pa.array([h[i] for _, h in out], t) for i, t in ((1, pa.int64()), (2, pa.string()), (3, pa.int64()), (4, pa.int64()))]
            return pa.RecordBatch.from_arrays([*keys, *rest], names=[*by, "best", "run", "group_size", "entries"])

        for rows in batches:
            for *key, best, run, size in zip(*[rows.column(i).to_pylist() for i in range(n + 3)], strict=True):
                order = better(best, run)
                if key != now:
                    if held:
                        out.append((now, held))
                        if len(out) >= 10_000:
                            yield batch()
                            out.clear()
                    now, held = key, [order, best, run, size, 1]
                else:
                    held[3] += size
                    held[4] += 1
                    if order < held[0]:
                        held[:3] = order, best, run
        if held:
            out.append((now, held))
        yield batch()

    dealt = runs.select(*by, "best", "run", F.size("ids").cast("long").alias("size")).repartition(*by).sortWithinPartitions(*by)
    merged = dealt.mapInArrow(K.lean(merge), ", ".join([*(f"{c} binary" for c in by), "best long, run string, group_size long, entries long"]))
    return merged.select(*by, F.struct("best", "run").alias("winner"), "group_size", "entries")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, keep: str = "min", digest_bytes: int = 32, memtable_bytes: int = 32 << 20, most_bits: int = 1 << 29) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, sha (of the normalised text).

    keep: "min" or "max", which identifier of a group stays. digest_bytes: bytes of the digest that
    the index is keyed by; fewer than 32 only make collisions likelier, which the comparison of bytes
    catches. memtable_bytes bounds a task's map, most_bits the filter sent to all tasks.
    """
    if keep not in ("min", "max"):
        raise ValueError(f"keep is min or max, not {keep!r}")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("body"))
    runs = shared.table(_runs(rows, keep, digest_bytes, memtable_bytes), "runs")
    index = shared.table(_merged(runs, keep, ["digest"]), "index")
    hits = index.where("entries > 1").select("digest")
    bits = filter_bits(hits, most_bits)
    texts = _hit_texts(rows, bloom(hits, bits), bits, digest_bytes, memtable_bytes).distinct()
    clash = shared.table(texts.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest"), "clash")
    if clash.isEmpty():
        judged = runs.join(index.drop("entries"), "digest")
    else:
        apart = shared.table(runs.join(clash, "digest", "left_semi").join(_sha_bodies(rows, clash, digest_bytes), "sha"), "apart")
        by_text = _merged(apart, keep, ["digest", "body"]).drop("entries")
        judged = (
            runs.join(clash, "digest", "left_anti").join(index.drop("entries"), "digest")
            .unionByName(apart.join(by_text, ["digest", "body"]).drop("body"))
        )
    member = judged.select("sha", "run", "slot", "winner", "group_size", F.posexplode("ids").alias("at", "doc_id"))
    stays = (F.col("winner.run") == F.col("run")) & F.col("winner.best").eqNullSafe(F.col("doc_id")) & (F.col("slot") == F.col("at"))
    return member.select("doc_id", F.col("winner.best").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"), stays.alias("kept"), "sha")


def _sha_bodies(rows: DataFrame, clash: DataFrame, cut: int) -> DataFrame:
    """(sha, body) of every distinct text under the digests in clash."""

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = list(set(_texts(batch.column(1))))
            shas = [hashlib.sha256(t).digest() for t in texts]
            yield pa.RecordBatch.from_pydict({"digest": pa.array([s[:cut] for s in shas], pa.binary()), "sha": pa.array(shas, pa.binary()), "body": pa.array(texts, pa.binary())})

    return rows.mapInArrow(K.lean(bodies), "digest binary, sha binary, body binary").join(clash, "digest", "left_semi").select("sha", "body").distinct()
