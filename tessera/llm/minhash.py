"""Near-duplicate detection by b-bit MinHash over word shingles, with exact confirmation.

1. One scan makes, for each text, the number of its distinct shingles, a 128-bit class key of the set,
   the low b bits of every minimum packed into longs, and band keys from the full minima. Texts with
   equal sets are one class from here on.
2. Classes that share a band key are candidates. The number of bands follows from the threshold, the
   rows in a band and the accepted chance to miss a pair at the threshold (`miss`).
3. In each bucket every class is paired with the bucket's smallest class only. Pairs whose similarity,
   estimated from equal low bits and corrected for chance collisions, is too far below the threshold
   are dropped (again by `miss`); the others are confirmed on the full sets (by 64-bit hashes, and by the
   shingles themselves where the count is so close that a collision could decide).
4. What this leaves open are pairs of a bucket that lie in different components and of which neither
   is the smallest class. The classes of such buckets get signatures ten times as long, which narrow the
   estimate, and are compared class by class in cells of similar set size; a large cell is dealt out in
   blocks. First only the few most similar partners of each class are confirmed, which joins most of
   what belongs together; then all pairs that are still in different components and pass the estimate.
5. Components of all confirmed links.

No step emits all pairs of a group: copies are one class, near copies are tied to their smallest class
in step 3, and step 4 emits pairs across components only.

Defined results: a null or empty text, or one without words, has no shingles and is linked with
nothing; fewer than `shingle` words are one shingle; a null identifier never becomes a component id
unless all of the component are null; rows that repeat an identifier are judged one by one; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm import shared
from tessera.llm.components import components
from tessera.llm.exact_dedup import _positions, bloom, filter_bits

_BLOCK = 2048
_BEST = 4
_PARTS = 64


class Plan:
    """Numbers that follow from the threshold: bands, hashes, and the least estimate to go on with."""

    def __init__(self, shingle: int, percent: int, rows: int = 6, bits: int = 2, miss: float = 1e-6) -> None:
        j = percent / 100
        self.shingle, self.percent, self.rows, self.bits = shingle, percent, rows, bits
        self.bands = math.ceil(math.log(miss) / math.log(1 - j**rows))
        self.hashes, self.long_hashes = self.bands * rows, max(2048, 10 * self.bands * rows)
        p = j + (1 - j) * 2.0**-bits
        z = math.sqrt(-2 * math.log(miss))  # Gaussian tail bound
        #: Most hashes whose low bits may differ for a pair at the threshold.
        self.most_apart, self.long_apart = (math.floor(n * (1 - p) + z * math.sqrt(n * p * (1 - p))) + 1 for n in (self.hashes, self.long_hashes))
        self.longs, self.long_longs = (-(-n * bits // 64) for n in (self.hashes, self.long_hashes))


def sets_of(buf: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, and row starts."""
    buf = K.LOWER[buf]
    s, e, first = K.words(buf, offsets, K.SPACED)
    return K.distinct_by_row(*K.shingles(K.word_hashes(buf, s, e), first, shingle))


def _class_keys(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """16 bytes of each row's set; equal sets have equal keys."""
    n = np.diff(start).astype(np.uint64)
    a = K.mix(K.sum_by_row(K.mix(values.copy()), start) + n * K._SHIFTS[60])
    b = K.mix(K.sum_by_row(K.mix(values ^ K._SHIFTS[61]), start) + n)
    return np.stack([a, b], axis=1)


def _minima(values: np.ndarray, start: np.ndarray, count: int) -> np.ndarray:
    """(hash, row) minima of non-empty rows."""
    out = np.empty((count, len(start)), np.uint64)
    work = np.empty_like(values)
    for k, a in enumerate(K.hash_family(count)):
        np.multiply(values, a, out=work)
        np.minimum.reduceat(work, start, out=out[k])
    return out


def _signatures(plan: Plan):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, buf, offsets in K.chunks(batch.column(1)):
                values, start = sets_of(buf, offsets, plan.shingle)
                n = np.diff(start)
                some = np.flatnonzero(n)
                keys = np.zeros((0, 2), np.uint64)
                packed, bands = np.zeros((0, plan.longs), np.uint64), np.zeros((0, plan.bands), np.uint64)
                if len(some):
                    at = start[:-1][some]
                    low = _minima(values, at, plan.hashes)
                    keys = _class_keys(values, np.append(at, len(values)))
                    packed = _pack(low, plan)
                    bands = np.empty((len(some), plan.bands), np.uint64)
                    salt = np.arange(1, plan.bands + 1, dtype=np.uint64) * K._SHIFTS[40]
                    for b in range(plan.bands):
                        part = low[b * plan.rows : (b + 1) * plan.rows]
                        bands[:, b] = K.mix((part * K._SHIFTS[: plan.rows, None]).sum(axis=0, dtype=np.uint64) + salt[b : b + 1])
                yield _rows(ids.slice(lo, hi - lo), n, some, keys, packed, bands)

    return sign


def _pack(low: np.ndarray, plan: Plan) -> np.ndarray:
    per = 64 // plan.bits
    out = np.zeros((low.shape[1], -(-low.shape[0] // per)), np.uint64)
    mask = K.U64((1 << plan.bits) - 1)
    for k in range(low.shape[0]):
        out[:, k // per] |= (low[k] & mask) << K.U64(plan.bits * (k % per))
    return out


def _nested(values: np.ndarray, n: int, some: np.ndarray) -> pa.Array:
    """A list for each of n rows; rows not in `some` have an empty one."""
    size = np.zeros(n + 1, np.int32)
    size[some + 1] = values.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.cumsum(size, dtype=np.int32)), pa.array(values.reshape(-1).view(np.int64)))


def _binary(keys: np.ndarray, n: int, some: np.ndarray) -> pa.Array:
    at = np.full(n, -1)
    at[some] = np.arange(len(some))
    data = keys.astype(">u8").tobytes()
    return pa.array([data[16 * i : 16 * i + 16] if i >= 0 else None for i in at.tolist()], pa.binary())


def _rows(ids: pa.Array, n: np.ndarray, some: np.ndarray, keys: np.ndarray, packed: np.ndarray, bands: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"doc_id": ids, "n": pa.array(n, pa.int64()), "klass": _binary(keys, len(n), some), "sig": _nested(packed, len(n), some), "bands": _nested(bands, len(n), some)})


def _apart(x: str, y: str, plan: Plan) -> Column:
    """Hashes whose low bits differ."""
    low = sum(1 << i for i in range(0, 64, plan.bits))
    low = low - (1 << 64) if low >= 1 << 63 else low

    def differ(p: Column, q: Column) -> Column:
        d = p.bitwiseXOR(q)
        for i in range(1, plan.bits):
            d = d.bitwiseOR(F.shiftrightunsigned(p.bitwiseXOR(q), i))
        return F.bit_count(d.bitwiseAND(F.lit(low)))

    return F.aggregate(F.zip_with(x, y, differ), F.lit(0), lambda a, v: a + v)


def _bodies(docs: DataFrame, wanted: DataFrame, plan: Plan, most_bits: int) -> DataFrame:
    """(klass, body) of the wanted classes, one text each; the filter, sized by them, lets a few others through."""
    bits = filter_bits(wanted, most_bits)
    sent = docs.sparkSession.sparkContext.broadcast(bloom(wanted, bits))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for lo, _, buf, offsets in K.chunks(batch.column(1)):
                values, start = sets_of(buf, offsets, plan.shingle)
                some = np.flatnonzero(np.diff(start))
                if not len(some):
                    continue
                data = _class_keys(values, np.append(start[:-1][some], len(values))).astype(">u8").tobytes()
                keys, rows = [], []
                for i, r in enumerate(some.tolist()):
                    key = data[16 * i : 16 * i + 16]
                    if key not in seen and all(sent.value[p >> 3] >> (p & 7) & 1 for p in _positions(key, bits)):
                        seen.add(key)
                        keys.append(key)
                        rows.append(r)
                if len(seen) > 500_000:
                    seen.clear()
                raw = buf.tobytes()
                texts = [raw[offsets[r] : offsets[r + 1]] for r in rows]
                yield pa.RecordBatch.from_pydict({"klass": pa.array(keys, pa.binary()), "body": pa.array(texts, pa.binary())})

    return docs.mapInArrow(K.lean(pick), "klass binary, body binary").dropDuplicates(["klass"])


def shared_counts(left: pa.Array, right: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of texts: sizes of the common set and of the two sets."""
    n = len(left)
    common, sizes = np.zeros(n, np.int64), [np.zeros(n, np.int64), np.zeros(n, np.int64)]
    raws = [K.byte_view(c) for c in (left, right)]
    lo = 0
    while lo < n:
        hi = lo + 1
        while hi < n and sum(int(o[hi + 1] - o[lo]) for _, o in raws) <= K.CHUNK_BYTES:
            hi += 1
        got = [sets_of(raw[o[lo] : o[hi]], o[lo : hi + 1] - o[lo], shingle) for raw, o in raws]
        for k, (_, start) in enumerate(got):
            sizes[k][lo:hi] = np.diff(start)
        values = np.concatenate([v for v, _ in got])
        row = np.concatenate([np.repeat(np.arange(hi - lo), np.diff(s)) for _, s in got])
        order = np.lexsort((values, row))
        v, r = values[order], row[order]
        twice = (v[1:] == v[:-1]) & (r[1:] == r[:-1])
        common[lo:hi] = np.bincount(r[1:][twice], minlength=hi - lo)
        lo = hi
    return common, sizes[0], sizes[1]


def shingle_set(text: bytes, shingle: int) -> set[tuple[bytes, ...]]:
    """The shingles themselves, without hashes."""
    low = K.LOWER[np.frombuffer(text, np.uint8)]
    s, e, _ = K.words(low, np.array([0, len(low)]), K.SPACED)
    data = low.tobytes()
    w = [data[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)]
    return {tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} if w else set()


def linked(left: pa.Array, right: pa.Array, shingle: int, percent: int) -> np.ndarray:
    """Whether each pair of texts reaches the threshold. Sets are counted by hashes; where a few equal hashes could decide, by the shingles."""
    common, x, y = shared_counts(left, right, shingle)
    over = 100 * common - percent * (x + y - common)
    ok = over >= 0
    for i in np.flatnonzero(np.abs(over) <= 3 * (100 + percent)).tolist():
        a, b = (shingle_set(c[i].as_py(), shingle) for c in (left, right))
        ok[i] = 100 * len(a & b) >= percent * len(a | b)
    return ok


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("klass")).unionByName(pairs.select(F.col("b").alias("klass"))).distinct()


def _confirmed(pairs: DataFrame, bodies: DataFrame, plan: Plan) -> DataFrame:
    """Those of the pairs (a, b) of classes that reach the threshold on the full sets."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = pa.array(linked(batch.column(2), batch.column(3), plan.shingle, plan.percent))
            yield pa.RecordBatch.from_pydict({"a": batch.column(0).filter(ok), "b": batch.column(1).filter(ok)})

    both = pairs.join(bodies.withColumnsRenamed({"klass": "a", "body": "x"}), "a").join(bodies.withColumnsRenamed({"klass": "b", "body": "y"}), "b")
    return shared.table(both.select("a", "b", "x", "y").mapInArrow(K.lean(confirm), "a binary, b binary"), "confirmed")


def _estimated(pairs: DataFrame, nodes: DataFrame, plan: Plan) -> DataFrame:
    """Pairs that the set sizes and the low bits leave possible."""
    side = nodes.select("klass", "n", "sig")
    both = pairs.join(side.withColumnsRenamed({"klass": "a", "n": "na", "sig": "sa"}), "a").join(side.withColumnsRenamed({"klass": "b", "n": "nb", "sig": "sb"}), "b")
    return both.where((100 * F.least("na", "nb") >= plan.percent * F.greatest("na", "nb")) & (_apart("sa", "sb", plan) <= plan.most_apart)).select("a", "b")


def _cell_pairs(plan: Plan, best: int | None):
    """Pairs of each cell that pass the long estimate, of rows in order of their cells.

    best: only so many most similar partners of each class.
    """
    low = K.U64(sum(1 << i for i in range(0, 64, plan.bits)))

    def compare(c: dict) -> Iterator[tuple]:
        key, cell, ij = c["key"], c["cell"], c["ij"]
        cut = np.flatnonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1]) | (ij[1:] != ij[:-1])) + 1
        for lo, hi in zip(np.append(0, cut).tolist(), np.append(cut, len(key)).tolist(), strict=True):
            comp, klass = c["comp"][lo:hi], c["klass"][lo:hi]
            names = {x: i for i, x in enumerate(dict.fromkeys(comp))}
            if len(names) < 2:
                continue
            label = np.array([names[x] for x in comp])
            s, own, m, z, p = c["sig"][lo:hi], c["bands"][lo:hi], c["n"][lo:hi], c["size_class"][lo:hi], c["part"][lo:hi]
            i, j = divmod(int(ij[lo]), 1 << 20)
            for x in range(hi - lo):
                y = np.arange(0 if best else x + 1, hi - lo)
                # a pair belongs to the cell of its smaller size class, and to the block of its two parts
                ok = (label[y] != label[x]) & (np.minimum(z[y], z[x]) == cell[lo]) & (100 * np.minimum(m[y], m[x]) >= plan.percent * np.maximum(m[y], m[x]))
                ok &= (np.minimum(p[y], p[x]) == i) & (np.maximum(p[y], p[x]) == j)
                y = y[ok]
                # and to the first bucket that the two share
                y = y[own[y, (own[y] == own[x]).argmax(axis=1)] == key[lo]]
                if not len(y):
                    continue
                d = s[y] ^ s[x]
                fold = d.copy()
                for k in range(1, plan.bits):
                    fold |= d >> K.U64(k)
                apart = np.bitwise_count(fold & low).sum(axis=1)
                near = np.flatnonzero(apart <= plan.long_apart)
                if best and len(near) > best:
                    near = near[np.argpartition(apart[near], best - 1)[:best]]
                for w in y[near].tolist():
                    a, b = klass[x], klass[w]
                    yield (a, b) if a > b else (b, a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        done = False
        batches = iter(batches)
        while not done:
            batch = next(batches, None)
            done = batch is None
            if batch is not None:
                more = pa.Table.from_batches([batch])
                held = more if held is None else pa.concat_tables([held, more])
            if held is None or not held.num_rows:
                continue
            c = {x: held.column(x).combine_chunks().to_numpy(zero_copy_only=False) for x in ("key", "cell", "size_class", "part", "ij", "n")}
            end = held.num_rows
            if not done:  # the last cell may go on in the next batch
                whole = (c["key"] != c["key"][-1]) | (c["cell"] != c["cell"][-1]) | (c["ij"] != c["ij"][-1])
                end = int(np.flatnonzero(whole)[-1]) + 1 if whole.any() else 0
            if end:
                c = {x: v[:end] for x, v in c.items()}
                c["sig"], c["bands"] = (held.column(x).combine_chunks().slice(0, end).flatten().to_numpy(zero_copy_only=False).reshape(end, -1) for x in ("sig", "bands"))
                c["sig"] = c["sig"].view(np.uint64)
                c["comp"], c["klass"] = (held.column(x).slice(0, end).to_pylist() for x in ("comp", "klass"))
                found = set(compare(c))
                yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([y for _, y in found], pa.binary())})
            held = held.slice(end) if end < held.num_rows else None

    return run


def _long_signatures(bodies: DataFrame, plan: Plan) -> DataFrame:
    """(klass, sig) with the long signatures."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in K.chunks(batch.column(1), K.CHUNK_BYTES // 8, 1024):
                values, start = sets_of(buf, offsets, plan.shingle)
                packed = _pack(_minima(values, start[:-1], plan.long_hashes), plan)
                yield pa.RecordBatch.from_pydict({"klass": batch.column(0).slice(lo, hi - lo), "sig": _nested(packed, hi - lo, np.arange(hi - lo))})

    return bodies.mapInArrow(K.lean(sign), "klass binary, sig array<long>")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (key, klass, comp) of buckets with several components; the smallest class has been compared already."""
    own = members.join(labels.withColumnRenamed("node", "klass"), "klass", "left").withColumn("comp", F.coalesce("component", "klass")).drop("component")
    mixed = own.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("members")).where("lo <> hi and members > 2").select("key")
    return own.where("klass <> center").join(mixed, "key", "left_semi").select("key", "klass", "comp")


def _open_pairs(rows: DataFrame, sized: DataFrame, plan: Plan, best: int | None) -> DataFrame:
    """Pairs in a bucket but in different components that pass the estimate. sized: (klass, n, bands, size_class, sig)."""
    # a pair's size classes differ by one at most (two, where rounding falls badly): each row also goes to the cells below
    cells = rows.join(sized.select("klass", "size_class"), "klass").select("*", F.explode(F.array(F.col("size_class"), F.col("size_class") - 1, F.col("size_class") - 2)).alias("cell"))
    cells = shared.table(cells, "cells")
    blocks = cells.groupBy("key", "cell").agg(F.ceil(F.count("*") / _BLOCK).cast("long").alias("blocks"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("size_class").alias("least")).where("lo <> hi and least = cell").select("key", "cell", "blocks")
    dealt = cells.join(blocks, ["key", "cell"]).withColumn("part", F.pmod(F.xxhash64("klass"), F.col("blocks")))
    ij = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.least(o, F.col("part")) * (1 << 20) + F.greatest(o, F.col("part")))
    dealt = dealt.withColumn("ij", F.explode(ij)).join(sized.select("klass", "n", "sig", "bands"), "klass").select("key", "cell", "size_class", "part", "ij", "comp", "klass", "n", "sig", "bands")
    dealt = dealt.repartition(max(_PARTS, shared.rows_hint(rows)), "key", "cell", "ij").sortWithinPartitions("key", "cell", "ij")
    return shared.table(dealt.mapInArrow(K.lean(_cell_pairs(plan, best)), "a binary, b binary").distinct(), "pairs")


def _linked(labels: DataFrame, links: DataFrame) -> DataFrame:
    return components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))


def _rest(members: DataFrame, nodes: DataFrame, labels: DataFrame, texts: DataFrame, plan: Plan, most_bits: int) -> DataFrame:
    """labels with the links among what the first round left open."""
    rows = shared.table(_labelled(members, labels), "open")
    if rows.isEmpty():
        return labels
    bodies = shared.table(_bodies(texts, rows.select("klass").distinct(), plan, most_bits), "bodies")
    size_class = F.floor(F.log(F.col("n")) / math.log(100 / plan.percent)).cast("long")
    sized = shared.table(_long_signatures(bodies, plan).join(nodes.select("klass", "n", "bands"), "klass").withColumn("size_class", size_class), "sized")
    shared.rest(texts.sparkSession)
    labels = _linked(labels, _confirmed(_open_pairs(rows, sized, plan, _BEST), bodies, plan))
    rows = shared.table(_labelled(members, labels), "open")
    return _linked(labels, _confirmed(_open_pairs(rows, sized, plan, None), bodies, plan))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, percent: int = 80, rows: int = 6, bits: int = 2, miss: float = 1e-6, most_bits: int = 1 << 29) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Texts are linked if 100 * common >= percent * union of their sets of lower-cased (A-Z) word
    shingles. rows: minima in a band; bits: low bits kept of each minimum; miss: accepted chance to miss
    a pair at the threshold, for the bands and for the estimate; most_bits: bound of the filters of
    candidates that are sent to all tasks (beyond it more texts are sent than need be). kept: doc_id is component_id.
    """
    plan = Plan(shingle, percent, rows, bits, miss)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("body"))
    signed = shared.table(texts.mapInArrow(K.lean(_signatures(plan)), "doc_id long, n long, klass binary, sig array<long>, bands array<long>"), "signed")
    nodes = shared.table(signed.where("n > 0").groupBy("klass").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "nodes")
    spread = nodes.select("klass", F.explode("bands").alias("key"))
    buckets = spread.groupBy("key").agg(F.min("klass").alias("center"), F.count("*").alias("members")).where("members > 1")
    members = shared.table(spread.join(buckets.select("key", "center"), "key"), "members")
    stars = members.where("klass <> center").select(F.col("klass").alias("a"), F.col("center").alias("b")).distinct()
    stars = shared.table(_estimated(stars, nodes, plan), "stars")
    labels = components(_confirmed(stars, shared.table(_bodies(texts, _ends(stars), plan, most_bits), "bodies"), plan))
    labels = _rest(members, nodes, labels, texts, plan, most_bits)
    grouped = nodes.select("klass", "first_id").join(labels.withColumnRenamed("node", "klass"), "klass", "left").select("klass", "first_id", F.coalesce("component", "klass").alias("component"))
    least = grouped.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = grouped.join(least, "component").select("klass", "component_id")
    # texts without shingles go past the join: they have no class, and may be many
    rows = signed.select("doc_id", F.col("n").alias("n_shingles"), "klass")
    bare = rows.where("klass is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = rows.where("klass is not null").join(named, "klass").select("doc_id", "n_shingles", "component_id").unionByName(bare)
    return out.select("*", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
