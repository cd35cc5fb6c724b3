"""Substring deduplication by MinHash banding of paragraphs.

A passage that repeats rarely fills a line of its own, so paragraphs are cut by content: they are the
stretches of a text that stand in other documents as well.

1. Screen. Anchors are the least 5-word shingles of any `reach` consecutive ones, and a window is the
   `length` words from an anchor on. A run of `reach` + `length` - 1 words (25) holds such a window, the
   same one wherever the run stands. Windows ask, by hash, whether another document has them
   (`blocks`). A passage of 50 words or more that is similar by 0.8 to another has such a run: at n
   words it has (n - 4) / 45 edits at most, which leave 25 words or more between two of them.
2. Paragraphs. In the neighbourhood of the windows that are found, every 5-word shingle asks once more,
   and learns the smallest identifier that has it. Runs of `length` words or more whose shingles repeat
   are sure; shorter runs beside them count where they join them. A paragraph begins and ends with such
   runs, holds a sure one, and as many of its shingles repeat as a similarity of `percent` asks for, so
   an edited word doesn't cut it. Paragraphs of `least` words or more count.
3. Paragraphs are compared by MinHash banding: bands tuned by the accepted chance to miss a pair at the
   threshold, collisions joined, exact Jaccard of the 5-word shingles, components. Of a component the
   paragraphs of the document with the smallest identifier stay, the others are to be removed; so are
   runs of `length` words or more that an earlier document has, whatever the paragraphs they stand in.

Defined results: texts of fewer than `length` words, null and empty ones have no paragraph; repeats
within one document only aren't reported; null identifiers count as one document, before all others;
rows that repeat an identifier count as one document, but have rows of their own; an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import blocks as B
from tessera.llm import kernels as K
from tessera.llm import shared
from tessera.llm.minhash import near_dedup

_SHINGLE = 5
_NULL, _NONE = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_DIGITS = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz234567", np.uint8)
_PARAGRAPH = "row string, doc_id long, start long, end long, gone array<long>, owners array<long>, body string"


def anchors(own: B.Chunk, reach: int, length: int) -> np.ndarray:
    """Word positions where windows begin."""
    n = len(own.words)
    grams = K.sequence_hashes(own.words, _SHINGLE)
    room = own.first[1:][own.row] - np.arange(n) - length + 1  # starts from here to the last one in the document
    found = []
    if n >= reach:
        best, at = grams[: n - reach + 1].copy(), np.arange(min(len(grams), n - reach + 1))
        for k in range(1, reach):
            here = grams[k : k + len(best)]
            less = np.flatnonzero(here < best[: len(here)])
            best[less], at[less] = here[less], less + k
        found.append(at[room[: len(at)] >= reach])
    # documents with fewer starts have one window
    first, starts = own.first[:-1], own.sizes - length + 1
    few = np.flatnonzero((starts > 0) & (starts < reach))
    if len(few):
        place = first[few][:, None] + np.minimum(np.arange(reach), starts[few][:, None] - 1)
        found.append(place[np.arange(len(few)), grams[place].argmin(axis=1)])
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def window_keys(own: B.Chunk, at: np.ndarray, length: int) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    for k in range(length):
        out += own.words[at + k] * K._SHIFTS[k]
    return K.mix(out)


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key, where each distinct key begins in it, and each place's distinct key."""
    order = np.argsort(keys, kind="stable")
    new = np.append(True, keys[order][1:] != keys[order][:-1]) if len(keys) else np.zeros(0, bool)
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), back


def _who(own: B.Chunk) -> np.ndarray:
    return np.where(own.none, _NULL, own.ids)


def _screen(reach: int, length: int, buckets: int):
    """Asks about the windows at anchors: is the key in two of this chunk's rows?"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, a, b, c in zip(*[batch.column(i).to_pylist() for i in (0, 2, 3, 4)], strict=True):
                own = B.Chunk(a, b, c)
                at = anchors(own, reach, length)
                keys = window_keys(own, at, length)
                order, first, _ = _grouped(keys)
                row = own.row[at][order]
                several = np.minimum.reduceat(row, first) != np.maximum.reduceat(row, first) if len(first) else np.zeros(0, bool)
                yield from B.questions(chunk, keys[order][first], [several.astype(np.uint8)], buckets)

    return run


def _elsewhere(rows: list[tuple]) -> Iterator[bytes]:
    """For each key of a bucket, whether two rows have it: a bit each."""
    keys = [B.unpacked_sorted(r[2]) for r in rows]
    every = np.concatenate(keys)
    several = np.concatenate([B.unpacked(r[3], np.uint8) for r in rows]).astype(np.int64)
    _, back, n = np.unique(every, return_inverse=True, return_counts=True)
    found = (n + np.bincount(back, weights=several, minlength=len(n)).astype(np.int64) > 1)[back]
    lo = 0
    for k in keys:
        yield B.packed(found[lo : lo + len(k)].astype(np.uint8))
        lo += len(k)


def _shingles(own: B.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Every shingle's position, and its key."""
    at = np.flatnonzero(own.first[1:][own.row] - np.arange(len(own.words)) >= _SHINGLE)
    return at, window_keys(own, at, _SHINGLE)


def _regions(reach: int, length: int, beside: int, buckets: int):
    """The neighbourhoods of found windows as a chunk of their own, and its questions: who are the first and the last to have a shingle?"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in B.runs(batches, 0):
            own = B.Chunk(*rows[0][2:5])
            at = anchors(own, reach, length)
            if not len(at):
                continue
            found = np.concatenate([B.unpacked(r[2], np.uint8) for r in rows[1:]])
            at = at[found[_grouped(window_keys(own, at, length))[2]] > 0]
            if not len(at):
                continue
            row = own.row[at]
            lo = np.maximum(at - beside, own.first[:-1][row])
            hi = np.minimum(at + length + beside, own.first[1:][row])
            new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (lo[1:] > hi[:-1])))
            lo, hi, row = lo[new], hi[np.append(new[1:] - 1, len(hi) - 1)], row[new]
            size = hi - lo
            place = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            ids = [None if x else i for x, i in zip(own.none[row].tolist(), own.ids[row].tolist(), strict=True)]
            out = B.chunk_row(rows[0][0], ids, size, own.words[place], B.joined([B.packed(row), B.packed(lo - own.first[:-1][row])]))
            yield B.batch_of([out])
            part = B.Chunk(*out[2:5])
            at, keys = _shingles(part)
            order, first, _ = _grouped(keys)
            who = _who(part)[part.row[at]][order]
            least, most = np.minimum.reduceat(who, first), np.maximum.reduceat(who, first)
            yield from B.questions(rows[0][0], keys[order][first], [least, most - least], buckets)

    return run


def _owners(rows: list[tuple]) -> Iterator[bytes]:
    """For each key of a bucket the smallest identifier that has it, where another has it too."""
    keys = [B.unpacked_sorted(r[2]) for r in rows]
    least = np.concatenate([B.unpacked(r[3], np.int64) for r in rows])
    most = least + np.concatenate([B.unpacked(r[4], np.int64) for r in rows])
    order, first, back = _grouped(np.concatenate(keys))
    lo, hi = np.minimum.reduceat(least[order], first), np.maximum.reduceat(most[order], first)
    owner = np.where(lo < hi, lo, _NONE)[back]
    at = 0
    for k in keys:
        yield B.packed(owner[at : at + len(k)])
        at += len(k)


def _runs(hit: np.ndarray, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of hits among shingles of one row in consecutive places."""
    apart = np.append(True, (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1))
    before, after = np.append(False, hit[:-1]), np.append(hit[1:], False)
    return np.flatnonzero(hit & (apart | ~before)), np.flatnonzero(hit & (np.append(apart[1:], True) | ~after))


def _paragraphs_of(first: np.ndarray, last: np.ndarray, sure: np.ndarray, row: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """First and last shingle of each paragraph, of the runs' first and last ones.

    Of m shingles of which e don't repeat, a similarity (m - e) / (m + e) of `percent` is possible where
    e (100 + percent) <= m (100 - percent): the sum of weights over the paragraph isn't negative.
    """
    good, bad = 100 - percent, -2 * percent
    # runs that may belong together: between two of them not more is lost than two edits side by side cost
    cut = np.flatnonzero((row[first[1:]] != row[last[:-1]]) | (first[1:] - last[:-1] > 2 * _SHINGLE)) + 1
    for a, b in zip(np.append(0, cut).tolist(), np.append(cut, len(first)).tolist(), strict=True):
        if not sure[a:b].any():
            continue
        f, z, s = first[a:b].astype(np.int64), last[a:b].astype(np.int64), sure[a:b]
        own = np.cumsum((z - f + 1) * good + np.append(0, (f[1:] - z[:-1] - 1) * bad))  # up to the end of each run
        before = own - (z - f + 1) * good  # up to its start
        i = 0
        while i < len(f):
            far = np.flatnonzero(own[i:] - before[i] >= 0)
            j = i + int(far[-1])
            if s[i : j + 1].any():
                yield int(f[i]), int(z[j])
            i = j + 1


def _codes(words: np.ndarray) -> bytes:
    """Words as texts of 8 letters and digits and a space: what is compared are 40 bits of their hashes."""
    out = np.full((len(words), 9), 32, np.uint8)
    for k in range(8):
        out[:, k] = _DIGITS[(words >> K.U64(24 + 5 * k)).astype(np.int64) & 31]
    return out.tobytes()


def _paragraphs(length: int, least: int, percent: int):
    """Rows of _PARAGRAPH; gone: word ranges that an earlier document has; owners: the documents that have its windows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in B.runs(batches, 0):
            own = B.Chunk(*rows[0][2:5])
            source, place = (B.unpacked(x, np.int64) for x in B.parts_of(rows[0][5]))
            at, keys = _shingles(own)
            owner = np.concatenate([B.unpacked(r[2], np.int64) for r in rows[1:]])[_grouped(keys)[2]]
            row = own.row[at]
            found = owner != _NONE
            first, last = _runs(found, row, at)
            gone_first, gone_last = _runs(found & (owner != _who(own)[row]), row, at)
            long = gone_last - gone_first + _SHINGLE >= length
            gone_first, gone_last = gone_first[long], gone_last[long]
            out: dict[str, list] = {k: [] for k in ("row", "doc_id", "start", "end", "gone", "owners", "body")}
            for a, z in _paragraphs_of(first, last, last - first + _SHINGLE >= length, row, percent):
                lo, hi = int(at[a]), int(at[z]) + _SHINGLE
                if hi - lo < least:
                    continue
                r = int(row[a])
                shift = int(place[r] - own.first[r])
                cut: list[int] = []
                for i in range(int(np.searchsorted(gone_first, a)), int(np.searchsorted(gone_first, z, "right"))):
                    g, h = int(at[gone_first[i]]) + shift, int(at[gone_last[i]]) + _SHINGLE + shift
                    if cut and g <= cut[-1]:
                        cut[-1] = h
                    else:
                        cut += [g, h]
                owners = np.unique(owner[a : z + 1][found[a : z + 1]])
                out["row"].append(f"{rows[0][0]}-{source[r]}")
                out["doc_id"].append(None if own.none[r] else int(own.ids[r]))
                out["start"].append(lo + shift)
                out["end"].append(hi + shift)
                out["gone"].append(cut)
                out["owners"].append([None if x == _NULL else x for x in owners.tolist()])
                out["body"].append(_codes(own.words[lo:hi]).decode())
            kinds = {"row": pa.string(), "gone": pa.list_(pa.int64()), "owners": pa.list_(pa.int64()), "body": pa.string()}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A document's paragraphs as word ranges, and the words to remove."""
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_passages", "repeated_words", "removed_words", "spans", "removed", "first_docs")}
        for doc, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found.sort(key=lambda f: f["start"])
            spans = [x for f in found for x in (f["start"], f["end"])]
            removed: list[int] = []
            for f in found:
                removed += [f["start"], f["end"]] if f["linked"] and f["first_doc"] != doc else f["gone"]
            keepers = {x for f in found for x in [*f["owners"], *([f["first_doc"]] if f["linked"] else [])]}
            words = [sum(x[1::2]) - sum(x[::2]) for x in (spans, removed)]
            for k, v in zip(out, (doc, len(found), *words, spans, removed, sorted(x for x in keepers if x is not None)), strict=True):
                out[k].append(v)
        lists = ("spans", "removed", "first_docs")
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.list_(pa.int64()) if k in lists else pa.int64()) for k, v in out.items()})


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = 16, reach: int = 10, beside: int = 32, least: int = 50, percent: int = 80, miss: float = 1e-3) -> DataFrame:
    """One row per row of docs with repeats: doc_id, n_passages, repeated_words, removed_words, spans, removed, first_docs.

    spans and removed: flat word ranges [start, end, ...) that repeat elsewhere, and of them those that
    go; first_docs: the documents that keep them (null aside). length, reach: words of a window, and in
    how many consecutive shingles there is an anchor; beside: words on each side of a window in which its
    paragraph is looked for; least: words of the shortest passage that counts;
    miss: accepted chance to miss a pair of paragraphs at the threshold.
    """
    spark = docs.sparkSession
    layout = B.Layout(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("body")), K.SPACED, 0.5)
    found = layout.answered(layout.chunks.mapInArrow(K.lean(_screen(reach, length, layout.buckets)), B.ROW), _elsewhere)
    state = layout.together(layout.chunks, found).mapInArrow(K.lean(_regions(reach, length, beside, layout.buckets)), B.ROW).withColumn("asks", F.col("bucket") >= 0)
    state = shared.table(state, "regions", "asks")
    shared.release(spark, shared.opened()[-3:-1])  # the chunks and the first answers
    shared.rest(spark)
    owners = layout.answered(state.where("asks").drop("asks"), _owners)
    cut = layout.together(state.where("not asks").drop("asks"), owners).mapInArrow(K.lean(_paragraphs(length, least, percent)), _PARAGRAPH)
    paragraphs = shared.table(cut.withColumn("nth", F.monotonically_increasing_id()), "paragraphs")
    shared.release(spark, shared.opened()[-3:-1])
    del found, state, owners, cut
    shared.rest(spark)
    linked = near_dedup(paragraphs.select("nth", "body"), "nth", "body", shingle=_SHINGLE, percent=percent, rows=3, miss=miss).select(F.col("doc_id").alias("nth"), F.col("component_id").alias("component"))
    own = shared.table(paragraphs.drop("body").join(linked, "nth"), "linked")
    # in a struct nulls count, as the smallest
    ends = own.groupBy("component").agg(F.min(F.struct("doc_id")).alias("least"), F.max(F.struct("doc_id")).alias("most"))
    # stored, so that a component with many paragraphs can be split in the join
    ends = shared.table(ends.select("component", F.col("least.doc_id").alias("first_doc"), (~F.col("least.doc_id").eqNullSafe(F.col("most.doc_id"))).alias("linked")), "ends")
    each = F.struct("start", "end", "gone", "owners", "first_doc", "linked")
    by_row = own.join(ends, "component").groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.collect_list(each).alias("found"))  # bounded by the text
    return by_row.select("doc_id", "found").mapInArrow(K.lean(_merged), "doc_id long, n_passages long, repeated_words long, removed_words long, spans array<long>, removed array<long>, first_docs array<long>")
