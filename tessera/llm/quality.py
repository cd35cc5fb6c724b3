"""Quality selection by importance resampling.

Two generative models over hashed n-grams, one of target text (labelled good, a bounded sample) and one
of all raw text (every document counted), give each document an importance weight: the sum over its
n-grams of log p(target) - log p(raw). Documents are drawn without replacement in proportion to their
weights by the Gumbel top-k rule: add seeded standard Gumbel noise to the log-weights and keep the k
largest. A log-weight sums over all n-grams of a text, so for texts of more than a few words it is far
larger than the noise, and the draw is close to keeping the k best.

n-grams are words and word pairs, and pairs of shapes (case of words, the very punctuation); a word
that repeats the one before is one n-gram of its own kind. `cut`, a log-ratio an n-gram, is set where
it parts the labelled sample best, weights are taken relative to it, and k is the number of documents
at or above it in the whole table.

The k-th largest key is found from counts in ever narrower ranges: no sort, nothing unbounded in one
task. A document's key depends on its text and identifier only, so a filter can score again instead of
joining.

Defined results: null, empty and word-free texts have no n-grams and are rejected; documents whose keys
tie at the k-th stay, so repeated rows are judged alike; without both labels every weight is 0 and
everything that has words is kept (or, with `draw`, a plain sample of it); an empty table gives no rows; carried columns keep their names inside a struct.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm import shared
from tessera.llm.labelled import sample

_WORD = K.byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_MARK = K.SPACED & ~_WORD
_UPPER = K.byte_class((0x41, 0x5A))
_DIGIT = K.byte_class((0x30, 0x39))


def ngrams(buf: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams in row order, row starts, and the number of words of each row."""
    low = K.LOWER[buf]
    ws, we, first_word = K.words(low, offsets, _WORD)
    ms, me, _ = K.words(low, offsets, _MARK)
    s, e = np.concatenate([ws, ms]), np.concatenate([we, me])
    order = np.argsort(s, kind="stable")
    s, e, is_word = s[order], e[order], order < len(ws)
    first = np.searchsorted(s, offsets)
    n = len(s)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64), np.zeros(len(offsets) - 1, np.int64)
    h = K.word_hashes(low, s, e)
    upper = np.concatenate([[0], np.cumsum(_UPPER[buf])])
    digit = np.concatenate([[0], np.cumsum(_DIGIT[buf])])
    size, ups, digits = e - s, upper[e] - upper[s], digit[e] - digit[s]
    shape = np.where(digits > 0, 4, np.where((ups >= 2) & (2 * ups > size), 3, np.where(ups > 0, 2, 1))).astype(np.uint64) * K._SHIFTS[50]
    shape = np.where(is_word, shape, h)
    fresh = np.zeros(n, bool)  # first token of its row
    fresh[first[:-1][first[:-1] < first[1:]]] = True
    before = np.append(K.U64(0), h[:-1])
    before[fresh] = 0
    shape_before = np.append(K.U64(0), shape[:-1])
    shape_before[fresh] = 0
    # the word before, marks aside
    word_at = np.flatnonzero(is_word)
    same = np.zeros(n, bool)
    same[word_at[1:]] = (h[word_at][1:] == h[word_at][:-1]) & (np.searchsorted(first, word_at[1:], "right") == np.searchsorted(first, word_at[:-1], "right"))
    one = np.where(same, K._SHIFTS[51], h)
    two = np.where(same, K._SHIFTS[52], before * K._SHIFTS[53] + h)
    three = shape_before * K._SHIFTS[54] + shape + K.U64(3)
    grams = np.stack([K.mix(one + K.U64(1)), K.mix(two), K.mix(three)], axis=1) >> K.U64(64 - (buckets.bit_length() - 1))
    return grams.reshape(-1).astype(np.int64), first * 3, np.diff(first_word)


def _bucket_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """Occurrences of each bucket over all of one text column; summed by task, then by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, buf, offsets in K.chunks(batch.column(0)):
                total += np.bincount(ngrams(buf, offsets, buckets)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at), "n": pa.array(total[at])})

    out = np.zeros(buckets, np.int64)
    got = rows.mapInArrow(K.lean(count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # at most `buckets` rows
    out[got["bucket"]] = got["n"]
    return out


def gumbel(ids: np.ndarray, seed: int) -> np.ndarray:
    """Standard Gumbel noise of each 64-bit identifier, the same in every run."""
    u = (K.mix(ids * K._SHIFTS[10] + K.U64(seed)) >> K.U64(11)).astype(float) / 2.0**53
    return -np.log(-np.log(np.clip(u, 1e-300, 1 - 1e-16)))


@dataclass
class Weights:
    """log p(target) - log p(raw) of each bucket, the cut, and the seed of the noise."""

    ratio: np.ndarray
    seed: int
    cut: float = 0.0

    def mean(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """n-grams and mean log-ratio of each text; none for texts without words."""
        n, mean = np.zeros(len(column), np.int64), np.zeros(len(column))
        for lo, hi, buf, offsets in K.chunks(column):
            grams, start, words = ngrams(buf, offsets, len(self.ratio))
            n[lo:hi] = np.where(words > 0, np.diff(start), 0)
            mean[lo:hi] = K.sum_by_row(self.ratio[grams], start) / np.maximum(n[lo:hi], 1)
        return n, mean

    def keys(self, ids: pa.Array, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """n-grams, log-weight relative to the cut, and the key with its noise."""
        n, mean = self.mean(column)
        weight = n * (mean - self.cut)
        who = np.asarray(ids.fill_null(-1).to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
        return n, weight, np.where(n > 0, weight + gumbel(who, self.seed), -np.inf)


def _best_cut(mean: np.ndarray, good: np.ndarray, care: float) -> float:
    """The cut that loses least: a rejected good text counts `care` times a kept bad one."""
    order = np.argsort(mean)
    m, g = mean[order], good[order]
    loss = np.append(0, np.cumsum(np.where(g, care / max(g.sum(), 1), 0))) + np.append(np.cumsum(np.where(g, 0, 1 / max((~g).sum(), 1))[::-1])[::-1], 0)
    best = np.flatnonzero(loss <= loss.min() + 1e-12)
    i = int(best[len(best) // 2])
    return float((m[max(i - 1, 0)] + m[min(i, len(m) - 1)]) / 2)


def kth_largest(keys: DataFrame, col: str, k: int, few: int = 10_000, bins: int = 2048) -> float:
    """The k-th largest of a double column, by counting in ever narrower ranges."""
    lo, hi = keys.where(F.col(col) > float("-inf")).agg(F.min(col), F.max(col)).first()
    if lo is None:
        return float("inf")
    while True:
        inside = keys.where((F.col(col) >= lo) & (F.col(col) <= hi))
        width = (hi - lo) / bins
        if width <= 0 or lo + width == lo:
            return lo
        nth = F.least(F.floor((F.col(col) - lo) / width), F.lit(bins - 1))
        counts = inside.groupBy(nth.alias("bin")).agg(F.count("*").alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).orderBy(F.desc("bin")).collect()  # at most `bins` rows
        for r in counts:
            if k <= r["n"]:
                break
            k -= r["n"]
        else:
            return counts[-1]["lo"]
        lo, hi = r["lo"], r["hi"]
        if lo == hi:
            return lo
        if r["n"] <= few:
            values = sorted((x[0] for x in keys.where((F.col(col) >= lo) & (F.col(col) <= hi)).select(col).collect()), reverse=True)
            return values[k - 1]


def fit(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, allowed: Column, *, buckets: int, fit_rows: int, care: float, seed: int) -> Weights:
    rows = shared.table(sample(docs, labels, label_col, id_col, text_col, allowed, fit_rows), "fit")
    kinds = {r["label"] for r in rows.select("label").distinct().collect()}
    if not {0, 1} <= kinds:
        return Weights(np.zeros(buckets), seed)
    # one half of the sample makes the target model, the other sets the cut, so no text meets its own counts
    half = F.pmod(F.xxhash64("body"), F.lit(2)) == 0
    target = _bucket_counts(rows.where(half & (F.col("label") == 1)).select("body"), buckets)
    raw = _bucket_counts(docs.select(F.col(text_col)), buckets)
    # the target model leans on the raw one where it has seen little
    p_raw = (raw + 0.5) / (raw + 0.5).sum()
    p_target = (target + 2 * buckets * p_raw) / (target.sum() + 2 * buckets)
    weights = Weights(np.log(p_target / p_raw), seed)
    sent = rows.sparkSession.sparkContext.broadcast(weights)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, mean = sent.value.mean(batch.column(0))
            some = pa.array(n > 0)
            yield pa.RecordBatch.from_pydict({"mean": pa.array(mean).filter(some), "label": batch.column(1).filter(some)})

    seen = rows.where(~half).select("body", "label").mapInArrow(K.lean(measure), "mean double, label long").toPandas()  # about fit_rows rows
    if seen["label"].nunique() == 2:
        weights.cut = _best_cut(seen["mean"].to_numpy(), seen["label"].to_numpy() == 1, care)
    return weights


def _keyed(docs: DataFrame, weights: Weights, id_col: str, text_col: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, weight, key = sent.value.keys(batch.column(0), batch.column(1))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_grams": pa.array(n), "log_weight": pa.array(weight), "key": pa.array(key)})

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("body"))
    return texts.mapInArrow(K.lean(run), "doc_id long, n_grams long, log_weight double, key double")


def _selected(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, allowed: Column | None, draw: int | None, options: dict) -> tuple[DataFrame, float, Weights]:
    """Documents with their keys, the k-th largest key, and the model."""
    weights = fit(docs, labels, label_col, id_col, text_col, F.lit(True) if allowed is None else allowed, **options)
    keyed = shared.table(_keyed(docs, weights, id_col, text_col), "keys")
    some = keyed.where("n_grams > 0")
    k = some.where("log_weight >= 0").count() if draw is None else min(draw, some.count())
    return keyed, kth_largest(keyed, "key", k) if k else float("inf"), weights


def _options(buckets: int = 1 << 14, fit_rows: int = 4000, care: float = 4.0, seed: int = 29) -> dict:
    return {"buckets": buckets, "fit_rows": fit_rows, "care": care, "seed": seed}


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, label_col: str = "quality", allowed: Column | None = None, draw: int | None = None, **options) -> DataFrame:
    """One row per row of docs: doc_id, n_grams, log_weight, kept.

    draw: how many documents to draw (k); unless given, as many as lie at or above the cut. options:
    buckets (a power of two), fit_rows (about how many labelled texts of each label the fit uses at
    most), care (see `_best_cut`), seed.
    """
    keyed, least, _ = _selected(docs, labels, id_col, text_col, label_col, allowed, draw, _options(**options))
    return keyed.select("doc_id", "n_grams", "log_weight", (F.col("key") >= least).alias("kept"))


def select_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, label_col: str = "quality", allowed: Column | None = None, draw: int | None = None, **options) -> DataFrame:
    """The rows of docs that `quality` keeps. They are scored again where they are, not joined; a text's score doesn't depend on its neighbours."""
    _, least, weights = _selected(docs, labels, id_col, text_col, label_col, allowed, draw, _options(**options))
    sent = docs.sparkSession.sparkContext.broadcast((weights, least))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, least = sent.value
        for batch in batches:
            yield batch.filter(pa.array(weights.keys(batch.column(1), batch.column(2))[2] >= least))

    return rows.mapInArrow(K.lean(run), rows.schema).select("row.*")
