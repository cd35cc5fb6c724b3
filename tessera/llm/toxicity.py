"""Toxicity by maximum-scoring segments.

Fit, on a bounded labelled sample: the log-odds of a token between toxic and other texts, smoothed by a
Dirichlet prior in proportion to the token's share of the sample, and kept where it is positive and
significant. A token is a word or the first few letters of one, so inflected forms count together.

Score, in one scan without a shuffle: known tokens add their log-odds, every other word subtracts
`gap`; a linear scan finds all maximal-scoring segments. Their scores are calibrated by the extreme
value law for random sequences: a segment of score S is expected K n exp(-lambda S) times by chance in
a text of n words. lambda follows from the tokens' shares in other texts, K from the segments that such
texts have, in a part of the sample that the tokens weren't taken from. The minus log of that number is
a segment's surprise; segments expected less than once are significant. A text's evidence is the sum of
the surprise of its significant segments, and its logarithm goes through a logistic curve fitted on the
same part of the sample.

Defined results: null, empty and word-free texts have no segment and get the lowest score; rows that
repeat an identifier are scored one by one; equal labelled texts count once, as toxic if half of their
labels or more say so; without labelled rows every score is 0; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm import shared
from tessera.llm.labelled import sample

#: Letters of a word's beginning that make a token; 0 is the whole word.
VIEWS = (4, 5, 7, 0)
#: Segments of other texts that tell how far chance reaches; a single one may be a wrong label.
_FEW = 5


def _views(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> list[np.ndarray]:
    hasher = K.span_hasher(buf)
    starts = (buf & 0xC0) != 0x80  # of characters
    before = np.append(0, np.cumsum(starts))[s]
    at = np.append(np.flatnonzero(starts), np.full(max(VIEWS), len(buf)))
    return [hasher(s, np.minimum(e, at[before + v]) if v else e) + K.U64(v) for v in VIEWS]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, texts with it, and of those toxic ones), summed within the chunk."""
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False)
        for lo, hi, buf, offsets in K.chunks(batch.column(0)):
            buf = K.LOWER[buf]
            s, e, first = K.words(buf, offsets, K.ALNUM)
            if not len(s):
                continue
            h = np.concatenate(_views(buf, s, e))
            row = np.tile(np.repeat(np.arange(hi - lo), np.diff(first)), len(VIEWS))
            order = np.lexsort((row, h))
            h, row = h[order], row[order]
            new = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))
            h, row = h[new], row[new]
            at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            bad = np.add.reduceat(toxic[lo:hi][row].astype(np.int64), at)
            yield pa.RecordBatch.from_pydict({"token": pa.array(h[at].view(np.int64)), "texts": pa.array(np.diff(np.append(at, len(h)))), "toxic": pa.array(bad)})


@dataclass
class Model:
    """Token log-odds, the extreme value law's lambda and K, and the logistic curve."""

    tokens: K.Lookup
    gap: float
    decay: float
    k: float
    slope: float = 0.0
    offset: float = -math.inf

    def score(self, evidence: np.ndarray) -> np.ndarray:
        if math.isinf(self.offset):
            return np.zeros(len(evidence))
        return 1 / (1 + np.exp(-np.clip(self.offset + self.slope * np.log1p(evidence), -50, 50)))


def segments(at: list[int], value: list[float], gap: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), in order, of a sequence that is -gap except value[i] > 0 at at[i].

    Linear time: each candidate keeps the running sums before and after it, and is merged or left once.
    """
    found: list[list] = []  # start, end, sum before, sum after
    total, last = 0.0, -1
    for p, v in zip(at, value, strict=True):
        total -= gap * (p - last - 1)
        cur = [p, p + 1, total, total + v]
        total, last = total + v, p
        stack = len(found) - 1
        while True:
            while stack >= 0 and found[stack][2] >= cur[2]:
                stack -= 1
            if stack < 0 or found[stack][3] >= cur[3]:
                found.append(cur)
                break
            cur = [found[stack][0], cur[1], found[stack][2], cur[3]]
            del found[stack:]
            stack = len(found) - 1
    return [(a, b, after - before) for a, b, before, after in found]


def fit_tokens(rows: DataFrame, prior: float, significance: float, gap: float) -> Model:
    """Log-odds of the tokens of (body, label) rows."""
    size = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_t, n = size.get(1, 0), sum(size.values())
    empty = Model(K.Lookup(np.zeros(0, np.uint64), np.zeros(0)), gap, 1.0, 1.0)
    if not n_t or n_t == n:
        return empty
    counts = rows.select("body", "label").mapInArrow(K.lean(_counts), "token long, texts long, toxic long").groupBy("token").agg(F.sum("texts").alias("texts"), F.sum("toxic").alias("toxic")).where("toxic >= 3")
    counts = shared.table(counts, "tokens")
    # a text has a token or not: shares of texts, with a prior worth `prior` texts split as the sample is
    share = F.col("texts") / n
    # half a text on each side keeps tokens of every text, or of none, finite
    a, b = F.col("toxic") + prior * share + 0.5, F.col("texts") - F.col("toxic") + prior * share + 0.5
    odds = F.log(a / (n_t + prior + 1 - a)) - F.log(b / (n - n_t + prior + 1 - b))
    # likelihood ratio of the token's split between the labels against the sample's
    x, y = F.col("toxic"), F.col("texts") - F.col("toxic")
    ratio = 2 * (x * F.log(x / (F.col("texts") * (n_t / n))) + F.when(y > 0, y * F.log(y / (F.col("texts") * (1 - n_t / n)))).otherwise(0.0))
    # so many tokens are tried that some reach a ratio of 2 log(tokens) by chance
    least = significance * 2 * math.log(max(counts.count(), 2))
    kept = counts.select("token", odds.alias("odds"), ratio.alias("ratio"), (b / (n - n_t + prior + 1)).alias("chance")).where((F.col("odds") > 0) & (F.col("ratio") > least))
    got = kept.collect()  # bounded by the sample: each token is in 3 toxic texts or more
    if not got:
        return empty
    # share of places with a token, from the share of texts with it
    places = rows.agg(F.sum(F.size(F.split(F.trim("body"), r"\s+")))).first()[0] / n
    odds_, chance = np.array([r["odds"] for r in got]), np.array([r["chance"] for r in got]) / max(places, 1.0)
    model = Model(K.Lookup(np.array([r["token"] for r in got], np.int64).view(np.uint64), odds_), gap, 1.0, 1.0)
    rest = max(1 - chance.sum(), 0.5)
    lo, hi = 1e-3, 5.0  # lambda: where the expected exp(lambda score) is 1
    for _ in range(60):
        mid = (lo + hi) / 2
        if (chance * np.exp(mid * odds_)).sum() + rest * math.exp(-mid * gap) < 1:
            lo = mid
        else:
            hi = mid
    model.decay = lo
    return model


def _segments(model: Model, column: pa.Array) -> tuple[np.ndarray, list[list]]:
    """For each text: its words, and its segments [(start, end, score)]."""
    n_words = np.zeros(len(column), np.int64)
    found: list[list] = [[] for _ in range(len(column))]
    for lo, hi, buf, offsets in K.chunks(column):
        buf = K.LOWER[buf]
        s, e, first = K.words(buf, offsets, K.ALNUM)
        n_words[lo:hi] = np.diff(first)
        if not len(s):
            continue
        best = np.zeros(len(s))
        for h in _views(buf, s, e):
            at, what = model.tokens.find(h)
            best[at] = np.maximum(best[at], model.tokens.values[what])
        hot = np.flatnonzero(best > 0)
        row = np.searchsorted(first, hot, "right") - 1
        cut = np.flatnonzero(np.diff(row)) + 1
        for a, b in zip(np.append(0, cut).tolist(), np.append(cut, len(hot)).tolist(), strict=True):
            if a < b:
                found[lo + int(row[a])] = segments((hot[a:b] - first[row[a]]).tolist(), best[hot[a:b]].tolist(), model.gap)
    return n_words, found


def _evidence(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[list]]:
    """For each text: its words, the evidence, and its significant segments [(start, end, surprise)]."""
    n_words, found = _segments(model, column)
    # -log of the number of such segments expected by chance in a text of this length
    passages = [[(x, y, v) for x, y, score in f if (v := model.decay * score - math.log(model.k * n)) > 0] for n, f in zip(n_words.tolist(), found, strict=True)]
    return n_words, np.array([sum(v for *_, v in f) for f in passages], float), passages


def _fit_curve(evidence: np.ndarray, label: np.ndarray, ridge: float = 0.5) -> tuple[float, float]:
    """Slope and offset of the logistic curve, by Newton's method with a small ridge."""
    x = np.stack([np.log1p(evidence), np.ones(len(evidence))], axis=1)
    w = np.array([0.1, math.log((label.sum() + 1) / (len(label) - label.sum() + 1))])
    keep = np.diag([ridge, ridge / 100])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (label - p) - keep @ w)
        w = w + np.clip(step, -2, 2)
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, allowed: Column, fit_rows: int, prior: float, significance: float, gap: float) -> Model:
    rows = shared.table(sample(docs, labels, label_col, id_col, text_col, allowed, fit_rows), "fit")
    # K and the curve are fitted on texts that the tokens weren't taken from
    apart = F.pmod(F.xxhash64("body"), F.lit(3)) == 0
    model = fit_tokens(rows.where(~apart), prior, significance, gap)
    if not len(model.tokens.keys):
        return model
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, found = _segments(sent.value, batch.column(0))
            scores = [[v for *_, v in f] for f in found]
            yield pa.RecordBatch.from_pydict({"n_words": pa.array(n_words), "scores": pa.array(scores, pa.list_(pa.float64())), "label": batch.column(1)})

    seen = rows.where(apart).select("body", "label").mapInArrow(K.lean(measure), "n_words long, scores array<double>, label long").toPandas()  # about fit_rows rows
    other = seen[seen["label"] == 0]
    # K n exp(-lambda S) is the number of segments of a score of S or more that such texts have, for every S that
    # some of them reach; one more at the least score, so that K is never 0
    by_chance = np.append(np.sort([v for f in other["scores"] for v in f])[::-1], model.tokens.values.min())
    n = np.arange(1, len(by_chance) + 1)
    some = n >= min(_FEW, len(n))
    model.k = float((n * np.exp(model.decay * by_chance))[some].max()) / (int(other["n_words"].sum()) + 1)
    evidence = np.array([sum(max(model.decay * v - math.log(model.k * n), 0) for v in f) for n, f in zip(seen["n_words"], seen["scores"], strict=True)], float)
    if seen["label"].nunique() == 2:
        model.slope, model.offset = _fit_curve(evidence, seen["label"].to_numpy(float))
    return model


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, label_col: str = "toxic", allowed: Column | None = None, fit_rows: int = 4000, prior: float = 10.0, significance: float = 1.0, gap: float = 0.25, threshold: float = 0.3) -> DataFrame:
    """One row per row of docs: doc_id, n_words, score, predicted, passages.

    allowed: which label rows (column doc_id) the fit may use; fit_rows: about how many of each label it
    uses at most. prior: texts that the Dirichlet prior is worth; significance: least likelihood ratio
    statistic of a token, in multiples of what the best of as many tokens reaches by chance. passages: word ranges expected less than once by chance, with their surprise.
    """
    model = fit(docs, labels, label_col, id_col, text_col, F.lit(True) if allowed is None else allowed, fit_rows, prior, significance, gap)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("surprise", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, evidence, found = _evidence(sent.value, batch.column(1))
            rows = [[{"start": a, "end": b, "surprise": v} for a, b, v in f if v > 0] for f in found]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_words": pa.array(n_words), "score": pa.array(sent.value.score(evidence)), "passages": pa.array(rows, passage)})

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("body"))
    out = texts.mapInArrow(K.lean(run), "doc_id long, n_words long, score double, passages array<struct<start: long, end: long, surprise: double>>")
    return out.select("doc_id", "n_words", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages")
