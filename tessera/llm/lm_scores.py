"""Stupid-backoff scores against the corpus's own n-gram counts.

score(w | context) is count(context w) / count(context) where the n-gram is in the table, else `alpha`
times the score with a shorter context, down to count(w) / words. Tables hold all unigrams and the
longer n-grams that occur `min_count` times or more.

Relationally: documents are exploded to n-grams, these are grouped by hash into count tables, and the
tables are joined back to the n-grams, whose scores are summed by document. Rows hold blocks instead of
single n-grams (`blocks`): a chunk of documents asks once for each distinct n-gram, with its own count;
each partition of the count table sums the counts and answers the chunks. Everything is counted. Unigrams and bigrams are asked for together, then each longer length in a
round of its own: an n-gram can only reach `min_count` if both (n-1)-grams in it do, so the others, most
of a natural corpus, needn't be asked for. What a chunk knows is written to the shared folder between the
rounds, so no round depends on an earlier one being repeated alike.

Defined results: a null or empty text, or one without words, has 0 words and score 0; a text's first
word is scored as a unigram; rows that repeat are scored one by one (and counted as often); an empty
table gives no rows; other columns are ignored, whatever their names.
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


def _grams(own: B.Chunk, lengths: tuple[int, ...], at: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams that end at the given positions, sorted; each occurrence's place among them; their counts here."""
    out = []
    for n, where in zip(lengths, at, strict=True):
        h = own.words[where - n + 1] * K._SHIFTS[20]
        for k in range(1, n):
            h += own.words[where - n + 1 + k] * K._SHIFTS[20 + k]
        out.append(K.mix(h + K.U64(n)))
    return np.unique(np.concatenate(out), return_inverse=True, return_counts=True)


class _Rounds:
    """Which n-grams a chunk asks for in each round, and how its answers are read. counts: of the n-gram that ends at each word, by n."""

    def __init__(self, order: int, min_count: int) -> None:
        self.order, self.min_count = order, min_count
        self.lengths = [tuple(range(1, min(order, 2) + 1)), *[(n,) for n in range(3, order + 1)]]

    def positions(self, own: B.Chunk, nth: int, counts: dict[int, np.ndarray]) -> list[np.ndarray]:
        out = []
        for n in self.lengths[nth]:
            at = np.flatnonzero(own.depth >= n - 1)
            if n > 2:  # both parts must be in the table
                at = at[(counts[n - 1][at] >= self.min_count) & (counts[n - 1][at - 1] >= self.min_count)]
            out.append(at)
        return out

    def learned(self, own: B.Chunk, known: bytes, answers: list[bytes]) -> tuple[dict[int, np.ndarray], bytes]:
        """Counts after the rounds so far, and what to keep of them. known: totals of the earlier rounds' distinct n-grams; answers: this round's."""
        totals = [B.unpacked(t, np.int64) for t in B.parts_of(known)]
        totals.append(np.concatenate([np.zeros(0, np.int64), *(B.unpacked(t, np.int64) for t in answers)]))
        counts: dict[int, np.ndarray] = {}
        for nth, total in enumerate(totals):
            at = self.positions(own, nth, counts)
            back = _grams(own, self.lengths[nth], at)[1]
            lo = 0
            for n, where in zip(self.lengths[nth], at, strict=True):
                counts[n] = np.zeros(len(own.words), np.int64)
                counts[n][where] = total[back[lo : lo + len(where)]]
                lo += len(where)
        return counts, B.joined([B.packed(t) for t in totals])

    def requests(self, chunk: str, own: B.Chunk, nth: int, counts: dict[int, np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
        keys, _, here = _grams(own, self.lengths[nth], self.positions(own, nth, counts))
        yield from B.questions(chunk, keys, [here.astype(np.int32)], buckets)

    def scores(self, own: B.Chunk, counts: dict[int, np.ndarray], words: int, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, words whose longest n-gram was not in the table, and summed log-score of each document."""
        score = np.log(counts[1] / words)
        missed = np.zeros(len(score), bool)
        for n in range(2, self.order + 1):
            at = np.flatnonzero(own.depth >= n - 1)
            count, context = counts[n][at], counts[n - 1][at - 1]
            known = count >= self.min_count
            score[at] = np.where(known, np.log(np.maximum(count, 1) / np.maximum(context, 1)), np.log(alpha) + score[at])
            missed[at] = ~known
        return np.diff(own.first), K.sum_by_row(missed.astype(np.int64), own.first), K.sum_by_row(score, own.first)


def _ask(rounds: _Rounds, buckets: int):
    """The first round's requests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, a, b, c in zip(*[batch.column(i).to_pylist() for i in (0, 2, 3, 4)], strict=True):
                yield from rounds.requests(chunk, B.Chunk(a, b, c), 0, {}, buckets)

    return run


def _totals(rows: list[tuple]) -> Iterator[bytes]:
    """Sums the counts of a bucket's n-grams and answers every request in its own order."""
    keys = [B.unpacked_sorted(r[2]) for r in rows]
    counts = np.concatenate([B.unpacked(r[3], np.int32) for r in rows])
    table, back = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(back, weights=counts, minlength=len(table)).astype(np.int64)
    lo = 0
    for k in keys:
        yield B.packed(total[back[lo : lo + len(k)]])
        lo += len(k)


def _opened(rows: list[tuple]) -> tuple[B.Chunk, bytes, list[bytes]]:
    """A chunk, what it knows, and its answers."""
    known = [r[5] for r in rows[1:2] if r[1] == B.KNOWN]
    return B.Chunk(*rows[0][2:5]), known[0] if known else b"", [r[2] for r in rows[1 + len(known) :]]


def _more(rounds: _Rounds, nth: int, buckets: int):
    """What each chunk knows after the round before, and its requests of round nth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in B.runs(batches, 0):
            own, known, answers = _opened(rows)
            counts, known = rounds.learned(own, known, answers)
            yield B.batch_of([(rows[0][0], B.KNOWN, b"", b"", b"", known)])
            yield from rounds.requests(rows[0][0], own, nth, counts, buckets)

    return run


def _score(rounds: _Rounds, words: int, alpha: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in B.runs(batches, 0):
            own, known, answers = _opened(rows)
            counts, _ = rounds.learned(own, known, answers)
            size, gone, total = rounds.scores(own, counts, words, alpha)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(own.ids, pa.int64(), mask=own.none), "n_words": pa.array(size), "n_backoff": pa.array(gone), "log_score": pa.array(total)})

    return run


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, order: int = 3, alpha: float = 0.4, min_count: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_backoff, log_score (natural log, summed).

    n_backoff: words whose longest n-gram is in no table, so that a shorter one gave the score.
    """
    spark = docs.sparkSession
    layout = B.Layout(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("body")), K.ALNUM, 2)
    rounds, buckets = _Rounds(order, min_count), layout.buckets
    asked, known = layout.chunks.mapInArrow(K.lean(_ask(rounds, buckets)), B.ROW), []
    for nth in range(len(rounds.lengths)):
        answered = layout.answered(asked, _totals)
        del asked  # its shuffle goes with it
        shared.rest(spark)
        together = layout.together(layout.chunks, *known, answered)
        if nth + 1 < len(rounds.lengths):
            state = shared.table(together.mapInArrow(K.lean(_more(rounds, nth + 1, buckets)), B.ROW).withColumn("asks", F.col("bucket") >= 0), "state", "asks")
            asked, known = state.where("asks").drop("asks"), [state.where("not asks").drop("asks")]
            del together, answered
            shared.release(spark, shared.opened()[-2 - (nth > 0) : -1])  # the answers, and the state before them
            shared.rest(spark)
    return together.mapInArrow(K.lean(_score(rounds, layout.words, alpha)), "doc_id long, n_words long, n_backoff long, log_score double")
