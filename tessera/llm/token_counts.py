"""Token counts under a fixed public vocabulary by dynamic programming shared over a trie.

A text is cut into pre-tokens; a pre-token's tokens are its best segmentation into vocabulary pieces by
unigram scores. The scores are learned from all documents: every distinct pre-token a task meets is
cut by the vocabulary's own merge order and counts as often as it occurs, and a piece's score is the log
of its share. The vocabulary itself is never changed.

The distinct pre-tokens of a stretch of documents are inserted in a trie; forward scores are computed
once for each of its nodes, so a shared prefix is scored once, and the count at the end of each
pre-token, its terminal, is stored. Documents then add up the counts of their pre-tokens.

Two scans; what is shuffled are the piece counts, at most the vocabulary for each task. Counts that were
stored serve all later documents of the task, up to a bound.

Defined results: a null or empty text has no pre-tokens and no tokens; bytes that no piece covers
count as one token each; rows that repeat are counted one by one; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm import segment

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Contractions, letters, numbers and other marks each with one space before them, and white space.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_KNOWN = 300_000
_STRETCH = 2 << 20


class Counts:
    """The stored terminal counts of the pre-tokens met so far, up to a bound."""

    def __init__(self, pieces: segment.Pieces, score: np.ndarray) -> None:
        self.pieces, self.score = pieces, score
        self.unknown = float(score.min()) - 1 if len(score) else -1.0
        self.terminal: dict[str, int] = {}

    def insert(self, tokens: set[str]) -> None:
        """Makes sure that the counts of the pre-tokens are stored."""
        new = tokens - self.terminal.keys()
        if len(self.terminal) + len(new) > _KNOWN:
            self.terminal, new = {}, tokens
        words = sorted(new)  # texts and their bytes have one order
        counts = segment.best_counts(segment.flat_texts(words), self.pieces, self.score, self.unknown)
        self.terminal.update(zip(words, counts.tolist(), strict=True))


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of rows of a few MB."""
    texts, lo = batch.column(1).fill_null("").to_pylist(), 0
    while lo < len(texts):
        hi, held = lo, 0
        while hi < len(texts) and held < _STRETCH:
            held += len(texts[hi])
            hi += 1
        yield lo, texts[lo:hi]
        lo = hi


def learn_scores(texts: DataFrame, vocabulary: list[bytes], pattern: str) -> np.ndarray:
    """Log share of each piece among all pieces of all documents (doc_id, body), half a count added."""
    sent = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        import tiktoken

        cut = regex.compile(pattern).findall
        merged = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks={p: i for i, p in enumerate(sent.value)}, special_tokens={}).encode_ordinary
        total, seen = np.zeros(len(sent.value), np.int64), Counter()

        def settle() -> None:
            cuts = [merged(token) for token in seen]
            np.add.at(total, list(chain.from_iterable(cuts)), np.repeat(list(seen.values()), [len(c) for c in cuts]))
            seen.clear()

        for batch in batches:
            for _, stretch in _stretches(batch):
                for t in stretch:
                    seen.update(cut(t))
                if len(seen) > _KNOWN:
                    settle()
        if seen:
            settle()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"piece": pa.array(at), "n": pa.array(total[at])})

    counts = texts.mapInArrow(K.lean(count), "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()  # at most the vocabulary
    table = np.full(len(vocabulary), 0.5)
    table[counts["piece"]] += counts["n"]
    return np.log(table / table.sum())


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """One row per row of docs: doc_id, n_pretokens, n_tokens, n_bytes.

    vocabulary: file of base64 pieces and ranks that cover every byte, read on the driver; pattern: of
    the pre-tokens.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("body"))
    pieces = segment.read_vocabulary(vocabulary)
    sent = docs.sparkSession.sparkContext.broadcast((pieces, learn_scores(texts, pieces, pattern)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        cut, counts = regex.compile(pattern).findall, Counts(segment.Pieces(sent.value[0]), sent.value[1])
        for batch in batches:
            n_pre: list[int] = []
            n_tok: list[int] = []
            n_bytes: list[int] = []
            for _, stretch in _stretches(batch):
                parts = [cut(t) for t in stretch]
                counts.insert(set(chain.from_iterable(parts)))
                n_pre += [len(p) for p in parts]
                n_tok += [sum(map(counts.terminal.__getitem__, p)) for p in parts]
                n_bytes += [len(t.encode()) for t in stretch]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_pretokens": pa.array(n_pre, pa.int64()), "n_tokens": pa.array(n_tok, pa.int64()), "n_bytes": pa.array(n_bytes, pa.int64())})

    return texts.mapInArrow(K.lean(run), "doc_id long, n_pretokens long, n_tokens long, n_bytes long")
