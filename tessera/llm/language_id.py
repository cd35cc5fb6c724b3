"""Language identification by unigram pieces, summed over all segmentations.

A fixed public vocabulary of byte pieces gets a probability a language, from the pieces of a bounded
sample of labelled documents. A word's probability in a language is the sum over all ways to cut it
into pieces of the products of their probabilities, by the forward algorithm; a text's is the product
over its words. The forward pass runs over the trie of the distinct words a task meets, for all languages
and all new words together, depth by depth, in logarithms. Words of any length are summed whole, over
all pieces of the vocabulary; in scripts without spaces a word is what stands between marks.

One scan, no shuffle. The model is bounded by the vocabulary times the number of languages.

Defined results: `und` with score 0 for a null text or one without a letter, and wherever there is
nothing to learn from; languages that tie go to the first by name; rows that repeat an identifier are
judged one by one; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm import segment, shared
from tessera.llm.labelled import thinned

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Log-probability of a word that no pieces make up.
_NEVER = -1e4
_KNOWN = 300_000
_CHUNK = 4 << 20
_ASCII_LETTER = K.byte_class((0x41, 0x5A), (0x61, 0x7A))


def _spaced(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words, each after a space, one after the other; and their starts, one more at the end."""
    size = e - s + 1
    at = np.zeros(len(s) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    source = np.arange(int(at[-1])) - np.repeat(at[:-1], size) + np.repeat(s - 1, size)
    out = buf[np.maximum(source, 0)]
    out[at[:-1]] = 32
    return out, at


class Model:
    """Piece log-probabilities by language."""

    def __init__(self, pieces: list[bytes], languages: list[str], counts: np.ndarray, smooth: float) -> None:
        self.languages = languages
        self.pieces = segment.Pieces(pieces)
        p = counts + smooth
        with np.errstate(divide="ignore"):
            self.log_p = np.log(p / p.sum(axis=0))

    def forward(self, buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """(word, language) log-probabilities of distinct words, each taken after a space."""
        data = buf.tobytes()
        words = [b" " + data[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)]
        order = sorted(range(len(words)), key=words.__getitem__)
        out = np.empty((len(words), len(self.languages)))
        out[order] = segment.log_sums(segment.flat([words[i] for i in order]), self.pieces, self.log_p)
        return np.where(np.isinf(out), _NEVER, out)


class Scorer:
    """Text log-probabilities; keeps the words it has met, up to a bound."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.known, self.rows = np.zeros(0, np.uint64), np.zeros((0, len(self.model.languages)))

    def texts(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        buf = K.LOWER[buf]
        s, e, first = K.words(buf, offsets, K.ALNUM)
        if not len(s):
            return np.zeros((len(offsets) - 1, len(self.model.languages)))
        h, where, back = np.unique(K.word_hashes(buf, s, e), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, h), max(len(self.known) - 1, 0))
        old = self.known[at] == h if len(self.known) else np.zeros(len(h), bool)
        values = np.empty((len(h), self.rows.shape[1]))
        values[old] = self.rows[at[old]]
        new = ~old
        if new.any():
            values[new] = self.model.forward(buf, s[where[new]], e[where[new]])
            if len(self.known) + int(new.sum()) > _KNOWN:
                self.clear()
            known = np.concatenate([self.known, h[new]])
            order = np.argsort(known)
            self.known, self.rows = known[order], np.concatenate([self.rows, values[new]])[order]
        return K.sum_by_row(values[back], first)


def _lettered(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter."""
    import regex

    out = K.sum_by_row(_ASCII_LETTER[buf].astype(np.int64), offsets) > 0
    letter = regex.compile(r"\p{L}")
    for i in np.flatnonzero(~out):
        out[i] = letter.search(buf[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "ignore")) is not None
    return out


def fit(rows: DataFrame, vocabulary: list[bytes], smooth: float) -> Model | None:
    """Piece probabilities from (body, lang) rows, cut by the vocabulary's own merge order."""
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())  # one row a language
    if not languages:
        return None
    sent = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        cut = tiktoken.Encoding("pieces", pat_str=r" ?[^ ]+", mergeable_ranks={p: i for i, p in enumerate(sent.value)}, special_tokens={})
        for batch in batches:
            total: dict[str, np.ndarray] = {}
            for body, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                buf = K.LOWER[np.frombuffer(body.encode(), np.uint8)]
                s, e, _ = K.words(buf, np.array([0, len(buf)]), K.ALNUM)
                if len(s):
                    ids = cut.encode_ordinary(_spaced(buf, s, e)[0].tobytes().decode("utf-8", "replace"))
                    total.setdefault(lang, np.zeros(len(sent.value), np.int64))[:] += np.bincount(ids, minlength=len(sent.value))
            for lang, n in total.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "piece": pa.array(at), "n": pa.array(n[at])})

    counts = rows.select("body", "lang").mapInArrow(K.lean(count), "lang string, piece long, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()  # vocabulary times languages
    table = np.zeros((len(vocabulary), len(languages)))
    table[counts["piece"], counts["lang"].map({x: i for i, x in enumerate(languages)})] = counts["n"]
    return Model(vocabulary, languages, table, smooth)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, lang_col: str = "lang", allowed: Column | None = None, vocabulary: str = VOCABULARY, fit_rows: int = 1500, smooth: float = 0.1) -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score (the language's share of the probability).

    allowed: which rows (columns doc_id, lang) the fit may use; fit_rows: about how many of each
    language it uses at most; vocabulary: file of the pieces, read on the driver.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"), F.col(lang_col).alias("lang"))
    rows = own.where(F.col("lang").isNotNull() & (F.lit(True) if allowed is None else allowed))
    model = fit(shared.table(thinned(rows, "lang", F.col("doc_id"), fit_rows), "fit"), segment.read_vocabulary(vocabulary), smooth)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value) if sent.value else None
        for batch in batches:
            names, scores = [], []
            for _, _, buf, offsets in K.chunks(batch.column(1), _CHUNK):
                n = len(offsets) - 1
                if scorer is None:
                    names += ["und"] * n
                    scores += [0.0] * n
                    continue
                p = scorer.texts(buf, offsets)
                best = p.argmax(axis=1)
                score = 1 / np.exp(np.maximum(p - p[np.arange(n), best][:, None], -700)).sum(axis=1)
                some = _lettered(buf, offsets)
                names += [scorer.model.languages[b] if x else "und" for b, x in zip(best.tolist(), some.tolist(), strict=True)]
                scores += np.where(some, score, 0.0).tolist()
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())})

    return own.select("doc_id", "body").mapInArrow(K.lean(run), "doc_id long, lang_pred string, score double")
