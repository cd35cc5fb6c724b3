"""Dynamic programming over byte pieces, computed once for each shared prefix of a set of words.

The words, sorted, are the depth-first order of their trie; its nodes of depth t are the distinct
prefixes of t bytes. Going down depth by depth, every node looks up the pieces that end there and adds
to what its ancestors have, all nodes of a depth in one numpy pass. Only as many depths are kept as the
longest piece has bytes, so a word may be of any length.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np

from tessera.llm import kernels as K


Words = tuple[np.ndarray, np.ndarray, np.ndarray]


def read_vocabulary(path: str) -> list[bytes]:
    """Pieces in order of their ranks, from a file of base64 pieces and ranks."""
    rows = [line.split() for line in Path(path).read_bytes().splitlines() if line]
    return [base64.b64decode(p) for p, _ in sorted(rows, key=lambda r: int(r[1]))]


def flat(words: Sequence[bytes]) -> Words:
    """All bytes of the words, their starts and ends."""
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    return np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends


def flat_texts(words: Sequence[str]) -> Words:
    """Like `flat`, of texts: their bytes never are 255, which stands between them."""
    buf = np.frombuffer(b"\xff".join(map(str.encode, words)) + b"\xff", np.uint8) if words else np.zeros(0, np.uint8)
    ends = np.flatnonzero(buf == 255)
    return buf, np.append(0, ends[:-1] + 1)[: len(words)], ends


class Pieces:
    """A vocabulary's pieces by hash, and the lengths that occur."""

    def __init__(self, pieces: Sequence[bytes]) -> None:
        buf, s, e = flat(pieces)
        self.size = len(pieces)
        self.table = K.Lookup(K.word_hashes(buf, s, e), np.arange(len(pieces)))
        self.lengths = sorted({len(p) for p in pieces if p})
        self.longest = max(self.lengths, default=1)


def _shared_prefix(buf: np.ndarray, s: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bytes that each word shares with the one before it."""
    out = np.zeros(len(s), np.int64)
    both = np.minimum(size[1:], size[:-1])
    on, t = np.flatnonzero(both > 0) + 1, 0
    while len(on):
        on = on[buf[s[on] + t] == buf[s[on - 1] + t]]
        t += 1
        out[on] = t
        on = on[both[on - 1] > t]
    return out


class Depth:
    """The nodes of one depth: how many, and for each piece length that ends here its nodes, their ancestors and the pieces."""

    def __init__(self, t: int, n: int, parent: np.ndarray, ends: tuple[np.ndarray, np.ndarray]) -> None:
        self.t, self.n, self.parent = t, n, parent
        #: words that end here, and their nodes
        self.words, self.nodes = ends
        self.found: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []


def depths(words: Words, pieces: Pieces) -> Iterator[Depth]:
    """The depths of the trie of sorted, distinct words, from 1 on."""
    buf, s, e = words
    size = e - s
    lcp = _shared_prefix(buf, s, size)
    span = K.span_hasher(buf)
    keep = pieces.longest + 1
    node_at = np.zeros((keep, len(s)), np.int32)  # of each word at the latest depths; at depth 0 all share the root
    live = np.flatnonzero(size > 0)
    t = 0
    while len(live):
        t += 1
        new = lcp[live] < t
        new[0] = True
        node = np.cumsum(new) - 1
        rep = live[new]
        node_at[t % keep, live] = node
        done = size[live] == t
        out = Depth(t, len(rep), node_at[(t - 1) % keep, rep], (live[done], node[done]))
        end = s[rep] + t
        for k in pieces.lengths:
            if k > t:
                break
            i, at = pieces.table.find(span(end - k, end))
            if len(i):
                out.found.append((k, i, node_at[(t - k) % keep, rep[i]], pieces.table.values[at]))
        yield out
        live = live[~done]


def best_counts(words: Words, pieces: Pieces, score: np.ndarray, unknown: float) -> np.ndarray:
    """Pieces in each word's best segmentation: the largest sum of scores, of equal ones the fewest pieces.

    A byte that no piece covers counts as one piece of score `unknown`.
    """
    out = np.zeros(len(words[1]), np.int64)
    keep = pieces.longest + 1
    best: list[np.ndarray] = [np.zeros(1)] + [np.zeros(0)] * (keep - 1)
    count: list[np.ndarray] = [np.zeros(1, np.int64)] + [np.zeros(0, np.int64)] * (keep - 1)
    for d in depths(words, pieces):
        top, n = best[(d.t - 1) % keep][d.parent] + unknown, count[(d.t - 1) % keep][d.parent] + 1
        for k, i, up, piece in d.found:
            s, c = best[(d.t - k) % keep][up] + score[piece], count[(d.t - k) % keep][up] + 1
            better = (s > top[i]) | ((s == top[i]) & (c < n[i]))
            top[i[better]], n[i[better]] = s[better], c[better]
        best[d.t % keep], count[d.t % keep] = top, n
        out[d.words] = n[d.nodes]
    return out


def log_sums(words: Words, pieces: Pieces, log_p: np.ndarray) -> np.ndarray:
    """(word, column) log of the sum over all segmentations of the products of the pieces' probabilities.

    log_p: (piece, column). A word that no pieces make up has -inf.
    """
    out = np.full((len(words[1]), log_p.shape[1]), -np.inf)
    keep = pieces.longest + 1
    total: list[np.ndarray] = [np.zeros((1, log_p.shape[1]))] + [np.zeros((0, log_p.shape[1]))] * (keep - 1)
    out[words[1] == words[2]] = 0
    for d in depths(words, pieces):
        own = np.full((d.n, log_p.shape[1]), -np.inf)
        for k, i, up, piece in d.found:
            own[i] = np.logaddexp(own[i], total[(d.t - k) % keep][up] + log_p[piece])
        total[d.t % keep] = own
        out[d.words] = own[d.nodes]
    return out
