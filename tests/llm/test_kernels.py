import re

import numpy as np
import pyarrow as pa

from tessera.llm import kernels as K
from tessera.llm import segment
from tessera.llm.blocks import joined, packed, parts_of, unpacked
from tessera.llm.toxicity import segments

TEXTS = ["", "a b  c", None, "Été\tÀ\x0b\n x", " lead", "trail ", "one", "a b c a b c", "x" * 3000 + " y"]


def test_words_match_a_regex():
    for lo, hi, buf, offsets in K.chunks(pa.array(TEXTS), 40):
        s, e, first = K.words(buf, offsets, K.SPACED)
        for r in range(hi - lo):
            got = [buf[a:b].tobytes().decode() for a, b in zip(s[first[r] : first[r + 1]], e[first[r] : first[r + 1]], strict=True)]
            assert got == re.findall("[^\x20\x09-\x0d]+", TEXTS[lo + r] or "")


def test_equal_words_have_equal_hashes_wherever_they_stand():
    (_, _, buf, offsets), = K.chunks(pa.array(TEXTS), 1 << 20)
    s, e, _ = K.words(buf, offsets, K.SPACED)
    seen = {}
    for h, a, b in zip(K.word_hashes(buf, s, e).tolist(), s, e, strict=True):
        assert seen.setdefault(buf[a:b].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen)


def test_shingle_sets():
    (_, _, buf, offsets), = K.chunks(pa.array(TEXTS), 1 << 20)
    s, e, first = K.words(buf, offsets, K.SPACED)
    values, start = K.distinct_by_row(*K.shingles(K.word_hashes(buf, s, e), first, 3))
    for r, t in enumerate(TEXTS):
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        assert start[r + 1] - start[r] == (len({tuple(w[i : i + 3]) for i in range(len(w) - 2)}) if len(w) >= 3 else bool(w))


def test_trie_finds_the_best_segmentation():
    pieces = [bytes([b]) for b in range(97, 105)] + [b"ab", b"abc", b"cde", b"bcd", b"gh", b"fgh"]
    score = np.log(np.random.default_rng(3).integers(1, 50, len(pieces)) / 300)
    unknown = float(score.min()) - 1
    value = dict(zip(pieces, score.tolist(), strict=True))

    def brute(word):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            options = [(best[end - 1][0] + unknown, best[end - 1][1] - 1)]
            options += [(best[a][0] + value[word[a:end]], best[a][1] - 1) for a in range(end) if word[a:end] in value]
            best.append(max(options))
        return -best[-1][1]

    rng = np.random.default_rng(1)
    words = sorted({"".join(rng.choice(list("abcdefghz"), rng.integers(0, 9))).encode() for _ in range(400)} | {b"abcdefgh" * 40})
    assert segment.best_counts(segment.flat(words), segment.Pieces(pieces), score, unknown).tolist() == [brute(w) for w in words]
    assert segment.best_counts(segment.flat([]), segment.Pieces(pieces), score, unknown).tolist() == []


def test_depths_visit_each_prefix_once():
    words = sorted({b"", b"a", b"ab", b"abc", b"abd", b"b", b"bcd"})
    assert [d.n for d in segment.depths(segment.flat(words), segment.Pieces([b"a"]))] == [2, 2, 3]


def test_segments_are_all_maximal():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(1, 12))
        x = np.where(rng.random(n) < 0.5, rng.integers(1, 6, n).astype(float), -1.0)
        at = np.flatnonzero(x > 0).tolist()
        got = segments(at, x[at].tolist(), 1.0)
        # the best segment comes first; what lies left and right of it is searched the same way

        def expect(lo, hi):
            best = max(((x[a:b].sum(), a - b, -a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0,))
            if best[0] <= 0:
                return []
            a, b = -best[2], best[3]
            return [*expect(lo, a), (a, b, best[0]), *expect(b, hi)]

        assert sum(s for *_, s in got) == sum(s for *_, s in expect(0, n))
        assert max((s for *_, s in got), default=0) == max((s for *_, s in expect(0, n)), default=0)


def test_packed_arrays_come_back():
    assert parts_of(joined([b"", b"ab", b"c"])) == [b"", b"ab", b"c"] and parts_of(b"") == []
    for x in (np.arange(1000, dtype=np.uint64) ** 3, np.zeros(0, np.int32), np.array([7, -1], np.int64)):
        assert np.array_equal(unpacked(packed(x), x.dtype), x)


def test_flat_texts():
    words = ["", "a", "né", "zz"]
    for got in (segment.flat_texts(words), segment.flat([w.encode() for w in words])):
        buf, s, e = got
        assert [buf[a:b].tobytes().decode() for a, b in zip(s, e, strict=True)] == words
    assert [len(x) for x in segment.flat_texts([])] == [0, 0, 0]


def test_lookup_finds_what_is_there():
    rng = np.random.default_rng(5)
    keys = np.unique(np.concatenate([rng.integers(0, 2**63, 3000, dtype=np.uint64), np.arange(40, dtype=np.uint64) + K.U64(7 << 60)]))  # many in one slot
    table = K.Lookup(keys, np.arange(len(keys)))
    asked = np.concatenate([keys[::3], rng.integers(0, 2**63, 5000, dtype=np.uint64), keys[-5:]])
    i, at = table.find(asked)
    assert np.array_equal(table.keys[at], asked[i]) and set(i.tolist()) == set(np.flatnonzero(np.isin(asked, keys)).tolist())
    assert len(K.Lookup(keys[:0], keys[:0]).find(asked)[0]) == 0


def test_links_are_decided_by_shingles():
    from tessera.llm.minhash import linked, shingle_set

    rng = np.random.default_rng(6)
    pairs = []
    for _ in range(300):
        a = [f"w{k}" for k in rng.integers(0, 30, rng.integers(0, 60))]
        b = [w if rng.random() < 0.97 else "other" for w in a]
        pairs.append((" ".join(a).encode(), " ".join(b).encode()))
    got = linked(pa.array([a for a, _ in pairs], pa.binary()), pa.array([b for _, b in pairs], pa.binary()), 3, 85)
    sets = [(shingle_set(a, 3), shingle_set(b, 3)) for a, b in pairs]
    assert got.tolist() == [100 * len(a & b) >= 85 * len(a | b) for a, b in sets]
    assert shingle_set(b"A b", 3) == {(b"a", b"b")} and shingle_set(b"", 3) == set()
