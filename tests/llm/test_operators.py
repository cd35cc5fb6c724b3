import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm.components import components
from tessera.llm.decontaminate import contamination
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.language_id import language_id
from tessera.llm.lm_scores import lm_scores
from tessera.llm.minhash import near_dedup
from tessera.llm.mixing import mix, mix_plan
from tessera.llm.passages import repeated_passages
from tessera.llm.quality import kth_largest, quality, select_quality
from tessera.llm.token_counts import token_counts
from tessera.llm.toxicity import toxicity

from .conftest import LINE, SCHEMA, awkward

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
N = len(awkward())


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))


def prose(n, seed=3, size=40):
    import random

    r = random.Random(seed)
    return [" ".join(r.choice(["stone", "river", "quiet", "amber", "fold", "seven", "lamp", "north", "glass", "tree"]) + str(r.randrange(30)) for _ in range(r.randrange(size // 2, size))) for _ in range(n)]


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact_dedup(docs, keep, digest_bytes):
    rows = exact_dedup(docs, keep=keep, digest_bytes=digest_bytes, memtable_bytes=2000, most_bits=1 << 12).collect()
    assert len(rows) == N
    groups = defaultdict(list)
    for i, t, *_ in awkward():
        groups[(t or "").translate(LOWER)].append(i)
    got = Counter((r.doc_id, r.keep_id, r.group_size, bytes(r.sha)) for r in rows)
    pick = max if keep == "max" else min
    expected = Counter()
    for t, ids in groups.items():
        best = pick((i for i in ids if i is not None), default=None)
        expected.update((i, best, len(ids), hashlib.sha256(t.encode()).digest()) for i in ids)
    assert got == expected
    assert sum(r.kept for r in rows) == len(groups)
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)


def test_exact_dedup_many_collisions(spark):
    texts = [f"text {i % 400}" for i in range(1000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = exact_dedup(df, digest_bytes=1, memtable_bytes=5000, most_bits=1 << 12).collect()
    assert {r.doc_id for r in rows if r.kept} == set(range(400))
    assert all(r.keep_id == r.doc_id % 400 for r in rows)


def brute_near(rows, shingle, percent):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} if len(w) >= shingle else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            a, b = sets[x], sets[y]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = find(x), find(y)
                up[max(p, q)] = min(p, q)
    out = []
    for x, (i, _) in enumerate(rows):
        ids = [rows[y][0] for y in range(len(rows)) if find(y) == find(x) and rows[y][0] is not None]
        out.append((i, len(sets[x]), min(ids, default=None) if sets[x] else i))
    return Counter(out)


def test_near_dedup_awkward(docs):
    got = near_dedup(docs, shingle=3, percent=85).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_near([(i, t) for i, t, *_ in awkward()], 3, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize(("shingle", "percent"), [(3, 85), (5, 80)])
def test_near_dedup_spread_out_copies(spark, shingle, percent):
    """Copies of one text with more and less edits: many pairs lie about the threshold."""
    import random

    r = random.Random(5)
    base = prose(1, size=140)[0].split()
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randrange(0, 5)):
            w[r.randrange(len(w))] = f"edit{r.randrange(50)}"
        rows.append((1000 - i, " ".join(w)))
    rows += list(enumerate(prose(60)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = near_dedup(df, shingle=shingle, percent=percent).collect()
    assert Counter((x.doc_id, x.n_shingles, x.component_id) for x in got) == brute_near(rows, shingle, percent)


def test_components(spark):
    import random

    r = random.Random(4)
    links = [(i, i + 1) for i in range(100, 160)] + [(1, x) for x in range(2, 40)] + [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(150)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        up[max(p, q)] = min(p, q)
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    assert got == {x: find(x) for x in up if find(x) != x}


def test_contamination_against_brute_force(spark, docs):
    items = [("b", LINE), ("a", LINE), ("short", "Hello, world!"), ("none", None), (None, "plage"), ("empty", "..."), ("c", "one two three " + LINE), ("one", "X")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    token = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    expected = Counter()
    for i, t, *_ in awkward():
        w, hit, found = token(t), set(), set()
        for item, text in items:
            p = token(text)
            m = min(13, len(p))
            windows = {tuple(p[k : k + m]) for k in range(len(p) - m + 1)} if m else set()
            for k in range(len(w) - m + 1) if m else ():
                if tuple(w[k : k + m]) in windows:
                    hit.update(range(k, k + m))
                    found |= {item} - {None}
        expected[(i, len(w), len(hit), tuple(sorted(found)))] += 1
    for block in (8 << 20, 30):  # one block, and one an item
        got = contamination(docs, bench, block_bytes=block).collect()
        assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == expected
    carried = contamination(docs, bench, carry=True).select("row.*")
    assert carried.columns == docs.columns and carried.count() == N
    assert contamination(docs, bench.limit(0)).where("n_hit > 0").isEmpty()


def test_mix_reaches_targets(spark):
    rows = [(i, t, "abcd"[i % 17 % 4]) for i, t in enumerate(prose(600, size=200))] + [(1000, "tiny source", "e"), (1001, None, None), (1002, "", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_plan(df).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    total = sum(r.size for r in got)
    by = defaultdict(lambda: [0, 0, 0.0, 0])
    source = {r[0]: r[2] for r in rows}
    for r in got:
        s = by[source[r.doc_id]]
        s[0] += r.size
        s[1] += r.taken
        s[2], s[3] = r.target, r.source_size
        assert r.taken <= 3 * r.size and r.taken in {0, r.size, 2 * r.size, 3 * r.size}
    assert abs(sum(s[2] for s in by.values()) - total) < 1e-6 * total
    for s in by.values():
        assert s[3] == s[0] and s[2] <= 3 * s[0] and abs(s[1] - s[2]) <= max(30, 0.01 * s[2])
    assert by["e"][2] == 6  # clamped
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in mix_plan(df.repartition(7)).collect()}
    taken = Counter(r.doc_id for r in mix(df).collect())
    assert taken == Counter({r.doc_id: r.copies for r in got if r.copies})


def test_language_id_learns(spark):
    en, fr = "the stone and the river of the north", "la pierre et le fleuve dans le nord été"
    rows = [(i, (en if i % 2 else fr) + f" {i}", "en" if i % 2 else "fr") for i in range(200)] + [(900, "the river", None), (901, "le fleuve", None), (902, "123 !!", None), (903, None, None), (904, "", None)]
    got = {r.doc_id: r for r in language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[900].lang_pred == "en" and got[901].lang_pred == "fr"
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (902, 903, 904))
    assert all(got[i].lang_pred == la for i, _, la in rows[:200])


def test_forward_sums_all_segmentations():
    import numpy as np

    from tessera.llm import kernels as K
    from tessera.llm.language_id import Model

    pieces = [b" ", b"a", b"b", b" a", b"ab", b"ba", b"bab"]
    counts = np.random.default_rng(0).integers(1, 9, (len(pieces), 2)).astype(float)
    p = counts / counts.sum(axis=0)

    def total(word, k):
        f = [1.0] + [0.0] * len(word)
        for e in range(1, len(word) + 1):
            f[e] = sum(f[e - len(x)] * p[i, k] for i, x in enumerate(pieces) if word[:e].endswith(x))
        return f[-1]

    text = np.frombuffer(b"abab b babba", np.uint8)
    s, e, _ = K.words(text, np.array([0, len(text)]), K.ALNUM)
    got = Model(pieces, ["x", "y"], counts, 0.0).forward(text, s, e)
    for row, word in zip(got, (b" abab", b" b", b" babba"), strict=True):
        assert np.allclose(row, [np.log(total(word, 0)), np.log(total(word, 1))])


def test_toxicity_learns(spark):
    clean = prose(300, seed=8)
    rows = [(i, t + (" vile scumbag liar" if i % 3 == 0 else "")) for i, t in enumerate(clean)] + [(900, "you scumbag"), (901, None), (902, ""), (903, "stone1 river2")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity(df, labels).collect()}
    assert all(got[i].predicted == int(i % 3 == 0) for i in range(300))
    assert got[900].predicted == 1 and all(got[i].predicted == 0 and 0 <= got[i].score <= 1 for i in (901, 902, 903))
    assert got[0].passages and got[0].passages[0].end == got[0].n_words


def test_quality_keeps_good_texts(spark):
    good = prose(300, seed=9)
    rows = [(i, t if i % 4 else " ".join([t.split()[0]] * 30)) for i, t in enumerate(good)] + [(900, None), (901, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(150)], "doc_id long, quality int")
    rows = {r.doc_id: r for r in quality(df, labels).collect()}
    got = {i: r.kept for i, r in rows.items()}
    # weights part the texts; the draw may only swap some whose weights are within the noise of the cut
    assert all((rows[i].log_weight >= 0) == (i % 4 > 0) for i in range(300)) and not got[900] and not got[901]
    swapped = [i for i in range(300) if got[i] != (i % 4 > 0)]
    assert len(swapped) <= 6 and all(abs(rows[i].log_weight) < 5 for i in swapped) and sum(got.values()) == 225
    assert {r.doc_id for r in select_quality(df, labels).collect()} == {i for i, k in got.items() if k}


def test_quality_without_labels(spark, no_labels):
    """Texts with words are kept, marks alone are not, n_grams counts n-grams; `draw` draws that many."""
    df = spark.createDataFrame([(i, f"word{i} and more") for i in range(40)] + [(90, "!!! ???"), (91, "   "), (92, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality(df, no_labels).collect()}
    assert all(got[i].kept and got[i].n_grams == 9 for i in range(40)) and not any(got[i].kept or got[i].n_grams for i in (90, 91, 92))
    drawn = [{r.doc_id for r in quality(df, no_labels, draw=10, seed=s).collect() if r.kept} for s in (1, 1, 2)]
    assert [len(d) for d in drawn] == [10, 10, 10] and drawn[0] == drawn[1] != drawn[2]


def test_gumbel_top_k_draws_in_proportion():
    """The largest of log-weight plus noise is item i as often as its weight says; the next one likewise among the rest."""
    from tessera.llm.quality import gumbel

    w = np.array([1.0, 2.0, 3.0, 10.0])
    n = 20_000
    keys = np.log(w) + np.stack([gumbel(np.full(n, i, np.uint64) * np.uint64(7919) + np.arange(n, dtype=np.uint64) * np.uint64(100_003), 29) for i in range(4)], axis=1)
    order = np.argsort(-keys, axis=1)
    first = np.bincount(order[:, 0], minlength=4) / n
    assert np.allclose(first, w / w.sum(), atol=0.015)
    after = order[order[:, 0] == 3, 1]
    assert np.allclose(np.bincount(after, minlength=4)[:3] / len(after), w[:3] / w[:3].sum(), atol=0.02)


def test_equal_texts_have_equal_weights(spark, labels):
    """A text's weight doesn't depend on what stands beside it in a batch."""
    texts = prose(200, seed=5)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in reversed(list(enumerate(texts)))], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.log_weight for r in quality(df, labels).collect()}
    assert all(got[i] == got[1000 + i] for i in range(200))


def test_kth_largest(spark):
    import random

    r = random.Random(6)
    values = [r.gauss(0, 10) for _ in range(500)] + [3.0] * 100 + [float("-inf")] * 5
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 250, 300, 600):
        assert kth_largest(df, "v", k, few=10, bins=8) == sorted(values, reverse=True)[k - 1]


def test_lm_scores_against_brute_force(docs):
    from math import log

    token = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    for order in (1, 2, 3, 4):
        count = Counter()
        for _, t, *_ in awkward():
            w = token(t)
            count.update(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
        total = sum(c for g, c in count.items() if len(g) == 1)

        def score(gram, count=count, total=total):
            if len(gram) == 1:
                return count[gram] / total
            return count[gram] / count[gram[:-1]] if count[gram] >= 2 else 0.4 * score(gram[1:])

        expected = []
        for i, t, *_ in awkward():
            w = token(t)
            expected.append((str(i), len(w), round(sum(log(score(tuple(w[max(0, k - order + 1) : k + 1]))) for k in range(len(w))), 4)))
        got = [(str(r.doc_id), r.n_words, round(r.log_score, 4)) for r in lm_scores(docs, order=order).collect()]
        assert sorted(got) == sorted(expected)


def test_token_counts_against_brute_force(docs):
    """Scores from the merge order's pieces of all documents, and the best of all segmentations, a word at a time."""
    import regex
    import tiktoken

    from tessera.llm.segment import read_vocabulary
    from tessera.llm.token_counts import PATTERN, VOCABULARY

    pieces = read_vocabulary(VOCABULARY)
    rank = {p: i for i, p in enumerate(pieces)}
    merged = tiktoken.Encoding("x", pat_str=r"[\s\S]+", mergeable_ranks=rank, special_tokens={})
    cuts = {t: regex.findall(PATTERN, t or "") for _, t, *_ in awkward()}
    counts = np.full(len(pieces), 0.5)
    for _, t, *_ in awkward():
        for w in cuts[t]:
            for i in merged.encode_ordinary(w):
                counts[i] += 1
    score = np.log(counts / counts.sum())

    def best(word):
        rows = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            rows.append(max((rows[a][0] + score[rank[word[a:end]]], rows[a][1] - 1) for a in range(end) if word[a:end] in rank))
        return -rows[-1][1]

    known = {w: best(w.encode()) for c in cuts.values() for w in c}
    expected = Counter((i, len(cuts[t]), sum(known[w] for w in cuts[t]), len((t or "").encode())) for i, t, *_ in awkward())
    assert Counter((r.doc_id, r.n_pretokens, r.n_tokens, r.n_bytes) for r in token_counts(docs).collect()) == expected


def test_language_id_against_brute_force(spark):
    """The whole query: every segmentation of every word, long ones and ones without spaces too, summed one by one."""
    import tiktoken

    from tessera.llm.language_id import VOCABULARY
    from tessera.llm.segment import read_vocabulary

    long = "straßenbahnhaltestelle" * 6
    rows = [(1, "the river and the stone", "en"), (2, f"der fluss {long}", "de"), (3, "你好世界今天天气很好我们去河边看石头", "zh"), (4, "river stone river", "en"), (5, "fluss und stein", "de"), (6, "今天去看世界", "zh")]
    asked = [(10, f"{long}x{long}", None), (11, "世界河边" * 20, None), (12, "stone and", None), (13, "das boot", None), (14, "... 42", None), (15, None, None), (16, "ñ", None)]
    got = {r.doc_id: r for r in language_id(spark.createDataFrame(rows + asked, "doc_id long, text string, lang string")).collect()}
    pieces = read_vocabulary(VOCABULARY)
    rank = {p: i for i, p in enumerate(pieces)}
    cut = tiktoken.Encoding("x", pat_str=r" ?[^ ]+", mergeable_ranks=rank, special_tokens={})
    word = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    langs = ["de", "en", "zh"]
    counts = np.full((len(pieces), 3), 0.1)
    for _, t, la in rows:
        for w in word(t):
            for i in cut.encode_ordinary(" " + w):
                counts[i, langs.index(la)] += 1
    p = counts / counts.sum(axis=0)

    def log_p(w, k):
        f = [(0.0)]
        for e in range(1, len(w) + 1):
            f.append(float(np.logaddexp.reduce([f[a] + np.log(p[rank[w[a:e]], k]) for a in range(max(0, e - 64), e) if w[a:e] in rank])))
        return f[-1]

    for i, t, _ in rows + asked:
        total = np.array([sum(log_p((" " + w).encode(), k) for w in word(t)) for k in range(3)])
        if not re.search(r"[^\W\d_]", t or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        assert got[i].lang_pred == langs[int(total.argmax())]
        assert abs(got[i].score - 1 / np.exp(total - total.max()).sum()) < 1e-9


def test_trigrams_are_registered(spark, tmp_path):
    """The registered query scores "c" after "a b" by the trigram, which order 2 can't tell from "x b c"."""
    from math import log

    from tessera.llm.queries import QUERIES

    spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, "x b d"), (4, "x b d")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.log_score for r in QUERIES["op9_lm_scores"](spark, str(tmp_path)).collect()}
    # P(a) = 2/12, P(b | a) = 1, P(c | a b) = 1
    assert got == {i: round(log(2 / 12), 4) for i in range(1, 5)}


def test_repeated_passages(spark):
    passage = " ".join(f"shared{i}" for i in range(51))
    other = prose(40, seed=12, size=120)
    rows = [(i, t) for i, t in enumerate(other)]
    rows += [(100 + k, other[k] + "\n" + passage + " " + other[k + 5]) for k in range(0)]
    rows += [(200 + k, " ".join(f"own{k}_{i}" for i in range(20 + k)) + " " + passage.upper() + " " + " ".join(f"end{k}_{i}" for i in range(30))) for k in range(6)]
    rows += [(300, None), (301, ""), (302, "short text"), (None, None)]
    got = {r.doc_id: r for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert set(got) == {200 + k for k in range(6)}
    assert got[200].removed_words == 0 and all(got[200 + k].removed_words >= 24 and got[200 + k].first_docs == [200] for k in range(1, 6))


def test_repeated_passages_are_covered_whole(spark):
    """Passages of 50 words or more, between words of their own, and exact copies: every word is in the spans."""
    import random

    r = random.Random(8)
    own = lambda tag, n: [f"{tag}_{i}" for i in range(n)]
    rows, expected = [], {}
    for n in range(50, 130, 3):
        passage = [f"p{n}_{i}_{r.randrange(99)}" for i in range(n)]
        for k in range(3):
            before = r.randrange(60)
            i = 1000 * (k + 1) + n
            rows.append((i, " ".join(own(f"a{i}", before) + passage + own(f"z{i}", r.randrange(60)))))
            expected[i] = [before, before + n]
    copy = " ".join(own("copy", 300))
    rows += [(9000, copy), (9001, copy.upper()), (None, copy)]
    expected |= {i: [0, 300] for i in (9000, 9001, None)}
    got = {x.doc_id: x for x in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert set(got) == set(expected)
    for i, (lo, hi) in expected.items():
        (start, end), gone = got[i].spans, got[i].removed
        # a window at Jaccard 0.8 may hold two words from beside the passage
        assert lo - 2 <= start <= lo and hi <= end <= hi + 2
        # of the null copy and the first of three documents nothing goes
        assert gone == [] if i is None or i < 2000 else len(gone) == 2 and lo - 2 <= gone[0] <= lo and hi <= gone[1] <= hi + 2


def test_repeated_passages_of_unlike_length(spark):
    """Two documents share more than the third: what only they share is removed from the later one."""
    a, b = [[f"{t}{i}" for i in range(n)] for t, n in (("a", 60), ("b", 20))]
    tail = [f"t{i}" for i in range(30)]
    rows = [(1, " ".join(a + [f"x{t}" for t in tail])), (2, " ".join(a + b + tail[:15])), (3, " ".join(["own", *a, *b]))]
    got = {x.doc_id: (x.spans, x.removed) for x in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ([0, 60], []), 2: ([0, 80], [0, 60]), 3: ([1, 81], [1, 81])}


def brute_passages(rows, length=16, least=50, percent=80):
    """Stretches covered by windows of other documents, joined over short gaps, by document."""
    texts = [words(t) for _, t in rows]
    who = defaultdict(set)
    for (i, _), w in zip(rows, texts, strict=True):
        for k in range(len(w) - length + 1):
            who[tuple(w[k : k + length])].add(i)
    out = {}
    for (i, _), w in zip(rows, texts, strict=True):
        inside, gone = [False] * len(w), [False] * len(w)
        for k in range(len(w) - length + 1):
            ids = who[tuple(w[k : k + length])]
            if len(ids) > 1:
                inside[k : k + length] = [True] * length
                if min(ids) != i:
                    gone[k : k + length] = [True] * length
        edges = [k for k in range(len(w) + 1) if (inside[k - 1] if k else False) != (inside[k] if k < len(w) else False)]
        spans, lost = [], 0
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            if spans and a - spans[-1][1] < 5 and (lost + a - spans[-1][1] + 4) * (100 + percent) <= (b - spans[-1][0] - 4) * (100 - percent):
                lost += a - spans[-1][1] + 4
                spans[-1][1] = b
            else:
                spans.append([a, b])
                lost = 0
        out[i] = ([x for s in spans if s[1] - s[0] >= least for x in s], sum(gone))
    return {i: v for i, v in out.items() if v[0]}


def edited(passage, r, share):
    """The passage with words replaced here and there, as long as the sets of 5-word shingles are alike by `share`."""
    base = {tuple(passage[k : k + 5]) for k in range(len(passage) - 4)}
    best, order = list(passage), list(range(len(passage)))
    r.shuffle(order)
    for k in order:
        trial = [*best[:k], f"edit{r.randrange(10**6)}", *best[k + 1 :]]
        own = {tuple(trial[j : j + 5]) for j in range(len(trial) - 4)}
        if len(own & base) < share * len(own | base):
            break
        best = trial
    return best


def test_passages_against_brute_force(spark):
    """Exact copies, shared passages of many lengths and ones that lie inside others: the same spans, and the same words go."""
    import random

    r = random.Random(14)
    own = lambda tag, n: [f"{tag}_{i}_{r.randrange(99)}" for i in range(n)]
    pool = [own(f"p{k}", 30 + 7 * k) for k in range(12)]
    rows = []
    for i in range(80):
        w = own(f"d{i}", r.randrange(40))
        for _ in range(r.randrange(4)):
            p = pool[r.randrange(12)]
            cut = r.randrange(len(p) - 28)
            w += [*(p if r.random() < 0.5 else p[cut : cut + r.randrange(27, 90)]), *own(f"e{i}", r.randrange(6, 40))]
        rows.append((i, " ".join(w)))
    rows += [(900 + k, rows[k][1]) for k in range(0, 20, 3)]
    expected = brute_passages(rows)
    got = {x.doc_id: x for x in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert {i: x.spans for i, x in got.items()} == {i: s for i, (s, _) in expected.items()}
    exact = [i for i, (s, n) in expected.items() if n == 0]
    assert len(expected) > 40 and any(got[i].removed == [] for i in exact)
    for i, (s, _) in expected.items():  # of every passage somebody keeps a copy
        assert got[i].removed_words == 0 or min(got[i].first_docs) < i


@pytest.mark.parametrize("share", [0.8, 0.9])
def test_recall_of_edited_passages(spark, share):
    """Passages of 51 to 200 words with edits, alike by 0.8 or more: at least 0.9 of the pairs are found; texts of their own are left alone."""
    import random

    r = random.Random(15)
    own = lambda tag, n: [f"{tag}_{i}_{r.randrange(99)}" for i in range(n)]
    rows, sizes = [], {}
    for k in range(150):
        p = own(f"p{k}", r.randrange(51, 201))
        for i, text in ((2 * k, p), (2 * k + 1, edited(p, r, share))):
            before = r.randrange(50)
            rows.append((i, " ".join([*own(f"a{i}", before), *text, *own(f"z{i}", r.randrange(50))])))
            sizes[i] = (before, before + len(p))
    rows += [(1000 + i, " ".join(own(f"c{i}", 150))) for i in range(50)]
    got = {x.doc_id: x for x in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert not [i for i in got if i >= 1000]
    covered = [i for i, (lo, hi) in sizes.items() if i in got and got[i].repeated_words >= 0.9 * (hi - lo)]
    assert len(covered) >= 0.9 * len(sizes)
    assert all(lo <= got[i].spans[0] and got[i].spans[-1] <= hi for i, (lo, hi) in sizes.items() if i in got)
    # the later one of a pair goes whole: words that differ, too
    later = [i for i in covered if i % 2 and i - 1 in got]
    assert sum(got[i].removed == got[i].spans and got[i].first_docs == [i - 1] for i in later) >= 0.9 * len(later)


def test_awkward_rows_do_not_crash(docs, labels, no_labels, spark):
    for lab in (labels, no_labels):
        assert toxicity(docs, lab).count() == N
        assert quality(docs, lab).count() == N
    assert language_id(docs).count() == N
    assert mix_plan(docs).count() == N
    assert all(r.doc_id is None or r.doc_id in (7, 8, 10, 11, 12) for r in repeated_passages(docs).collect())


def test_empty_tables(none, labels, spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert none.schema == spark.createDataFrame([], SCHEMA).schema
    for out in (exact_dedup(none), near_dedup(none), contamination(none, bench), mix_plan(none), mix(none), language_id(none), toxicity(none, labels), quality(none, labels), select_quality(none, labels), lm_scores(none), token_counts(none), repeated_passages(none)):
        assert out.count() == 0


def test_toxicity_against_brute_force(spark):
    """The whole query: tokens, segments, calibration and curve from plain loops over the same sample."""
    from math import exp, log, log1p

    import random

    r = random.Random(31)
    calm = [f"calm{k}" for k in range(60)]
    rows = []
    for i in range(240):
        w = [r.choice(calm) for _ in range(r.randrange(8, 60))]
        if i % 4 == 0:
            for _ in range(r.randrange(1, 4)):
                w.insert(r.randrange(len(w)), r.choice(["Vileß", "vileßer", "scum", "scumbag", "rötten"]))
        elif i % 37 == 0:
            w.append("scum")
        rows.append((i, " ".join(w)))
    rows += [(900, None), (901, ""), (902, "scum"), (903, "calm1 " * 300 + "scum")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)], "doc_id long, toxic int")
    third = {x.doc_id: x.m for x in df.selectExpr("doc_id", "pmod(xxhash64(coalesce(text, '')), 3) as m").collect()}
    word = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    views = lambda w: {(v, w[:v] if v else w) for v in (4, 5, 7, 0)}
    train = [(word(t), int(i % 4 == 0), t) for i, t in rows if i < 240 and third[i]]
    rest = [(word(t), int(i % 4 == 0)) for i, t in rows if i < 240 and not third[i]]
    n, n_t = len(train), sum(y for _, y, _ in train)
    texts, toxic = Counter(), Counter()
    for w, y, _ in train:
        for token in {x for a in w for x in views(a)}:
            texts[token] += 1
            toxic[token] += y
    many = [t for t in texts if toxic[t] >= 3]
    places = sum(len(t.split()) for *_, t in train) / n
    odds, chance = {}, []
    for t in many:
        a, b = toxic[t] + 10 * texts[t] / n + 0.5, texts[t] - toxic[t] + 10 * texts[t] / n + 0.5
        x, y = toxic[t], texts[t] - toxic[t]
        ratio = 2 * (x * log(x / (texts[t] * n_t / n)) + (y * log(y / (texts[t] * (1 - n_t / n))) if y else 0))
        value = log(a / (n_t + 11 - a)) - log(b / (n - n_t + 11 - b))
        if value > 0 and ratio > 2 * log(len(many)):
            odds[t] = value
            chance.append((value, b / (n - n_t + 11) / places))
    lo, hi = 1e-3, 5.0
    for _ in range(60):
        mid = (lo + hi) / 2
        total = sum(c * exp(mid * v) for v, c in chance) + max(1 - sum(c for _, c in chance), 0.5) * exp(-mid * 0.25)
        lo, hi = (mid, hi) if total < 1 else (lo, mid)

    def found(w):
        score = [max([odds.get(x, 0) for x in views(a)]) or -0.25 for a in w]

        def best(a, b):  # the best stretch, and what lies beside it
            top = max(((sum(score[i:j]), i - j, -i) for i in range(a, b) if score[i] > 0 for j in range(i + 1, b + 1) if score[j - 1] > 0), default=None)
            if top is None:
                return []
            i = -top[2]
            j = i - top[1]
            return [*best(a, i), top[0], *best(j, b)]

        return best(0, len(w))

    clean = sorted([s for w, y in rest if not y for s in found(w)], reverse=True) + [min(odds.values())]
    k = max((i + 1) * exp(lo * s) for i, s in enumerate(clean) if i + 1 >= min(5, len(clean))) / (sum(len(w) for w, y in rest if not y) + 1)
    evidence = lambda w: sum(max(lo * s - log(k * len(w)), 0) for s in found(w))
    x = np.array([[log1p(evidence(w)), 1] for w, _ in rest])
    y = np.array([y for _, y in rest], float)
    beta = np.array([0.1, log((y.sum() + 1) / (len(y) - y.sum() + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ beta)))
        beta = beta + np.clip(np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag([0.5, 0.005]), x.T @ (y - p) - np.array([0.5, 0.005]) * beta), -2, 2)
    got = {g.doc_id: g.score for g in toxicity(df, labels).collect()}
    for i, t in rows:
        assert abs(got[i] - 1 / (1 + exp(-(beta[0] * log1p(evidence(word(t))) + beta[1])))) < 1e-6
    assert got[902] > got[903] > got[901]


def test_quality_against_brute_force(spark):
    """The whole query from dictionaries of n-grams: two models, log-ratios, the cut, noise, and the k largest keys."""
    from math import log

    from tessera.llm.quality import gumbel

    buckets, seed = 1 << 22, 29
    good = prose(60, seed=41, size=14)
    rows = [(i, t.capitalize() + "." if i % 3 else f"{t.split()[0].upper()}!! " * 9 + "7 7") for i, t in enumerate(good)] + [(900, "Stone1, stone1 and THE river 42!"), (901, "..."), (902, None), (903, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(45)], "doc_id long, quality int")
    half = {r.doc_id: r.h for r in df.selectExpr("doc_id", "pmod(xxhash64(coalesce(text, '')), 2) = 0 as h").collect()}

    def grams(text):
        tokens = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff\x20\x09-\x0d]+", text or "")
        out, before, shape_before, word_before, words_ = [], None, None, None, 0
        for t in tokens:
            low = t.translate(LOWER)
            is_word = bool(re.match(r"[0-9A-Za-z\x80-\U0010ffff]", t))
            ups = sum("A" <= c <= "Z" for c in t)
            shape = (4 if re.search("[0-9]", t) else 3 if ups >= 2 and 2 * ups > len(t.encode()) else 2 if ups else 1) if is_word else low
            same = is_word and word_before == low
            out += [(1, "same" if same else low), (2, "same") if same else (2, before, low), (3, shape_before, shape)]
            before, shape_before = low, shape
            if is_word:
                word_before = low
                words_ += 1
        return out if words_ else out, words_

    of = {i: grams(t) for i, t in rows}
    raw = Counter(g for g, _ in of.values() for g in g)
    picked = [i for i in range(45) if half[i] and i % 3]
    target = Counter(g for i in picked for g in of[i][0])
    whole = sum(raw.values()) + 0.5 * buckets

    def ratio(g):
        p = (raw[g] + 0.5) / whole
        return log((target[g] + 2 * buckets * p) / (sum(target.values()) + 2 * buckets) / p)

    mean = {i: sum(map(ratio, g)) / max(len(g), 1) for i, (g, w) in of.items()}
    seen = sorted((mean[i], i % 3 > 0) for i in range(45) if not half[i])
    n_good = sum(y for _, y in seen)
    loss = [sum(4 / n_good for _, y in seen[:c] if y) + sum(1 / (len(seen) - n_good) for _, y in seen[c:] if not y) for c in range(len(seen) + 1)]
    best = [c for c in range(len(loss)) if loss[c] <= min(loss) + 1e-12]
    c = best[len(best) // 2]
    cut = (seen[max(c - 1, 0)][0] + seen[min(c, len(seen) - 1)][0]) / 2
    n = {i: len(g) if w else 0 for i, (g, w) in of.items()}
    weight = {i: n[i] * (mean[i] - cut) for i in of}
    noise = dict(zip(of, gumbel(np.array(list(of), np.int64).view(np.uint64), seed).tolist(), strict=True))
    some = [i for i in of if n[i]]
    k = sum(weight[i] >= 0 for i in some)
    kept = set(sorted(some, key=lambda i: -weight[i] - noise[i])[:k])
    got = {r.doc_id: r for r in quality(df, labels, buckets=buckets, seed=seed).collect()}
    assert {i: r.n_grams for i, r in got.items()} == n
    assert all(abs(got[i].log_weight - weight[i]) < 1e-6 * (1 + abs(weight[i])) for i in some)
    assert {i for i, r in got.items() if r.kept} == kept and 0 < k < len(some)
