import shutil

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return tmp_path_factory.mktemp("corpus")


def test_stages(spark, folder):
    from .test_operators import brute_near, prose

    texts = prose(120, seed=21, size=120)
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    rows += [(200, texts[5].upper(), "en", "s0", 1), (201, texts[6] + " tail", "en", "s1", 1), (202, "junk " * 60, "en", "s1", 1), (5, texts[5], "en", "s0", 1), (204, "so far so good", None, None, None), (None, None, None, None, None)]
    leak = " ".join(f"exam{i}" for i in range(20))
    rows += [(203, leak, "en", "s2", 1)] + [(300 + i, f"bad{i} " * 40, "en", "s2", 1) for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(300 + i, 0, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, docs, str(folder))
        assert set(docs.columns) == set(out.columns)
        path = f"{folder}/{name.replace(' ', '_')}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    after = list(seen.values())
    assert set(range(120)) <= set(after[0]) and 202 not in after[0] and not {300 + i for i in range(30)} & set(after[0]) and None not in after[0]
    assert after[1].count(5) == 1 and 200 not in after[1] and set(range(120)) <= set(after[1])
    kept = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/exact_dedup").collect()]
    assert sorted(after[2]) == sorted(i for i, _, c in brute_near(kept, 5, 80) if i == c)
    assert set(after[2]) - set(after[3]) == {203} & set(after[2])
    assert set(after[4]) <= set(after[3]) and len(after[4]) > 0
    result = corpus_pipeline.run(spark, str(folder))
    assert sorted(r.doc_id for r in result.collect()) == sorted(after[4])
    shutil.rmtree(folder)


def test_torn_identifiers(spark, folder):
    """An identifier with kept and dropped rows, and null identifiers: one row of each text stays."""
    rows = [(1, "one"), (1, "one"), (1, "two"), (2, "TWO"), (None, "three"), (None, "Three"), (None, "four"), (3, "four")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = dict(corpus_pipeline.STAGES)["exact dedup"](spark, docs, "").collect()
    assert sorted(r.text.lower() for r in out) == ["four", "one", "three", "two"]


def test_near_dedup_by_row(spark):
    """Null and repeated identifiers: one row of each component stays, rows of other components are untouched."""
    texts = {k: [f"{k}{i}" for i in range(60)] for k in "abcdef"}
    copy = lambda k, tail: " ".join([*texts[k], tail])
    rows = [
        (1, copy("a", "x")), (None, copy("a", "y")), (None, copy("b", "x")),  # a null copy, and a clean null row
        (2, copy("c", "x")), (3, copy("c", "y")), (3, copy("d", "x")),  # an identifier with a copy and a clean text
        (4, copy("e", "x")), (4, copy("e", "y")), (4, copy("e", "z")),  # copies under one identifier
        (5, copy("f", "x")), (6, None), (None, None), (None, ""),  # no words: never copies
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = dict(corpus_pipeline.STAGES)["MinHash near-dedup"](spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, (r.text or " ")[0]) for r in out.collect()), key=str)
    assert got == sorted([(1, "a"), (None, "b"), (2, "c"), (3, "d"), (4, "e"), (5, "f"), (6, " "), (None, " "), (None, " ")], key=str)


def _run_stages(spark, folder, docs, labels, bench):
    labels.write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    bench.write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    for k, (name, function) in enumerate(corpus_pipeline.STAGES):
        out = function(spark, docs, str(folder))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        yield name, docs


def test_awkward_rows(spark, docs, none, labels, no_labels, tmp_path):
    """Nulls, long texts, ties and clashing names go through every stage; empty tables give no rows."""
    names = ["_n", "_id", "_own", "_sha", "gone", "key", "kept", "span", "copies", "size"]
    wide = docs.select("*", *[docs["text"].alias(n) for n in names])
    bench = spark.createDataFrame([(1, "nothing like it")], "item_id long, text string")
    seen = {name: out.collect() for name, out in _run_stages(spark, tmp_path / "a", wide, no_labels, bench)}
    texts = [r.text for r in seen["exact dedup"]]
    assert len(texts) == len({(t or "").lower() for t in texts})
    assert all(r["_n"] == r.text for rows in seen.values() for r in rows)
    assert any(len(r.text) > 100_000 for r in seen["benchmark decontamination"])
    for k, lab in enumerate((labels, no_labels)):
        assert all(out.isEmpty() for _, out in _run_stages(spark, tmp_path / f"b{k}", none, lab, bench.limit(0)))


def test_leaks_in_long_documents(spark, tmp_path):
    """A whole window of a test item makes a leak of a document of any length; short items only where they weigh a twentieth."""
    item = [f"exam{i}" for i in range(20)]
    rows = [(1, " ".join([f"own{i}" for i in range(5000)] + item[3:16])), (2, " ".join([f"own{i}" for i in range(5000)] + item[3:15])), (3, " ".join([f"own{i}" for i in range(100)] + ["short", "one"])), (4, "short one here"), (5, None), (6, "")]
    spark.createDataFrame([(1, " ".join(item)), (2, "short one")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = dict(corpus_pipeline.STAGES)["benchmark decontamination"](spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
    assert sorted(r.doc_id for r in out.collect()) == [2, 3, 5, 6]


def test_near_dedup_leaves_other_rows_of_an_identifier(spark):
    a, b = (" ".join(f"{k}{i}" for i in range(60)) for k in "ab")
    stage = dict(corpus_pipeline.STAGES)["MinHash near-dedup"]
    for rows, expected in (
        ([(1, a), (2, a + " tail"), (2, b)], [(1, "a"), (2, "b")]),
        ([(1, a), (None, a + " end"), (None, b)], [(1, "a"), (None, "b")]),
        ([(1, a), (1, a + " tail")], [(1, "a")]),
    ):
        got = stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
        assert sorted(((r.doc_id, r.text[0]) for r in got), key=str) == sorted(expected, key=str)
