"""Rules that keep queries whole on larger tables."""

import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import binary as B
from tessera.operators import pixels as P
from tessera.operators import specimens as S
from tessera.plans import registry  # first: it reads the others
from tessera.plans import codecs, geometry
from tessera.sources import annotations as A
from tessera.sources import dicom
from tessera.sources import elements as E
from tessera.sources.sinks import save_slides

HEADER = {"SOPInstanceUID": "1.2.3.4", "StudyInstanceUID": "1.2", "Rows": 4, "Columns": 4, "SamplesPerPixel": 1, "BitsAllocated": 8}


def test_many_files_share_partitions(tmp_path):
    """jn02: partitions follow the bytes, not the files; each file and range is in one of them."""
    for k in range(300):
        (tmp_path / f"{k:03}.dcm").write_bytes(b"x" * 10)
    parts = dicom._FrameReader({"path": str(tmp_path)}).partitions()
    assert len(parts) == 64 and [f[0] for p in parts for f in p.files] == sorted(str(tmp_path / f"{k:03}.dcm") for k in range(300))
    parts = dicom._FrameReader({"path": str(tmp_path), "splitbytes": "3"}).partitions()
    assert len(parts) == 64 and sorted((f[0], i) for p in parts for f in p.files for i in range(f[1], f[2])) == [(str(tmp_path / f"{k:03}.dcm"), i) for k in range(300) for i in range(4)]
    assert len(dicom._FrameReader({"path": str(tmp_path / "00*.dcm")}).partitions()) == 10


def test_parts_beyond_16_bits(tmp_path):
    """snk13: the standard's element for a part's number has 16 bits; another one holds what is larger."""
    for n in (1, 65535, 65536, 300_000):
        dicom.write_file(str(tmp_path / str(n)), HEADER | dicom.numbered(n), [b"\0" * 16])
        with open(tmp_path / str(n), "rb") as f:
            v = dicom.read_header(f).values
        assert dicom.part_number(v) == n and ("InConcatenationNumber" in v) == (n < 65536)
    assert dicom.part_number({"PartCreator": "other", "PartNumber": 4}) is None


@pytest.mark.parametrize("sparse", [False, True])
def test_frames_of_a_file_stay_together(spark, tmp_path, sparse):
    """snk13: joins with small tables, seen as such only when they run, don't deal a file's frames to several tasks."""
    frames = spark.range(0, 6000, 1, 8).mapInArrow(lambda b: b, "id long").select((F.col("id") % 3).alias("slide"), F.floor(F.col("id") / 3).alias("frame_index"), F.lit(10).alias("across"), (F.floor(F.col("id") / 3) % 10).alias("tile_x"), F.floor(F.col("id") / 30).alias("tile_y"), F.unhex(F.lpad(F.hex("id"), 32, "0")).alias("data"))
    kept = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10m")
        saved = save_slides(frames, str(tmp_path), tile=4, columns="across", per_part=16, sparse=sparse)
        written = {(r.slide, r.part): r.n_frames for r in saved.collect()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert written == {(s, p): 16 for s in range(3) for p in range(125)}
    ran = saved._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "REPARTITION_BY_COL" in ran  # without it tasks got what joins had read locally
    with open(tmp_path / "2-7.dcm", "rb") as f:
        h = dicom.read_header(f)
        found = [(f.seek(at), int.from_bytes(f.read(n), "big"))[1] for at, n in dicom.frames(f, h)]
    assert found == [3 * k + 2 for k in range(7 * 16, 8 * 16)] and next(dicom.places(h, range(1)))[:2] == (2, 11)


@pytest.mark.parametrize("undefined", [False, True])
def test_only_the_wanted_frames_items_are_read(tmp_path, monkeypatch, undefined):
    """src12: a range of a file reads the items of its own frames and the first, and still sees that a file is cut."""
    at = [{"PlanePositionSlideSequence": [{"ColumnPositionInTotalImagePixelMatrix": 4 * k + 1, "RowPositionInTotalImagePixelMatrix": 1}]} for k in range(50)]
    path = str(tmp_path / "a.dcm")
    dicom.write_file(path, HEADER | {"PerFrameFunctionalGroupsSequence": at}, [b"\0" * 16] * 50, undefined=undefined)
    with open(path, "rb") as f:
        whole, parsed, parse = dicom.read_header(f), [], E.parse
        f.seek(0)
        monkeypatch.setattr(E, "parse", lambda *a, **k: parsed.append(1) or parse(*a, **k))
        some = dicom.read_header(f, lambda n: range(n - 3, n))
    assert len(parsed) == 1 + 2 * 4 and (some.pixels_at, some.pixels_length) == (whole.pixels_at, whole.pixels_length)
    assert list(dicom.places(some, range(47, 50))) == list(dicom.places(whole, range(47, 50)))
    raw = open(path, "rb").read()
    (tmp_path / "cut.dcm").write_bytes(raw[: whole.pixels_at - 80])
    if not undefined:
        with open(tmp_path / "cut.dcm", "rb") as f, pytest.raises(E.Truncated):
            dicom.read_header(f, lambda n: range(0))


def test_steps_of_a_frequent_identifier(spark):
    """jn11: 30,000 steps and 30,000 specimens of one identifier are no pairs."""
    issuer = lambda c, n: F.when(c % n > 0, F.concat(F.lit("lab"), (c % n).cast("string")))
    k = F.col("id")
    specimens = spark.range(1, 30_001).select(k.alias("specimen"), k.alias("nth"), F.lit("x").alias("identifier"), issuer(k, 3).alias("issuer"))
    steps = spark.range(30_000).select(k.alias("step"), F.lit("x").alias("identifier"), issuer(k, 5).alias("step_issuer"))
    began = time.monotonic()
    got = {r.step: r.specimen for r in S.matched_steps(steps, specimens).collect()}
    assert time.monotonic() - began < 30
    # specimens 1, 2 and 3 are the first of lab1, of lab2 and without an issuer
    assert got == {i: {0: 3, 1: 1, 2: 2}.get(i % 5, 3) for i in range(30_000)}
    few = S.matched_steps(steps.limit(10), specimens.where("issuer is not null"))  # no specimen without an issuer
    assert {r.step: r.specimen for r in few.collect()} == {i: {0: 1, 1: 1, 2: 2}[i % 5] for i in range(10) if i % 5 < 3}


def test_items_in_the_order_of_the_check(spark, tmp_path):
    """flt15: parts beyond a million outweigh line numbers, and of rows with the same number the first counts."""
    rows = [(1, 2_500_000, 7, 1, "R", "F"), (1, 5, 8, 2, "R", "F"), (2, 5, 9, 1, "R", "F"), (2, 5, 3, 1, "R", "F"), (3, 5, 3, 1, "N", "F")]
    frame = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string")
    frame.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {tuple(r) for r in registry.QUERIES["flt15_item_selection"](spark, str(tmp_path)).collect()}
    assert got == {(1, 8, 2), (2, 9, 2)}


def test_annotations_are_held_as_arrays(tmp_path):
    """ann02, ann04, ann06, snk23, src24: a group of 100,000 annotations is read in a few bytes a number."""
    n = 100_000
    group = A._group("POLYLINE", np.full(n, 5), np.arange(10.0 * n), 2, {("c", "um"): (np.arange(0, n, 2), np.arange(0.0, n, 2))}, True)
    path = str(tmp_path / "a.dcm")
    A.write_annotations(path, [group], "1.2")
    reader = A._Reader({"path": path})
    tracemalloc.start()
    rows = sum(1 for p in reader.partitions() for _ in reader.read(p))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == n and peak < 60 << 20  # 9 MB of file; lists took several times as much
    last = list(A._decoded(group, 2))[n - 2]
    assert last[0].tolist() == [[10.0 * (n - 2) + 2 * i, 10.0 * (n - 2) + 2 * i + 1] for i in range(5)] and last[1] == [("c", "um", float(n - 2))]


def test_few_rows_that_become_many_are_spread(spark, tmp_path):
    """geo19: levels of one file's split are dealt to partitions before their frames are counted up."""
    spark.range(12_000).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    got = registry.QUERIES["geo19_full_frame_index"](spark, str(tmp_path))
    assert got.rdd.getNumPartitions() == 3


def test_only_slides_with_frames_ask_for_them(spark, tmp_path):
    """jn01, flt14: tiles of slides without frames aren't joined, and none is lost."""
    spark.range(4000).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    frames = spark.createDataFrame([(3, 0, 0), (7, 1, 2)], "slide_id long, x long, y long")
    asked, blank = geometry._grids(spark, str(tmp_path), frames)
    assert {r.slide_id for r in asked.select("slide_id").distinct().collect()} == {3, 7}
    assert blank.select("slide_id").distinct().count() == 998
    tiles = {(r.slide_id, r.x, r.y) for r in asked.unionByName(blank).collect()}
    size = lambda base, k, m: -(-(base + k % m) // 256)
    assert len(tiles) == sum(size(1024, s * 977, 7168) * size(768, s * 613, 5120) for s in range(1000))


def test_ancestors_without_leaves(spark):
    """spm07: samples that nothing was taken from don't go through the rounds; the ancestors of the others are the same."""
    edges = spark.createDataFrame([("C1", "B1"), ("B1", "P1"), ("C2", "B1"), ("C2", "B2")] + [(f"S{k}", f"C{1 + k % 2}") for k in range(100)] * 2, "child string, parent string")
    inner = S.inner(edges)
    assert sorted(map(tuple, inner.collect())) == [("B1", "P1"), ("C1", "B1"), ("C2", "B1"), ("C2", "B2")]
    whole = {(r.child, r.ancestor) for r in S.ancestors(edges.distinct()).collect() if r.child[0] != "S"}
    assert {(r.child, r.ancestor) for r in S.ancestors(inner).collect()} == whole


def test_pairs_of_few_values_are_spread(spark, tmp_path):
    """flt11: pairs of a small file with ten values aren't made by one task."""
    k = F.col("id")
    spark.range(2000).select(k.alias("s_suppkey"), k.cast("string").alias("s_name"), k.alias("s_nationkey")).coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    assert registry.QUERIES["flt11_identifier_relaxed"](spark, str(tmp_path)).rdd.getNumPartitions() == 4


def _python_steps(df) -> int:
    return len(re.findall(r"(?m)^[ :*()0-9+-]*(?:MapInArrow|PythonMapInArrow|ArrowEvalPython|BatchScan)", df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]))


def _vectors(spark, folder, n: int):
    """n vectors of 64 numbers from -1 to 1 as the table of embeddings."""
    numbers = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (((F.col("id") * 64 + i) * 7919 % 2001 - 1000) / 1000).cast("float"))
    spark.range(n).select(F.col("id").alias("vec_id"), numbers.alias("embedding")).coalesce(1).write.parquet(str(folder / "embeddings.parquet"))


def test_encoders_share_a_step(spark, tmp_path):
    """pix19: one Python step for all encoders, over partitions that follow the rows, in batches that don't follow Spark's."""
    _vectors(spark, tmp_path, 2500)
    got = registry.QUERIES["pix19_encode"](spark, str(tmp_path))
    assert _python_steps(got) == 1 and got.where("frames = 2500 and even and again").count() == 6
    batch = pa.RecordBatch.from_arrays([pa.array(range(2500)), pa.array([[0.5] * 64] * 2500, pa.list_(pa.float32()))], names=["vec_id", "embedding"])
    parts = list(P.packing(iter([batch])))
    assert [len(p) for p in parts] == [1024, 1024, 452] and pa.Table.from_batches(parts).column(0).to_pylist() == list(range(2500))
    assert sum(1 for _ in P.cut(iter([batch]), 1 << 20)) == 2500


def test_kinds_of_numbers_share_a_step(spark, tmp_path):
    """bin01: all kinds go to bytes and back in one Python step; nulls, bytes left over and empty lists stay what they were."""
    _vectors(spark, tmp_path, 50)
    got = registry.QUERIES["bin01_number_bytes"](spark, str(tmp_path))
    assert _python_steps(got) == 1 and {(r.kind, r.bytes, r["count"]) for r in got.groupBy("kind", "bytes").count().collect()} == {("double", 512, 50), ("float", 256, 50), ("long", 256, 50)}
    lists = spark.createDataFrame([(0, [1.5, -2.0]), (1, None), (2, []), (3, [3.25])], "id long, v array<double>").coalesce(1)
    raw = lists.select("id", B.number_bytes(F.col("v"), "long").alias("raw"))
    assert {r.id: r.raw and bytes(r.raw) for r in raw.collect()} == {0: b"\x01\0\0\0\xfe\xff\xff\xff", 1: None, 2: bytearray(), 3: b"\x03\0\0\0"}
    odd = raw.select("id", F.when(F.col("id") == 3, F.substring("raw", 1, 3)).otherwise(F.col("raw")).cast("binary").alias("raw"))
    assert {r.id: r.v for r in odd.select("id", B.numbers(F.col("raw"), "long").alias("v")).collect()} == {0: [1.0, -2.0], 1: None, 2: [], 3: None}
    assert raw.where("id > 9").select(B.numbers(F.col("raw"), "long")).collect() == []


def test_tiles_outside_a_region_are_not_decoded(spark, tmp_path, monkeypatch):
    """pix11: frames are encoded in the step that packs them, and only those that the region touches become pixels."""
    _vectors(spark, tmp_path, 1400)
    seen, whole, steps = [], codecs._pixels, []
    stored = codecs.save_slides
    monkeypatch.setattr(codecs, "_pixels", lambda frames, *a, **k: seen.append(frames) or whole(frames, *a, **k))
    monkeypatch.setattr(codecs, "save_slides", lambda frames, *a, **k: steps.append(_python_steps(frames)) or stored(frames, *a, **k))
    got = {r.identifier: r.pixels for r in registry.QUERIES["pix11_region_mm"](spark, str(tmp_path)).collect()}
    assert got == {f"1.2.3.{k}": 800 for k in range(7)} and steps == [1]
    assert seen[0].count() == 7 * 5 * 3  # of 1400


def test_regions_asked_for_twice_are_drawn_once(spark, tmp_path, monkeypatch):
    """pix04: 300 requests of 3 regions draw 3, in partitions that follow their number."""
    _vectors(spark, tmp_path, 400)
    k = F.col("id")
    spark.range(300).select((k % 3 + 126_000 * F.floor(k / 3)).alias("event_id")).write.parquet(str(tmp_path / "events.parquet"))
    seen, own = [], P.stitch
    monkeypatch.setattr(P, "stitch", lambda *a: seen.append(own(*a)) or seen[-1])
    got = registry.QUERIES["pix04_stitch"](spark, str(tmp_path)).collect()
    assert seen[0].count() == 3 and seen[0].rdd.getNumPartitions() == 1
    assert len({r.request_id for r in got}) == len(got) == 300 and len({(r.request_id % 3, r.w, r.h, r.total) for r in got}) == 3


def test_pixels_are_decoded_in_batches_of_bounded_size():
    """pix18: what the decoding step holds of a batch doesn't follow the number of rows that Spark sends at once."""

    class Frames:
        schema = ()

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    batch = pa.RecordBatch.from_arrays([pa.array([bytes(range(64))] * 2500, pa.binary())], names=["data"])
    parts = list(codecs._pixels(Frames(), codecs.C.EXPLICIT, [])(iter([batch])))
    assert [len(p) for p in parts] == [65536, 65536, 28928] and pa.Table.from_batches(parts).column("v").to_pylist() == list(range(64)) * 2500
