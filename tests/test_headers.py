import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.functions import binary as B
from tessera.operators import headers as H
from tessera.operators import metadata as M
from tessera.operators import specimens as S
from tessera.sources import dicom
from tessera.sources.sinks import save_slides

PLACE = "slide_id long, uid string, width long, height long, x double, y double, rotation double, ext struct<planes:bigint,distance:double>"


def test_pyramids_are_greedy(spark):
    """Matching isn't transitive: the largest come first, and a member that one of a pyramid's doesn't match starts its own."""
    rows = [
        (1, "a", 900, 9, 0.000, 0.0, 0.0, None), (1, "b", 800, 9, 0.015, 0.0, 0.0, None), (1, "c", 700, 9, 0.030, 0.0, 0.0, None), (1, "d", 600, 9, 0.010, 0.0, 90.0, None),
        (1, "e", 500, 9, 0.000, 0.0, 0.0, (2, 0.5)), (1, "f", 400, 9, None, None, None, None), (1, "g", 300, 9, None, None, None, None), (1, "h", 200, 9, 0.025, 0.0, 0.0, None), (1, "i", 100, 9, 0.0, 0.0, 0.0, None),
        (2, "z", 1, 1, 0.0, 0.0, 0.0, None),
    ]
    got = {(r.slide_id, r.uid): r.pyramid for r in H.pyramids(spark.createDataFrame(rows, PLACE)).collect()}
    # c is within reach of b but not of a; h joins c; i has the very place of the first
    assert [got[1, u] for u in "abcdefghi"] == [0, 0, 1, 2, 3, 4, 4, 1, 0] and got[2, "z"] == 0


def test_equal_spacing_compares_with_the_first(spark):
    for planes, expected in (([0.0, 1.0, 2.0], True), ([0.0, 1.0, 2.0 + 2e-6], False), ([5.0], True), ([0.0, 7.0], True), ([3.0, 0.0, 1.0], False), ([0.0, 1.0, 2.0 + 9e-7, 3.0 + 18e-7], True)):
        assert spark.range(1).select(H.equally_spaced(F.lit(planes))).first()[0] is expected


def test_strict_rules_raise(spark):
    wrong = F.struct(F.lit("1").alias("syntax"), F.lit(16).alias("bits"), F.lit(1).alias("samples"))
    row = spark.createDataFrame([("x", 8, 3, None)], "syntax string, bits int, samples int, study_uid string")
    none = F.lit(None).cast("struct<syntax:string,bits:int,samples:int>")
    assert row.select(H.transcoding(F.lit(True), none, none)).first()[0] == "copy x"
    for column in (H.transcoding(F.lit(True), wrong, none, strict=True), M.defaulted(F.col("study_uid"), required=True, name="study_uid"), B.same_length(F.lit([1, 2]), F.lit([1]), strict=True)):
        with pytest.raises(PySparkException):
            row.select(column).collect()


def test_segmented_tables():
    rng = np.random.default_rng(1)
    for values in ([5] * 20, list(range(0, 200, 7)), rng.integers(0, 65536, 30).tolist(), [0, 1, 2, 3, 9, 9, 9, 9, 1], [7], []):
        words = B.segmented(values)
        assert B.expanded(words) == values
    assert len(B.segmented([5] * 300)) < 10
    for words in ([2, 3, 0, 0], [0, 9, 1], [1, 4, 7], [0], [7, 1, 1]):
        assert B.expanded(words) is None


@pytest.mark.parametrize("multi", [True, False])
def test_profile_descriptions(multi):
    assert B.description(B.with_description("Scanner 7", multi)) == "Scanner 7"
    assert B.description(b"") is None and B.description(None) is None and B.description(b"\0" * 200) is None


def test_ordered_steps_follow_the_constraint(spark):
    edges = spark.createDataFrame([("s<c", "s", "c", 0, "c<b2"), ("c<b1", "c", "b1", 0, None), ("c<b2", "c", "b2", 1, None), ("b2<p", "b2", "p", 0, None)], "sampling string, child string, parent string, ordinal int, follows string")
    steps = spark.createDataFrame([("p", 0, "collection"), ("b1", 0, "never"), ("b2", 0, "embedding"), ("c", 0, "staining"), ("s", 0, "mounting")], "specimen string, ordinal int, step string")
    starts = spark.createDataFrame([("s",)], "start string")
    got = [(r.specimen, r.step) for r in S.ordered_steps(edges, steps, starts).orderBy("nth").collect()]
    assert got == [("p", "collection"), ("p", "sampling"), ("b2", "embedding"), ("b2", "sampling"), ("c", "staining"), ("c", "sampling"), ("s", "mounting")]
    loop = spark.createDataFrame([("a<a", "s", "s", 0, None)], "sampling string, child string, parent string, ordinal int, follows string")
    with pytest.raises(ValueError, match="cycle"):
        S.ordered_steps(loop, steps, starts, most=4)


def test_slides_in_parts(spark, tmp_path):
    """Sparse, coloured, in parts: headers and places of all frames, and nothing left of unfinished files."""
    rows = [(s, i, 3, i % 3, i // 3, bytearray([s * 10 + i] * 48)) for s in (1, 2) for i in range(7)]
    frames = spark.createDataFrame(rows, "slide long, frame_index long, across long, tile_x long, tile_y long, data binary").repartition(5)
    done = save_slides(frames, str(tmp_path / "out"), tile=4, columns="across", samples=3, photometric="RGB", per_part=3, sparse=True).collect()
    assert sorted((r.slide, r.part, r.n_frames) for r in done) == [(s, p, n) for s in (1, 2) for p, n in ((0, 3), (1, 3), (2, 1))]
    assert all(n.endswith(".dcm") for n in map(str, (tmp_path / "out").iterdir()))
    dicom.register(spark)
    got = spark.read.format("dicomframes").load(str(tmp_path / "out")).collect()
    assert {(r.identifier, r.frame_index, r.tile_x, r.tile_y, bytes(r.data)) for r in got} == {(f"1.2.3.{s}.0", i, x, y, bytes(d)) for s, i, _, x, y, d in rows}
    heads = spark.read.format("dicomslides").load(str(tmp_path / "out")).collect()
    assert {(r.concat_uid, r.concat_number, r.concat_offset, r.samples, r.total_columns, r.total_rows) for r in heads} == {(f"1.2.3.{s}.0", p + 1, 3 * p, 3, 12, 12) for s in (1, 2) for p in range(3)}
