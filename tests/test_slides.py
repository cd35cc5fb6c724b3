import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions import strings as S
from tessera.operators import layout as L
from tessera.operators import pixels as P
from tessera.operators import specimens
from tessera.errors import AnnotationError, FrameTableError, NotASlide
from tessera.sources import annotations as A
from tessera.sources import dicom
from tessera.sources.sinks import NotEmpty, prepare_folder


def row(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


@pytest.mark.parametrize(("region", "expected"), [((0, 0, 100, 100), (100, 100)), ((0, 0, 2000, 2000), (154, 290)), ((200, 300, 100, 100), (0, 0))])
def test_crop_to_level(spark, region, expected):
    x, y, w, h = map(F.lit, region)
    got = row(spark, G.crop(F.lit(0), F.lit(154), x, w)[1], G.crop(F.lit(0), F.lit(290), y, h)[1])
    assert tuple(got) == expected


@pytest.mark.parametrize(("tile", "region", "expected"), [((0, 0), (0, 0, 100, 100), (0, 0, 100, 100)), ((0, 0), (0, 0, 1500, 1500), (0, 0, 1024, 1024)), ((1, 1), (1200, 1200, 300, 300), (176, 176, 300, 300))])
def test_inside_crop(spark, tile, region, expected):
    x, w = G.inside_crop(F.lit(tile[0]), F.lit(1024), F.lit(region[0]), F.lit(region[2]))
    y, h = G.inside_crop(F.lit(tile[1]), F.lit(1024), F.lit(region[1]), F.lit(region[3]))
    assert tuple(row(spark, x, y, w, h)) == expected


def test_levels(spark):
    got = row(spark, G.level_index(F.lit(0.002), F.lit(0.00025)), G.level_index(F.lit(0.0011), F.lit(0.00025)), G.highest_level(F.lit(1024), F.lit(300)), G.single_tile_level(F.lit(1025), F.lit(10), F.lit(256), F.lit(256)), G.mm_to_pixel(F.lit(1.0), F.lit(0.1242353)))
    assert tuple(got) == (3, None, 10, 3, 8)


def test_truncation_and_rounding(spark):
    assert tuple(row(spark, G.truncate(F.lit(-3.7)), G.truncate(F.lit(3.7)), G.half_even(F.lit(2.5)), G.half_even(F.lit(3.5)))) == (-3, 3, 2, 4)


@pytest.mark.parametrize("degrees", [0, 90, 180, 270])
def test_coordinates_come_back(spark, degrees):
    x, y = G.image_to_slide(F.lit(3.0), F.lit(4.0), F.lit(10.0), F.lit(20.0), F.lit(degrees))
    u, v = G.slide_to_image(x, y, F.lit(10.0), F.lit(20.0), F.lit(degrees))
    assert tuple(row(spark, F.round(u, 9), F.round(v, 9))) == (3.0, 4.0)


def test_halve_rounds_half_up_on_every_tie():
    for total in range(2, 1020, 4):
        a = np.array([[total // 4, total // 4], [total - 3 * (total // 4) - 0, total // 4]], np.int64)
        assert P.halve(a)[0, 0] == (a.sum() + 2) // 4
    assert P.halve(np.array([[1, 2, 7]], np.uint8)).tolist() == [[2, 7]]


@pytest.mark.parametrize("name", list(P.SUPPORT))
def test_resample(name):
    flat = np.full((9, 7), 77, np.uint8)
    assert (P.resample(flat, 4, 3, name) == 77).all()
    a = np.random.default_rng(0).integers(0, 256, (8, 8)).astype(np.uint8)
    assert np.array_equal(P.resample(a, 8, 8, name), a)
    assert P.resample(a, 3, 5, name).shape == (3, 5)


def test_box_resample_is_halving():
    a = np.random.default_rng(1).integers(0, 256, (8, 8)).astype(np.uint8)
    assert np.array_equal(P.resample(a, 4, 4, "box"), P.halve(a))


@pytest.mark.parametrize("shape", [(5, 7), (4, 4, 3), (1, 300)])
@pytest.mark.parametrize("dtype", ["uint8", "uint16"])
def test_rle_round_trip(shape, dtype):
    rng = np.random.default_rng(3)
    for a in (rng.integers(0, np.iinfo(dtype).max, shape).astype(dtype), np.zeros(shape, dtype), rng.integers(0, 2, shape).astype(dtype)):
        data = P.rle_encode(a)
        assert len(data) % 2 == 0
        assert np.array_equal(P.rle_decode(data, shape[0], shape[1], shape[2] if len(shape) == 3 else 1, dtype), a)


HEADER = {"SOPInstanceUID": "1.2.3.4", "StudyInstanceUID": "1.2", "ImageType": ["ORIGINAL", "PRIMARY", "VOLUME"], "Rows": 4, "Columns": 4, "SamplesPerPixel": 1, "BitsAllocated": 8, "BitsStored": 8, "NumberOfFrames": 3, "PixelSpacing": [0.5, 0.25], "TotalPixelMatrixColumns": 9}


@pytest.mark.parametrize("undefined", [False, True])
@pytest.mark.parametrize(("syntax", "table", "kind"), [(dicom.EXPLICIT, "basic", "native"), (dicom.IMPLICIT, "basic", "native"), (dicom.RLE, "basic", "basic"), (dicom.RLE, "extended", "extended"), (dicom.RLE, "empty", "items"), (dicom.RLE, "tiff", "tiff")])
def test_file_round_trip(tmp_path, syntax, table, kind, undefined):
    tiles = [np.full((4, 4), k, np.uint8) for k in range(3)]
    data = [P.rle_encode(t) if syntax == dicom.RLE else t.tobytes() for t in tiles]
    path = str(tmp_path / "a.dcm")
    groups = [{"PixelMeasuresSequence": [{"SpacingBetweenSlices": 0.5}, {}]}]
    dicom.write_file(path, HEADER | {"SharedFunctionalGroupsSequence": groups}, data, syntax, table, undefined)
    with open(path, "rb") as f:
        h = dicom.read_header(f)
        assert h.values["Rows"] == 4 and h.values["PixelSpacing"] == [0.5, 0.25] and h.values["ImageType"][2] == "VOLUME" and h.values["SharedFunctionalGroupsSequence"] == groups
        found, index = dicom.frame_index(f, h)
        assert found == kind
        got = []
        for at, n in index:
            f.seek(at)
            got.append(f.read(n))
    assert got == data


@pytest.mark.parametrize("table", ["basic", "extended", "empty"])
def test_wrong_frame_counts_are_errors(tmp_path, table):
    path = str(tmp_path / "a.dcm")
    dicom.write_file(path, HEADER | {"NumberOfFrames": 2}, [b"ab"] * 2, dicom.RLE, table)
    raw = open(path, "rb").read()
    for n in (b"1 ", b"5 "):
        with pytest.raises(FrameTableError):
            wrong = io.BytesIO(raw.replace(b"(\0\x08\0IS\x02\x002 ", b"(\0\x08\0IS\x02\0" + n))
            dicom.frame_index(wrong, dicom.read_header(wrong))


def test_writer_keeps_to_its_header(tmp_path):
    with pytest.raises(FrameTableError):
        dicom.write_file(str(tmp_path / "a"), HEADER, [b"\0" * 16] * 2)
    with pytest.raises(FrameTableError):
        dicom.write_file(str(tmp_path / "b"), HEADER, [b"\0" * 15] * 3)


def test_places_of_frames():
    """Column by column within planes and paths as declared, or as the frames say."""
    full = dicom.Header({"Rows": 4, "Columns": 4, "TotalPixelMatrixColumns": 9, "TotalPixelMatrixRows": 4, "TotalPixelMatrixFocalPlanes": 2, "DimensionOrganizationType": "TILED_FULL", "SharedFunctionalGroupsSequence": [{"PixelMeasuresSequence": [{"SpacingBetweenSlices": 0.0015}]}], "OpticalPathSequence": [{"OpticalPathIdentifier": "a"}, {"OpticalPathIdentifier": "b"}]})
    assert list(dicom.places(full, range(12)))[2:8] == [(2, 0, 0.0, "a"), (0, 0, 1.5, "a"), (1, 0, 1.5, "a"), (2, 0, 1.5, "a"), (0, 0, 0.0, "b"), (1, 0, 0.0, "b")]
    place = {"PlanePositionSlideSequence": [{"ColumnPositionInTotalImagePixelMatrix": 9, "RowPositionInTotalImagePixelMatrix": 5, "ZOffsetInSlideCoordinateSystem": 2.0}], "OpticalPathIdentificationSequence": [{"OpticalPathIdentifier": "b"}]}
    assert list(dicom.places(dicom.Header({"Rows": 4, "Columns": 4, "PerFrameFunctionalGroupsSequence": [place]}), range(1))) == [(2, 1, 2.0, "b")]


def test_other_files_are_left_out(spark, tmp_path):
    (tmp_path / "x.txt").write_text("not a slide")
    (tmp_path / "empty").write_bytes(b"")
    dicom.write_file(str(tmp_path / "a.dcm"), HEADER, [b"\0" * 16] * 3)
    dicom.write_file(str(tmp_path / "b.dcm"), HEADER | {"SOPClassUID": "1.2.3"}, [b"\0" * 16] * 3)
    dicom.write_dataset(str(tmp_path / "no-pixels.dcm"), HEADER | {"SOPClassUID": dicom.SLIDE_CLASS, "SOPInstanceUID": "9"})
    (tmp_path / "cut.dcm").write_bytes((tmp_path / "a.dcm").read_bytes()[:400])
    (tmp_path / "folder").mkdir()
    dicom.register(spark)
    rows = spark.read.format("dicomslides").load(str(tmp_path)).where("frame_table is not null").collect()
    assert [(r.uid, r.image_type, r.n_frames, r.spacing_x, r.spacing_y) for r in rows] == [("1.2.3.4", "VOLUME", 3, 0.25, 0.5)]
    assert spark.read.format("dicomframes").load(str(tmp_path)).count() == 3
    assert spark.read.format("dicomslides").option("classes", "1.2.3").load(str(tmp_path)).count() == 1
    with pytest.raises(NotEmpty):
        prepare_folder(str(tmp_path))
    assert prepare_folder(str(tmp_path / "new" / "one"))


def test_streams_of_a_store(spark, tmp_path):
    """An address with a scheme is opened by Arrow's file systems."""
    dicom.write_file(str(tmp_path / "a.dcm"), HEADER, [bytes([k]) * 16 for k in range(3)])
    with dicom.open_stream(f"file://{tmp_path}/a.dcm") as f:
        assert dicom.read_header(f).values["Rows"] == 4
    from pyarrow import fs

    found, inside = fs.FileSystem.from_uri(f"file://{tmp_path}/a.dcm")
    with found.open_input_file(inside) as f:
        h = dicom.read_header(f)
        at, n = dicom.frame_index(f, h)[1][2]
        f.seek(at)
        assert f.read(n) == b"\2" * 16


@pytest.mark.parametrize("double", [True, False])
def test_annotation_groups(double):
    points = [np.arange(2 * n, dtype=float).reshape(n, 2) + n for n in (3, 5, 4)]
    found = {("area", "mm2"): {0: 1.5, 2: 2.5}, ("length", "mm"): {0: 1.0, 1: 2.0, 2: 3.0}}
    g = A.encode_group("POLYGON", points, found, double)
    assert g["LongPrimitivePointIndexList"] == [1, 7, 17] and "AnnotationIndexList" not in g["MeasurementsSequence"][1]["MeasurementValuesSequence"][0]
    got, m = A.decode_group(g)
    assert all(np.array_equal(a, b) for a, b in zip(got, points, strict=True)) and m == [[("area", "mm2", 1.5), ("length", "mm", 1.0)], [("length", "mm", 2.0)], [("area", "mm2", 2.5), ("length", "mm", 3.0)]]
    for wrong in ({"LongPrimitivePointIndexList": [1, 7]}, {"LongPrimitivePointIndexList": [1, 8, 17]}, {"LongPrimitivePointIndexList": [3, 7, 17]}, {"MeasurementsSequence": [{"MeasurementValuesSequence": [{"FloatingPointValues": [1.0]}]}]}):
        with pytest.raises(AnnotationError):
            A.decode_group(g | wrong)
    for graphic, where in (("STAR", points), ("POINT", points), ("POLYGON", [points[0], np.zeros((3, 3))])):
        with pytest.raises(AnnotationError):
            A.encode_group(graphic, where)


def test_no_preamble():
    with pytest.raises(NotASlide):
        dicom.read_header(io.BytesIO(b"x" * 200))


@pytest.mark.parametrize(("text", "expected"), [("100MB", 100 << 20), ("2G", 2 << 30), (" 7 kb ", 7 << 10), ("512", 512), ("x", None), ("5 parsec", None)])
def test_sizes(spark, text, expected):
    assert row(spark, L.parse_size(F.lit(text)))[0] == expected


@pytest.mark.parametrize(("text", "expected"), [("20240229", "2024-02-29 00:00:00"), ("2024", "2024-01-01 00:00:00"), ("202402291530", "2024-02-29 15:30:00"), ("20240229153000.5", "2024-02-29 15:30:00.5"), ("20230229", None), ("abc", None), ("", None)])
def test_date_times(spark, text, expected):
    assert row(spark, S.date_time(F.lit(text)).cast("string"))[0] == expected


@pytest.mark.parametrize(("text", "expected"), [("Ab-c1", "AB_C1"), ("  x  ", "X"), ("é", "_")])
def test_code_strings(spark, text, expected):
    assert row(spark, S.code_string(F.lit(text)))[0] == expected


def test_byte_split_takes_one_frame_at_least(spark):
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate([10, 500, 10, 10, 80, 2])], "identifier long, frame_index long, byte_len long")
    got = sorted((r.frame_index, r.part) for r in L.split_by_bytes(df, 100).collect())
    assert got == [(0, 0), (1, 1), (2, 2), (3, 2), (4, 3), (5, 3)] or got == [(0, 0), (1, 1), (2, 2), (3, 2), (4, 3), (5, 3)]


def test_specimen_cycles_end(spark):
    with pytest.raises(ValueError, match="cycle"):
        specimens.ancestors(spark.createDataFrame([("a", "b"), ("b", "a")], "child string, parent string"), most=5)
