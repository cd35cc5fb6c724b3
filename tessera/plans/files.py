"""Queries that write slide files and read them back."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera import tables
from tessera.errors import FrameTableError, NotASlide
from tessera.operators import pixels as P
from tessera.plans.fixtures import fx
from tessera.plans.pixels import packed
from tessera.plans.registry import query
from tessera.sources import annotations as A
from tessera.sources import dicom
from tessera.sources.plugin import ArraySlides
from tessera.sources.sinks import NotEmpty, prepare_folder, save_slides


def _folder(spark) -> str:
    """A new folder in the one that all executors share."""
    top = tables.shared_folder(spark)
    top = "/" + top.removeprefix("file:").lstrip("/") if top.startswith("file:") else top
    return os.path.join(top, f"slides-{uuid.uuid4().hex}")


def _slides(spark, sf, each=None):
    """Frames of the fixture; each: what becomes of a frame's bytes, in the step that makes them."""
    return packed(spark, sf, each).select((F.col("vec_id") % 7).alias("slide"), F.floor(F.col("vec_id") / 7).alias("frame_index"), F.lit(10).alias("tiles_x"), "data")


def _saved(spark, sf, frames, **options) -> str:
    folder = _folder(spark)
    save_slides(frames, folder, tile=8, columns="tiles_x", **options).count()
    dicom.register(spark)
    return folder


_TOTALS = "SELECT '1.2.3.' || CAST(vec_id % 7 AS VARCHAR) AS identifier, CAST(floor(vec_id / 7) AS BIGINT) AS frame_index, CAST(sum(v) AS BIGINT) AS total FROM fx_pixel GROUP BY vec_id"


def _totals(frames, decode=None):
    """(identifier, frame_index, total): sum of the pixels of each frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(np.frombuffer(decode(d) if decode else d, np.uint8).sum()) for d in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums, pa.int64())], names=["identifier", "frame_index", "total"])

    return frames.select("identifier", "frame_index", "data").mapInArrow(run, "identifier string, frame_index long, total long")


_GRID = "CAST(ceil(count(*) / 10) * 8 AS BIGINT)"


@query("src01_open_headers", f"""SELECT '1.2.3.' || CAST(vec_id % 7 AS VARCHAR) AS uid, 'VOLUME' AS image_type, count(*) AS n_frames, CAST(80 AS BIGINT) AS total_columns, {_GRID} AS total_rows, 0.00025E0 AS spacing_x, 10.0E0 AS origin_x, true AS per_frame, 'native' AS frame_table
FROM embeddings GROUP BY vec_id % 7""")
def open_headers(spark, sf):
    """Headers of files whose frames say their places, in sequences without a length."""
    rows = _slides(spark, sf).withColumns({"tile_x": F.col("frame_index") % 10, "tile_y": F.floor(F.col("frame_index") / 10)})
    read = spark.read.format("dicomslides").load(_saved(spark, sf, rows, sparse=True, undefined=True))
    return read.select("uid", "image_type", "n_frames", "total_columns", "total_rows", "spacing_x", "origin_x", "per_frame", "frame_table")


@query("src12_native_frames", _TOTALS)
def native_frames(spark, sf):
    return _totals(spark.read.format("dicomframes").load(_saved(spark, sf, _slides(spark, sf))))


_PLACES = "SELECT '1.2.3.' || CAST(vec_id % 7 AS VARCHAR) AS identifier, CAST(floor(vec_id / 7) AS BIGINT) AS frame_index, {x} AS tile_x, {y} AS tile_y FROM embeddings"


@query("src12_frame_places", _PLACES.format(x="9 - CAST(floor(vec_id / 7) AS BIGINT) % 10", y="CAST(floor(floor(vec_id / 7) / 10) AS BIGINT)"))
def frame_places(spark, sf):
    """Frames in an order of their own: their places come from the header, in ranges of frames read by several tasks, without their bytes."""
    rows = _slides(spark, sf).withColumns({"tile_x": 9 - F.col("frame_index") % 10, "tile_y": F.floor(F.col("frame_index") / 10)})
    read = spark.read.format("dicomframes").option("splitbytes", "4096").option("data", "false").load(_saved(spark, sf, rows, sparse=True))
    return read.select("identifier", "frame_index", "tile_x", "tile_y")


def _encapsulated(spark, sf, table: str):
    frames = P.apply_to_tiles(_slides(spark, sf), lambda a: np.frombuffer(P.rle_encode(a), np.uint8), (8, 8))
    read = spark.read.format("dicomframes").load(_saved(spark, sf, frames, syntax=dicom.RLE, table=table))
    return _totals(read, lambda d: P.rle_decode(d, 8, 8, 1, "uint8").tobytes())


@query("src15_basic_table_frames", _TOTALS)
def basic_table_frames(spark, sf):
    return _encapsulated(spark, sf, "basic")


@query("src16_extended_table_frames", _TOTALS)
def extended_table_frames(spark, sf):
    return _encapsulated(spark, sf, "extended")


@query("src17_item_walk_frames", _TOTALS)
def item_walk_frames(spark, sf):
    return _encapsulated(spark, sf, "empty")


@query("src18_tiff_table_frames", _TOTALS)
def tiff_table_frames(spark, sf):
    """Files that are TIFF files as well: the frames are found by the tags of the TIFF directory."""
    return _encapsulated(spark, sf, "tiff")


@query("src19_tables_in_use", "SELECT k AS frame_table, count(DISTINCT vec_id % 7) AS files FROM embeddings, (SELECT unnest(['native', 'extended', 'basic', 'tiff', 'items']) AS k) GROUP BY k")
def tables_in_use(spark, sf):
    """Which way the frames of a file are found, of five ways to write them."""
    frames = P.apply_to_tiles(_slides(spark, sf), lambda a: np.frombuffer(P.rle_encode(a), np.uint8), (8, 8))
    paths = [_saved(spark, sf, _slides(spark, sf))] + [_saved(spark, sf, frames, syntax=dicom.RLE, table=t) for t in ("extended", "basic", "tiff", "empty")]
    read = [spark.read.format("dicomslides").load(p) for p in paths]
    out = read[0]
    for r in read[1:]:
        out = out.unionByName(r)
    return out.groupBy("frame_table").agg(F.count("*").alias("files"))


@query("src20_frame_faults", """SELECT 'table' || CAST(k AS VARCHAR) AS name, k NOT IN (2, 5) AS fault FROM (SELECT unnest(generate_series(0, 5)) AS k)""")
def frame_faults(spark, sf):
    """Files whose tables contradict their headers: too few frames, too many, odd lengths, an offset that begins late."""
    folder = prepare_folder(_folder(spark))
    header = {"SOPInstanceUID": "1.2", "StudyInstanceUID": "1", "Rows": 8, "Columns": 8, "SamplesPerPixel": 1, "BitsAllocated": 8}
    for k, (n, table) in enumerate(((3, "empty"), (5, "empty"), (4, "empty"), (3, "basic"), (4, "basic"), (4, "extended"))):
        path = os.path.join(folder, f"table{k}")
        dicom.write_file(path, header, [b"ab"] * 4, dicom.RLE, table)
        with open(path, "r+b") as f:
            raw = f.read()
            if n != 4:  # the header says another number
                raw = raw.replace(b"(\0\x08\0IS\x02\0" + b"4 ", b"(\0\x08\0IS\x02\0" + f"{n} ".encode())
            if k == 4:  # the table begins at 2
                at = raw.index(b"\xfe\xff\0\xe0\x10\0\0\0") + 8
                raw = raw[:at] + b"\x02" + raw[at + 1 :]
            f.seek(0)
            f.write(raw)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            faults = []
            for name in batch.column(0).to_pylist():
                with dicom.open_stream(os.path.join(folder, name)) as f:
                    try:
                        dicom.frame_index(f, dicom.read_header(f))
                        faults.append(False)
                    except (FrameTableError, NotASlide):
                        faults.append(True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(faults)], names=["name", "fault"])

    return spark.range(6).select(F.concat(F.lit("table"), F.col("id").cast("string")).alias("name")).mapInArrow(check, "name string, fault boolean")


@query("src06_manifest", "SELECT '1.2.3.' || CAST(vec_id % 7 AS VARCHAR) AS uid, count(*) AS n_frames FROM embeddings WHERE vec_id % 7 < 4 GROUP BY vec_id % 7")
def manifest(spark, sf):
    """The slides that a manifest names: those of the slide class, of the files of its folder."""
    top = _saved(spark, sf, _slides(spark, sf))
    dicom.write_manifest(f"{top}/DICOMDIR", [(f"{k}.dcm", dicom.SLIDE_CLASS if k < 4 else "1.2.3") for k in range(5)])
    return spark.read.format("dicomslides").load(f"{top}/DICOMDIR").select("uid", "n_frames")


@query("snk01_save_and_read", "SELECT '1.2.3.' || CAST(vec_id % 7 AS VARCHAR) AS identifier, count(*) AS frames, CAST(sum(n) AS BIGINT) AS bytes FROM (SELECT vec_id, count(*) AS n FROM fx_pixel GROUP BY vec_id) GROUP BY 1")
def save_and_read(spark, sf):
    frames = spark.read.format("dicomframes").load(_saved(spark, sf, _slides(spark, sf)))
    return frames.groupBy("identifier").agg(F.count("*").alias("frames"), F.sum("byte_length").alias("bytes"))


@query("snk01_save_colour", "SELECT '1.2.3.' || CAST(vec_id % 7 AS VARCHAR) AS identifier, count(*) AS frames, CAST(sum(t) AS BIGINT) AS total, 'RGB' AS photometric, CAST(16 AS INT) AS bits FROM (SELECT vec_id, sum(v) AS t FROM fx_pixel GROUP BY vec_id) GROUP BY 1")
def save_colour(spark, sf):
    """Frames of 8x8 bytes as 4x4 pixels of three samples, and as 16-bit ones: the same bytes, other headers."""
    colour = _slides(spark, sf).withColumn("data", F.substring("data", 1, 48))
    rest = _slides(spark, sf).withColumn("data", F.substring("data", 49, 16).cast("binary"))
    wide = _folder(spark)
    save_slides(rest.withColumn("data", F.concat("data", F.lit(bytearray(16)))), wide, tile=4, columns="tiles_x", bits=16).count()
    folder = _folder(spark)
    save_slides(colour, folder, tile=4, columns="tiles_x", samples=3, photometric="RGB", kind="VOLUME").count()
    dicom.register(spark)
    both = [_totals(spark.read.format("dicomframes").load(p)) for p in (folder, wide)]
    sums = both[0].unionByName(both[1]).groupBy("identifier").agg(F.count_distinct("frame_index").alias("frames"), F.sum("total").alias("total"))
    heads = spark.read.format("dicomslides").load(folder).select(F.col("uid").alias("identifier"), "photometric")
    bits = spark.read.format("dicomslides").load(wide).select(F.col("uid").alias("identifier"), "bits")
    return sums.join(heads, "identifier").join(bits, "identifier")


@query("snk13_part_files", """SELECT '1.2.3.' || CAST(s AS VARCHAR) || '.0' AS concat_uid, '1.2.3.' || CAST(s AS VARCHAR) || '.9' AS concat_source, CAST(p + 1 AS INT) AS concat_number, p * 16 AS concat_offset, count(*) AS n_frames
FROM (SELECT vec_id % 7 AS s, CAST(floor(floor(vec_id / 7) / 16) AS BIGINT) AS p FROM embeddings) GROUP BY s, p""")
def part_files(spark, sf):
    """A slide in parts of 16 frames: one concatenation, its files numbered, each saying where its frames begin."""
    return spark.read.format("dicomslides").load(_saved(spark, sf, _slides(spark, sf), per_part=16)).select("concat_uid", "concat_source", "concat_number", "concat_offset", "n_frames")


@query("jn02_frame_to_file", _PLACES.replace("AS VARCHAR) AS", "AS VARCHAR) || '.0' AS").format(x="CAST(floor(vec_id / 7) AS BIGINT) % 10", y="CAST(floor(floor(vec_id / 7) / 10) AS BIGINT)"))
def frame_to_file(spark, sf):
    """Frames of a slide in parts, numbered over all of them, with the places that follow."""
    return spark.read.format("dicomframes").load(_saved(spark, sf, _slides(spark, sf), per_part=16)).select("identifier", "frame_index", "tile_x", "tile_y")


@query("snk17_native_padding", "SELECT CAST(n AS INT) AS n, CAST(n * 9 + n * 9 % 2 AS BIGINT) AS length FROM (SELECT unnest([1, 2, 3, 4]) AS n)")
def native_padding(spark, sf):
    """Native pixels have an even length, whatever the frames'."""
    folder = prepare_folder(_folder(spark))
    rows = []
    for n in (1, 2, 3, 4):
        dicom.write_file(f"{folder}/{n}", {"SOPInstanceUID": "1", "Rows": 3, "Columns": 3, "SamplesPerPixel": 1, "BitsAllocated": 8}, [b"x" * 9] * n)
        with dicom.open_stream(f"{folder}/{n}") as f:
            rows.append((n, dicom.read_header(f).pixels_length))
    return spark.createDataFrame(rows, "n int, length long")


@query("snk25_dataset_forms", "SELECT k AS form, true AS same FROM (SELECT unnest(['implicit', 'undefined', 'implicit undefined', 'explicit']) AS k)")
def dataset_forms(spark, sf):
    """Datasets written with and without value representations, with and without lengths of sequences: read again they are the same."""
    folder = prepare_folder(_folder(spark))
    out = []
    for k, (name, syntax, undefined) in enumerate((("implicit", dicom.IMPLICIT, False), ("undefined", dicom.EXPLICIT, True), ("implicit undefined", dicom.IMPLICIT, True), ("explicit", dicom.EXPLICIT, False))):
        values = {"SOPClassUID": dicom.SLIDE_CLASS, "SOPInstanceUID": "1.2", "Rows": 7, "PixelSpacing": [0.5, 0.25], "SharedFunctionalGroupsSequence": [{"PixelMeasuresSequence": [{"SliceThickness": 0.001}, {}]}], "FrameOfReferenceUID": "1.2.33"}
        dicom.write_dataset(f"{folder}/{k}", values, syntax, undefined)
        with dicom.open_stream(f"{folder}/{k}") as f:
            got = dicom.read_header(f)
        out.append((name, got.values == values and got.syntax == syntax))
    return spark.createDataFrame(out, "form string, same boolean")


@query("snk02_output_folder", "SELECT * FROM (VALUES ('new', false), ('empty', false), ('full', true)) v(folder, refused)")
def output_folder(spark, sf):
    """A folder is made if it isn't there; one that has files is refused."""
    new = _folder(spark)
    out = []
    for name, path in (("new", new), ("empty", new), ("full", new)):
        if name == "full":
            dicom.write_manifest(f"{new}/DICOMDIR", [])
        try:
            prepare_folder(path)
            out.append((name, False))
        except NotEmpty:
            out.append((name, True))
    return spark.createDataFrame(out, "folder string, refused boolean")


@query("src02_path_resolution", "SELECT CAST(7 AS BIGINT) AS folder, CAST(1 AS BIGINT) AS one, CAST(7 AS BIGINT) AS pattern")
def path_resolution(spark, sf):
    """The same slides by folder, by file and by pattern."""
    top = _saved(spark, sf, _slides(spark, sf))
    counts = [spark.read.format("dicomslides").load(p).agg(F.count("*").alias(n)) for n, p in (("folder", top), ("one", f"{top}/3.dcm"), ("pattern", f"{top}/*.dcm"))]
    return counts[0].crossJoin(F.broadcast(counts[1])).crossJoin(F.broadcast(counts[2]))  # one row each


@query("src05_header_only", "SELECT count(*) AS files, CAST(8 AS INT) AS tile_rows FROM (SELECT DISTINCT vec_id % 7 FROM embeddings)")
def header_only(spark, sf):
    """Headers without frames: the source stops before the pixels."""
    return spark.read.format("dicomslides").load(_saved(spark, sf, _slides(spark, sf))).groupBy("tile_rows").agg(F.count("*").alias("files")).select("files", "tile_rows")


def _array_files(spark, sf) -> str:
    """Each seventh of the vectors as one array file, ten tiles of 8 x 8 wide."""
    folder = prepare_folder(_folder(spark))

    def write(frame):
        import pandas as pd

        slide = int(frame["slide"].iloc[0])
        image = np.zeros((-(-len(frame) // 10) * 8, 80), np.uint8)
        for k, d in zip(frame["frame_index"], frame["data"], strict=True):
            image[k // 10 * 8 : k // 10 * 8 + 8, k % 10 * 8 : k % 10 * 8 + 8] = np.frombuffer(d, np.uint8).reshape(8, 8)
        np.save(f"{folder}/{slide}.npy", image)
        return pd.DataFrame({"slide": [slide]})

    _slides(spark, sf).groupBy("slide").applyInPandas(write, "slide long").count()
    spark.dataSource.register(ArraySlides)
    return folder


@query("src21_array_source", f"SELECT CAST(vec_id % 7 AS VARCHAR) AS identifier, CAST(80 AS BIGINT) AS width, {_GRID} AS height, CAST(1 AS BIGINT) AS tiles, CAST(sum(t) AS BIGINT) AS total FROM (SELECT vec_id, sum(v) AS t FROM fx_pixel GROUP BY vec_id) GROUP BY vec_id % 7")
def array_source(spark, sf):
    """Array files as instances of one tile: the tile is as large as the image."""
    rows = spark.read.format("arrayslides").load(_array_files(spark, sf))
    sums = _totals(rows.select("identifier", F.col("tile_y").alias("frame_index"), "data"))
    return rows.groupBy("identifier", "width", "height").agg(F.count("*").alias("tiles")).join(sums.select("identifier", "total"), "identifier")


@query("src22_pluggable_source", "SELECT CAST(vec_id % 7 AS VARCHAR) AS identifier, CAST(floor(vec_id / 7) AS BIGINT) % 10 AS tile_x, CAST(floor(floor(vec_id / 7) / 10) AS BIGINT) AS tile_y, CAST(sum(v) AS BIGINT) AS total FROM fx_pixel GROUP BY ALL HAVING sum(v) > 0")
def pluggable_source(spark, sf):
    """Tiles of a format that isn't DICOM, by a source that is plugged in."""
    rows = spark.read.format("arrayslides").option("tile", "8").load(_array_files(spark, sf))
    sums = _totals(rows.select(F.concat_ws("/", "identifier", "tile_x").alias("identifier"), F.col("tile_y").alias("frame_index"), "data")).where("total > 0")
    parts = F.split("identifier", "/")
    return sums.select(F.get(parts, 0).alias("identifier"), F.get(parts, 1).cast("bigint").alias("tile_x"), F.col("frame_index").alias("tile_y"), "total")


_GRAPHIC = "CASE group_id % 3 WHEN 0 THEN 'POINT' WHEN 1 THEN 'POLYLINE' ELSE 'POLYGON' END"


def _drawn(spark, sf):
    """Annotations of the fixture, ten groups in five files, with the measurements of some."""
    points = fx(spark, sf, "fx_vertex").groupBy("annotation_id", "group_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "x", "y"))).alias("v"))
    graphic = F.when(F.col("group_id") % 3 == 0, "POINT").when(F.col("group_id") % 3 == 1, "POLYLINE").otherwise("POLYGON")
    places = F.transform("v", lambda p: F.array(p["x"], p["y"]))
    found = fx(spark, sf, "fx_measurement").groupBy("annotation_id", "code").agg(F.min_by("value", "ordinal").alias("value")).groupBy("annotation_id").agg(F.collect_list(F.struct("code", F.lit("um").alias("unit"), "value")).alias("measurements"))
    rows = points.join(found, "annotation_id", "left")
    return rows.select((F.col("group_id") % 5).alias("file"), "group_id", graphic.alias("graphic"), F.concat(F.lit("group "), F.col("group_id").cast("string")).alias("label"), "annotation_id", F.when(graphic == "POINT", F.slice(places, 1, 1)).otherwise(places).alias("points"), "measurements")


def _annotations(spark, sf, **options):
    folder = _folder(spark)
    A.save_annotations(_drawn(spark, sf), folder, **options).count()
    A.register(spark)
    return spark.read.format("dicomannotations").load(folder)


@query("ann02_decode_points", f"""SELECT CAST(group_id AS VARCHAR) AS grp, kind AS graphic, row_number() OVER (PARTITION BY group_id ORDER BY annotation_id) - 1 AS annotation_index, n_points, x, y FROM (SELECT annotation_id, group_id, {_GRAPHIC} AS kind, CASE WHEN group_id % 3 = 0 THEN 1 ELSE count(*) END AS n_points,
  CASE WHEN group_id % 3 = 0 THEN arg_min(x, ordinal) ELSE arg_max(x, ordinal) END AS x, CASE WHEN group_id % 3 = 0 THEN arg_min(y, ordinal) ELSE arg_max(y, ordinal) END AS y FROM fx_vertex GROUP BY annotation_id, group_id)""")
def decode_points(spark, sf):
    """Annotations of files: kind, number of points and the last one, as written in double precision."""
    rows = _annotations(spark, sf)
    last = F.element_at("points", -1)
    return rows.select(F.element_at(F.split("group_uid", r"\."), -1).alias("grp"), "graphic", "annotation_index", F.size("points").cast("bigint").alias("n_points"), F.element_at(last, 1).alias("x"), F.element_at(last, 2).alias("y"))


@query("ann04_encode_measurements", f"SELECT group_id % 5 AS file, code, 'um' AS unit, count(*) AS n, round(sum(CAST(CAST(value AS FLOAT) AS DOUBLE)), 3) AS total FROM (SELECT m.annotation_id, m.code, arg_min(m.value, m.ordinal) AS value FROM fx_measurement m GROUP BY 1, 2) m JOIN (SELECT DISTINCT annotation_id, group_id FROM fx_vertex) v USING (annotation_id) GROUP BY ALL")
def encode_measurements(spark, sf):
    """Measurements by code and unit, which the files hold as one list each, with indices where some annotations have none."""
    rows = _annotations(spark, sf).select(F.element_at(F.split("series_uid", r"\."), -1).cast("bigint").alias("file"), F.explode("measurements").alias("m"))
    return rows.groupBy("file", F.col("m.code").alias("code"), F.col("m.unit").alias("unit")).agg(F.count("*").alias("n"), F.round(F.sum("m.value"), 3).alias("total"))


@query("ann06_group_kinds", f"SELECT graphic, count(*) AS groups, CAST(sum(n) AS BIGINT) AS annotations FROM (SELECT group_id, {_GRAPHIC} AS graphic, count(DISTINCT annotation_id) AS n FROM fx_vertex GROUP BY group_id) GROUP BY graphic")
def group_kinds(spark, sf):
    rows = _annotations(spark, sf).groupBy("graphic", "group_uid").agg(F.count("*").alias("n"))
    return rows.groupBy("graphic").agg(F.count("*").alias("groups"), F.sum("n").alias("annotations"))


@query("snk23_save_annotations", f"SELECT label, round(sum(CAST(CAST(x AS FLOAT) AS DOUBLE)), 2) AS x, count(DISTINCT annotation_id) AS n FROM (SELECT *, 'group ' || CAST(group_id AS VARCHAR) AS label FROM fx_vertex WHERE group_id % 3 > 0 OR ordinal = 0) GROUP BY label")
def save_and_read_annotations(spark, sf):
    """Annotations in single precision and without value representations, read again."""
    rows = _annotations(spark, sf, double=False, syntax=dicom.IMPLICIT)
    points = rows.select("label", "annotation_index", F.explode("points").alias("p"))
    return points.groupBy("label").agg(F.round(F.sum(F.element_at("p", 1)), 2).alias("x"), F.count_distinct("annotation_index").alias("n"))


@query("src24_annotation_scan", "SELECT kind, count(*) AS files FROM (SELECT unnest(['image', 'volume']) AS kind), (SELECT DISTINCT group_id % 5 FROM fx_vertex) GROUP BY kind")
def annotation_scan(spark, sf):
    """A folder with annotation files of images and of the slide, and with other files: class and modality tell."""
    folder = _folder(spark)
    A.save_annotations(_drawn(spark, sf), folder).count()
    flat = _drawn(spark, sf).withColumn("points", F.transform("points", lambda p: F.concat(p, F.array(F.lit(0.0)))))
    volume = _folder(spark)
    A.save_annotations(flat, volume, volume=True).count()
    for n in os.listdir(volume):
        os.replace(f"{volume}/{n}", f"{folder}/v{n}")
    base = {"SOPInstanceUID": "1", "SeriesInstanceUID": "9.9", "Modality": "ANN", "AnnotationCoordinateType": "3D", "AnnotationGroupSequence": [A.encode_group("POINT", [np.zeros((1, 3))])]}
    dicom.write_dataset(f"{folder}/no-frame", base | {"SOPClassUID": A.ANNOTATION_CLASS})
    dicom.write_dataset(f"{folder}/other", base | {"SOPClassUID": "1.2.3", "FrameOfReferenceUID": "1"})
    A.register(spark)
    return spark.read.format("dicomannotations").load(folder).select("path", F.col("kind_of_origin").alias("kind")).distinct().groupBy("kind").agg(F.count("*").alias("files"))
