"""Queries that encode, store, read and decode frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera import tables
from tessera.operators import codecs as C
from tessera.operators import pixels as P
from tessera.plans.files import _folder, _slides
from tessera.plans.fixtures import fx
from tessera.plans.registry import query
from tessera.sources import dicom
from tessera.sources.sinks import save_slides

_LOSSLESS = {"native": C.EXPLICIT, "implicit": C.IMPLICIT, "rle": C.RLE, "jpeg_lossless": C.JPEG_LOSSLESS_FIRST, "jpeg_ls": C.JPEG_LS}
_IDENTIFIER = "'1.2.3.' || CAST(vec_id % 7 AS VARCHAR)"


def _stored(spark, sf, syntax: str, **options):
    """The fixture's frames written in a syntax and read again."""
    folder = _folder(spark)
    frames = _slides(spark, sf, C.transcoder(syntax, 8, 8, **options))
    save_slides(frames, folder, tile=8, columns="tiles_x", syntax=syntax).count()
    dicom.register(spark)
    return spark.read.format("dicomframes").load(folder).select("identifier", "frame_index", "tile_x", "tile_y", "data")


def _pixels(frames, syntax: str, keep: list[str], rows: int = 8, columns: int = 8, samples: int = 1, bits: int = 8, photometric: str = "MONOCHROME2"):
    """(keep ..., px, py, v) of every pixel of the frames (keep ..., data)."""
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in frames.select(*keep).schema), "px int, py int, v long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in P.cut(batches, rows * columns * samples):
            a = np.stack([C.decode_frame(d, syntax, rows, columns, samples, bits, photometric) for d in batch.column(len(keep)).to_pylist()]).reshape(len(batch), -1) if len(batch) else np.zeros((0, rows * columns))
            row = pa.array(np.repeat(np.arange(len(batch)), a.shape[1]))
            i = np.tile(np.arange(a.shape[1]) // samples, len(batch))
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(row) for k in range(len(keep))], pa.array((i % columns).astype(np.int32)), pa.array((i // columns).astype(np.int32)), pa.array(a.reshape(-1).astype(np.int64))], names=[*keep, "px", "py", "v"])

    return frames.select(*keep, "data").mapInArrow(run, schema)


@query("pix18_decode", f"SELECT k AS codec, {_IDENTIFIER} AS identifier, CAST(floor(vec_id / 7) AS BIGINT) AS frame_index, px, py, CAST(v AS BIGINT) AS v FROM fx_pixel, (SELECT unnest({list(_LOSSLESS)}) AS k)")
def decode(spark, sf):
    """Every pixel of files in five syntaxes that keep it."""
    out = None
    for name, syntax in _LOSSLESS.items():
        one = _pixels(_stored(spark, sf, syntax), syntax, ["identifier", "frame_index"]).withColumn("codec", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("pix18_decode_lossy", f"SELECT {_IDENTIFIER} AS identifier, count(DISTINCT vec_id) AS frames, true AS close FROM fx_pixel GROUP BY vec_id % 7")
def decode_lossy(spark, sf):
    """JPEG frames of the best quality: no pixel is off by more than 3."""
    got = _pixels(_stored(spark, sf, C.JPEG_BASELINE, quality=100), C.JPEG_BASELINE, ["identifier", "frame_index"])
    own = fx(spark, sf, "fx_pixel").select(F.concat(F.lit("1.2.3."), (F.col("vec_id") % 7).cast("string")).alias("identifier"), F.floor(F.col("vec_id") / 7).alias("frame_index"), "px", "py", F.col("v").alias("was"))
    both = own.join(got, ["identifier", "frame_index", "px", "py"], "left")
    return both.groupBy("identifier").agg(F.count_distinct("frame_index").alias("frames"), F.bool_and(F.coalesce(F.abs(F.col("v") - F.col("was")) <= 3, F.lit(False))).alias("close"))


@query("pix19_encode", f"SELECT k AS codec, count(*) AS frames, true AS even, true AS again FROM embeddings, (SELECT unnest({[*_LOSSLESS, 'jpeg']}) AS k) GROUP BY k")
def encode(spark, sf):
    """Frames of each encoder: stored in an even number of bytes, and encoding what was decoded gives the same bytes for all that lose nothing.

    One step for all encoders: a frame crosses into Python once, and a few counts come back.
    """
    syntaxes = {**_LOSSLESS, "jpeg": C.JPEG_BASELINE}

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = {name: C.transcoder(syntax, 8, 8) for name, syntax in syntaxes.items()}
        for batch in P.packing(batches):
            rows = []
            for name, syntax in syntaxes.items():
                data = [encoders[name](d) for d in batch.column(1).to_pylist()]
                again = [name == "jpeg" or C.encode_frame(C.decode_frame(d, syntax, 8, 8), syntax) == d for d in data]
                rows.append((name, len(data), all((len(d) + len(d) % 2) % 2 == 0 for d in data), all(again)))
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["codec", "frames", "even", "again"])

    vectors = tables.spread(fx(spark, sf, "embeddings").select("vec_id", "embedding"), ["vec_id"], 1000)
    counts = vectors.mapInArrow(check, "codec string, frames long, even boolean, again boolean")
    return counts.groupBy("codec").agg(F.sum("frames").alias("frames"), F.bool_and("even").alias("even"), F.bool_and("again").alias("again"))


_KINDS = ("jpeg", "jpeg_lossless", "jpeg_ls", "jpeg_2000", "ht_jpeg_2000", "jpeg_xl", "rle", "native", "implicit")


@query("pix21_codec_rules", f"""WITH s AS (SELECT k, b, c, l, p FROM (SELECT unnest({list(_KINDS)}) AS k), (SELECT unnest([8, 12, 16]) AS b), (SELECT unnest(['grayscale', 'ybr', 'rgb']) AS c), (SELECT unnest([true, false]) AS l), (SELECT unnest([NULL, 3]) AS p)),
t AS (SELECT *, '1.2.840.10008.1.2' || CASE k WHEN 'jpeg' THEN CASE b WHEN 8 THEN '.4.50' WHEN 12 THEN '.4.51' END WHEN 'jpeg_lossless' THEN CASE WHEN p IS NULL THEN '.4.70' ELSE '.4.57' END WHEN 'jpeg_ls' THEN CASE WHEN l THEN '.4.80' ELSE '.4.81' END
  WHEN 'jpeg_2000' THEN CASE WHEN l THEN '.4.90' ELSE '.4.91' END WHEN 'ht_jpeg_2000' THEN CASE WHEN l THEN '.4.201' ELSE '.4.203' END WHEN 'jpeg_xl' THEN CASE WHEN l THEN '.4.110' ELSE '.4.112' END WHEN 'rle' THEN '.5' WHEN 'native' THEN '.1' ELSE '' END AS syntax,
  CASE c WHEN 'grayscale' THEN 'MONOCHROME2' WHEN 'rgb' THEN 'RGB' ELSE CASE WHEN k = 'jpeg' THEN 'YBR_FULL_422' WHEN k IN ('jpeg_2000', 'ht_jpeg_2000') AND l THEN 'YBR_RCT' WHEN k IN ('jpeg_2000', 'ht_jpeg_2000') THEN 'YBR_ICT' WHEN k IN ('jpeg_lossless', 'jpeg_xl', 'rle') THEN 'YBR_FULL' END END AS photometric FROM s)
SELECT k AS kind, b AS bits, c AS channels, l AS lossless, p AS predictor, syntax, photometric FROM t WHERE syntax IS NOT NULL AND photometric IS NOT NULL""")
def codec_rules(spark, sf):
    """Syntax and photometric interpretation of all encoder settings that can be had."""
    rows = spark.createDataFrame([(k, b, c, lossless, p) for k in _KINDS for b in (8, 12, 16) for c in ("grayscale", "ybr", "rgb") for lossless in (True, False) for p in (None, 3)], "kind string, bits int, channels string, lossless boolean, predictor int")
    return rows.select("*", C.coding(*[F.col(c) for c in rows.columns]).alias("c")).where("c is not null").select(*rows.columns, "c.syntax", "c.photometric")


@query("pix22_support_matrix", """SELECT file_id, syntax IN ('1.2.840.10008.1.2.1', '1.2.840.10008.1.2.5') OR (syntax = '1.2.840.10008.1.2.4.50' AND bits = 8) AS readable FROM fx_file WHERE bits IS NOT NULL""")
def support_matrix(spark, sf):
    """Files whose pixels this package decodes, by a join with its own table."""
    matrix = F.broadcast(C.support_matrix(spark))  # a few dozen rows by construction
    return fx(spark, sf, "fx_file").where("bits is not null").join(matrix, ["syntax", "samples", "bits"], "left").select("file_id", F.coalesce("decodes", F.lit(False)).alias("readable"))


@query("pix02_encoded_tile", f"SELECT {_IDENTIFIER} AS identifier, CAST(floor(vec_id / 7) AS BIGINT) % 10 AS tile_x, CAST(floor(floor(vec_id / 7) / 10) AS BIGINT) AS tile_y, CAST(floor(vec_id / 7) AS BIGINT) % 10 = 9 AS edge, CAST(sum(CASE WHEN CAST(floor(vec_id / 7) AS BIGINT) % 10 = 9 AND px >= 5 THEN 0 ELSE v END) AS BIGINT) AS total FROM fx_pixel GROUP BY ALL")
def encoded_tile(spark, sf):
    """Encoded tiles of an image of 77 pixels across: inner ones go out as stored, those at the edge are decoded, cropped to 5 columns and encoded again."""
    frames = _stored(spark, sf, C.RLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, d in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True):
                out.append(d if x < 9 else C.encode_frame(C.decode_frame(d, C.RLE, 8, 8)[:, :5], C.RLE))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(4)], pa.array(out, pa.binary())], schema=batch.schema)

    tiles = frames.mapInArrow(run, frames.schema)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = [int(C.decode_frame(d, C.RLE, 8, 5 if x == 9 else 8).sum()) for x, d in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(3)], pa.array([x == 9 for x in batch.column(1).to_pylist()]), pa.array(total, pa.int64())], names=["identifier", "tile_x", "tile_y", "edge", "total"])

    return tiles.select("identifier", "tile_x", "tile_y", "data").mapInArrow(sums, "identifier string, tile_x long, tile_y long, edge boolean, total long")


_IMAGE = f"SELECT {_IDENTIFIER} AS identifier, (CAST(floor(vec_id / 7) AS BIGINT) % 10) * 8 + px AS gx, CAST(floor(floor(vec_id / 7) / 10) AS BIGINT) * 8 + py AS gy, v FROM fx_pixel"


def _inside(spark, sf, x: int, y: int, w: int, h: int, syntax: str = C.JPEG_LS):
    """(identifier, gx, gy, v): a region of slides' images from their files; only tiles that it touches are decoded."""
    frames = _stored(spark, sf, syntax)
    touched = frames.where(F.col("tile_x").between(x // 8, (x + w - 1) // 8) & F.col("tile_y").between(y // 8, (y + h - 1) // 8))
    p = _pixels(touched, syntax, ["identifier", "tile_x", "tile_y"])
    gx, gy = F.col("tile_x") * 8 + F.col("px"), F.col("tile_y") * 8 + F.col("py")
    return p.where((gx >= x) & (gx < x + w) & (gy >= y) & (gy < y + h)).select("identifier", gx.alias("gx"), gy.alias("gy"), "v")


@query("pix03_region_pixels", f"SELECT identifier, gx - 5 AS x, gy - 3 AS y, CAST(v AS BIGINT) AS v FROM ({_IMAGE}) WHERE gx >= 5 AND gx < 60 AND gy >= 3 AND gy < 40")
def region_pixels(spark, sf):
    """A region of each slide, from files: only tiles that it touches are decoded."""
    frames = _stored(spark, sf, C.JPEG_LS)
    touched = frames.where((F.col("tile_x") < 8) & (F.col("tile_y") < 5))  # 60 and 40 pixels of tiles of 8
    p = _pixels(touched, C.JPEG_LS, ["identifier", "tile_x", "tile_y"])
    gx, gy = F.col("tile_x") * 8 + F.col("px"), F.col("tile_y") * 8 + F.col("py")
    return p.where((gx >= 5) & (gx < 60) & (gy >= 3) & (gy < 40)).select("identifier", (gx - 5).alias("x"), (gy - 3).alias("y"), "v")


@query("pix10_scaled_tile", f"""WITH i AS ({_IMAGE}), h AS (SELECT identifier, gx // 2 AS gx, gy // 2 AS gy, (sum(v) + 2) // 4 AS v FROM i GROUP BY ALL), q AS (SELECT identifier, gx // 2 AS gx, gy // 2 AS gy, (sum(v) + 2) // 4 AS v FROM h GROUP BY ALL)
SELECT identifier, CAST(gx // 8 AS BIGINT) AS tile_x, CAST(gy // 8 AS BIGINT) AS tile_y, CAST(sum(v) AS BIGINT) AS total, count(*) AS pixels FROM q GROUP BY ALL""")
def scaled_tile(spark, sf):
    """Tiles of a level that isn't stored, a quarter in size, from the files of the one that is."""
    frames = _stored(spark, sf, C.RLE)

    def quarter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            small = [P.halve(P.halve(C.decode_frame(d, C.RLE, 8, 8))).reshape(-1) for d in batch.column(3).to_pylist()]
            sums, n = [int(s.sum()) for s in small], [s.size for s in small]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sums, pa.int64()), pa.array(n, pa.int64())], names=["identifier", "x", "y", "total", "pixels"])

    each = frames.select("identifier", "tile_x", "tile_y", "data").mapInArrow(quarter, "identifier string, x long, y long, total long, pixels long")  # before the shuffle
    return each.groupBy("identifier", F.floor(F.col("x") / 4).alias("tile_x"), F.floor(F.col("y") / 4).alias("tile_y")).agg(F.sum("total").alias("total"), F.sum("pixels").alias("pixels"))


def _region(x: int, y: int, w: int, h: int) -> str:
    return f"SELECT identifier, CAST(sum(v) AS BIGINT) AS total, count(*) AS pixels FROM ({_IMAGE}) WHERE gx >= {x} AND gx < {x + w} AND gy >= {y} AND gy < {y + h} GROUP BY identifier"


def _summed(spark, sf, x: int, y: int, w: int, h: int):
    return _inside(spark, sf, x, y, w, h).groupBy("identifier").agg(F.sum("v").alias("total"), F.count("*").alias("pixels"))


@query("pix11_region_mm", _region(8, 4, 40, 20))
def region_mm(spark, sf):
    """A region in millimetres of the image, at the spacing that the files say (0.00025 across, 0.0005 down)."""
    return _summed(spark, sf, int(0.002 / 0.00025), int(0.002 / 0.0005), int(0.01 / 0.00025), int(0.01 / 0.0005))


@query("pix14_thumbnail", f"SELECT identifier, CAST(ceil((max(gx) + 1) / 8) AS BIGINT) AS width, CAST(ceil((max(gy) + 1) / 8) AS BIGINT) AS height, CAST(sum(m) AS BIGINT) AS total FROM (SELECT identifier, max(gx) AS gx, max(gy) AS gy, (sum(h) + 2) // 4 AS m FROM (SELECT identifier, max(gx) AS gx, max(gy) AS gy, (sum(h) + 2) // 4 AS h FROM (SELECT identifier, max(gx) AS gx, max(gy) AS gy, (sum(v) + 2) // 4 AS h FROM ({_IMAGE}) GROUP BY identifier, gx // 2, gy // 2) GROUP BY identifier, gx // 4, gy // 4) GROUP BY identifier, gx // 8, gy // 8) GROUP BY identifier")
def thumbnail(spark, sf):
    """Each slide at an eighth of its size: every tile becomes a pixel before tiles meet."""
    frames = _stored(spark, sf, C.JPEG_LOSSLESS_FIRST)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = [int(P.halve(P.halve(P.halve(C.decode_frame(d, C.JPEG_LOSSLESS_FIRST, 8, 8))))[0, 0]) for d in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(v, pa.int64())], names=["identifier", "x", "y", "v"])

    pixels = frames.select("identifier", "tile_x", "tile_y", "data").mapInArrow(one, "identifier string, x long, y long, v long")
    return pixels.groupBy("identifier").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.sum("v").alias("total"))


@query("pix15_label_read", f"SELECT {_IDENTIFIER} AS identifier, CAST(sum(v) AS BIGINT) AS total FROM fx_pixel WHERE vec_id < 7 GROUP BY vec_id % 7")
def label_read(spark, sf):
    """The labels among volume and label files of a folder, read whole."""
    folder = _folder(spark)
    rows = _slides(spark, sf)
    save_slides(rows.where("frame_index = 0"), folder, tile=8, columns="tiles_x", kind="LABEL").count()
    other = _folder(spark)
    save_slides(rows, other, tile=8, columns="tiles_x").count()
    dicom.register(spark)
    heads = spark.read.format("dicomslides").load(folder).unionByName(spark.read.format("dicomslides").load(other)).where("image_type = 'LABEL'").select("path")
    frames = spark.read.format("dicomframes").load(folder).unionByName(spark.read.format("dicomframes").load(other))
    p = _pixels(frames.join(heads, "path", "left_semi"), C.EXPLICIT, ["identifier", "frame_index"])
    return p.groupBy("identifier").agg(F.sum("v").alias("total"))


@query("str04_reader_variants", f"SELECT k AS variant, {_IDENTIFIER} AS identifier, CAST(sum(v) AS BIGINT) AS total, k IN ('passthrough', 'passthrough cascading') AS same_bytes FROM fx_pixel, (SELECT unnest(['passthrough', 'transcode', 'passthrough cascading', 'transcode cascading']) AS k) GROUP BY ALL")
def reader_variants(spark, sf):
    """Frames copied or encoded anew, with or without the pixels that the next level needs: one plan with a column more."""
    frames = _stored(spark, sf, C.RLE)
    out = None
    for name, syntax in (("passthrough", C.RLE), ("transcode", C.JPEG_LS), ("passthrough cascading", C.RLE), ("transcode cascading", C.JPEG_LS)):

        def run(batches: Iterator[pa.RecordBatch], syntax=syntax) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sums, same = [], []
                for d in batch.column(1).to_pylist():
                    a = C.decode_frame(d, C.RLE, 8, 8)
                    sent = d if syntax == C.RLE else C.encode_frame(a, syntax)
                    sums.append(int(C.decode_frame(sent, syntax, 8, 8).sum()))
                    same.append(sent == d)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.int64()), pa.array(same)], names=["identifier", "total", "same"])

        one = frames.select("identifier", "data").mapInArrow(run, "identifier string, total long, same boolean").groupBy("identifier").agg(F.sum("total").alias("total"), F.bool_and("same").alias("same_bytes")).withColumn("variant", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("str06_level_writer", """WITH RECURSIVE t AS (SELECT CAST(0 AS INT) AS level, vec_id % 7 AS s, CAST(floor(vec_id / 7) AS BIGINT) % 10 AS x, CAST(floor(floor(vec_id / 7) / 10) AS BIGINT) AS y FROM embeddings UNION SELECT level + 1, s, CAST(floor(x / 2) AS BIGINT), CAST(floor(y / 2) AS BIGINT) FROM t WHERE level < 3)
SELECT level, '1.2.3.' || CAST(s AS VARCHAR) AS identifier, count(*) AS frames FROM t GROUP BY level, s""")
def level_writer(spark, sf):
    """Four levels of each slide, every one written to files from the one before and read again."""
    tiles = _slides(spark, sf).select("slide", (F.col("frame_index") % 10).alias("tile_x"), F.floor(F.col("frame_index") / 10).alias("tile_y"), "data")
    out, across = None, 10
    for level in range(4):
        folder = _folder(spark)
        frames = tiles.select("slide", (F.col("tile_y") * across + F.col("tile_x")).alias("frame_index"), F.lit(across).alias("tiles_x"), "tile_x", "tile_y", "data")
        save_slides(frames, folder, tile=8, columns="tiles_x", sparse=True).count()
        dicom.register(spark)
        read = spark.read.format("dicomframes").load(folder)
        one = read.groupBy("identifier").agg(F.count("*").alias("frames")).withColumn("level", F.lit(level))
        out = one if out is None else out.unionByName(one)
        slide = F.element_at(F.split("identifier", r"\."), -1).cast("bigint")
        each = read.select(slide.alias("slide"), "tile_x", "tile_y", "data")

        def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                small = [P.halve(np.frombuffer(d, np.uint8).reshape(8, 8)).astype(np.uint8).tobytes() for d in batch.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(small, pa.binary())], names=["slide", "x", "y", "small"])

        quarters = each.mapInArrow(shrink, "slide long, x long, y long, small binary").groupBy("slide", F.floor(F.col("x") / 2).alias("tile_x"), F.floor(F.col("y") / 2).alias("tile_y")).agg(F.collect_list(F.struct(F.pmod("x", F.lit(2)).alias("x"), F.pmod("y", F.lit(2)).alias("y"), "small")).alias("q"))  # four at most

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data = []
                for q in batch.column(3).to_pylist():
                    a = np.zeros((8, 8), np.uint8)
                    for p in q:
                        a[p["y"] * 4 : p["y"] * 4 + 4, p["x"] * 4 : p["x"] * 4 + 4] = np.frombuffer(p["small"], np.uint8).reshape(4, 4)
                    data.append(a.tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(data, pa.binary())], names=["slide", "tile_x", "tile_y", "data"])

        tiles = quarters.mapInArrow(join, "slide long, tile_x long, tile_y long, data binary")
        across = -(-across // 2)
    return out


@query("pix12_region_mpp", f"""WITH b AS (SELECT * FROM ({_IMAGE}) WHERE gx >= 16 AND gx < 80 AND gy >= 8 AND gy < 40)
SELECT identifier, CAST(gx // 2 - 8 AS BIGINT) AS x, CAST(gy // 2 - 4 AS BIGINT) AS y, CAST((sum(v) + 2) // 4 AS BIGINT) AS v FROM b GROUP BY identifier, gx // 2, gy // 2""")
def region_mpp(spark, sf):
    """A region at twice the spacing that is stored: from the closest finer level, its size divided by the spacing."""
    stored, wanted = 0.25, 0.5  # micrometres a pixel
    factor = int(wanted / stored)
    x, y, w, h = 16, 8, 64, 32
    shrunk = [F.floor(F.col(c) / factor) for c in ("gx", "gy")]
    sums = _inside(spark, sf, x, y, w, h).groupBy("identifier", shrunk[0].alias("x"), shrunk[1].alias("y")).agg(F.sum("v").alias("v"))
    return sums.select("identifier", (F.col("x") - x // factor).alias("x"), (F.col("y") - y // factor).alias("y"), F.floor((F.col("v") + factor * factor // 2) / (factor * factor)).alias("v"))


@query("pix17_tile_order", f"SELECT {_IDENTIFIER} AS identifier, CAST(floor(vec_id / 7) AS BIGINT) AS nth, CAST(sum(v) AS BIGINT) AS total FROM fx_pixel GROUP BY ALL")
def tile_order(spark, sf):
    """Decoded tiles of each slide in order of path, plane, row and column, from files whose frames are in another order."""
    frames = _slides(spark, sf).select("slide", "tiles_x", "data", (F.col("frame_index") % 10).alias("tile_x"), F.floor(F.col("frame_index") / 10).alias("tile_y"))
    turned = F.row_number().over(Window.partitionBy("slide").orderBy(F.desc("tile_x"), "tile_y")) - 1
    folder = _folder(spark)
    save_slides(frames.withColumn("frame_index", turned.cast("bigint")), folder, tile=8, columns="tiles_x", sparse=True).count()
    dicom.register(spark)
    read = spark.read.format("dicomframes").load(folder)
    sums = _pixels(read, C.EXPLICIT, ["identifier", "optical_path", "z", "tile_y", "tile_x"]).groupBy("identifier", "optical_path", "z", "tile_y", "tile_x").agg(F.sum("v").alias("total"))
    nth = F.row_number().over(Window.partitionBy("identifier").orderBy("optical_path", "z", "tile_y", "tile_x")) - 1
    return sums.select("identifier", nth.cast("bigint").alias("nth"), "total")
