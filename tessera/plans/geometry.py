"""Queries over geometry, levels, tiles and frames."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera import tables
from tessera.functions import geometry as G
from tessera.operators import tiles as T
from tessera.plans.fixtures import fx
from tessera.plans.registry import query

_STORED = """SELECT q.*, s.level AS stored, s.width, s.height, s.tile_w, s.tile_h, CAST(POWER(2, q.level - s.level) AS BIGINT) AS scale FROM fx_request q JOIN fx_level s ON s.slide_id = q.slide_id
JOIN (SELECT q.request_id, max(s.level) AS level FROM fx_request q JOIN fx_level s ON s.slide_id = q.slide_id AND s.level <= q.level GROUP BY q.request_id) m ON m.request_id = q.request_id AND m.level = s.level"""
_CROPPED = f"""c AS (SELECT request_id, slide_id, stored, width, height, tile_w, tile_h, least(greatest(x * scale, 0), width) AS x, greatest(least((x + w) * scale, width), 0) - least(greatest(x * scale, 0), width) AS w,
  least(greatest(y * scale, 0), height) AS y, greatest(least((y + h) * scale, height), 0) - least(greatest(y * scale, 0), height) AS h FROM ({_STORED}))"""


def _requests(spark, sf):
    levels = fx(spark, sf, "fx_level").select("slide_id", "level", "width", "height", "tile_w", "tile_h")
    return T.scaled(T.closest_level(fx(spark, sf, "fx_request"), levels))


@query("pix03_region_plan", f"""WITH {_CROPPED},
t AS (SELECT request_id, slide_id, stored, tx, ty, CAST(ceil(width / tile_w) AS BIGINT) AS nx FROM
  (SELECT c.*, unnest(generate_series(CAST(floor(y / tile_h) AS BIGINT), CAST(floor((y + h - 1) / tile_h) AS BIGINT))) AS ty FROM c WHERE w > 0 AND h > 0) r,
  LATERAL (SELECT unnest(generate_series(CAST(floor(r.x / r.tile_w) AS BIGINT), CAST(floor((r.x + r.w - 1) / r.tile_w) AS BIGINT))) AS tx) u)
SELECT t.request_id, CAST(count(*) AS BIGINT) AS tiles, CAST(sum(coalesce(f.byte_len, 0)) AS BIGINT) AS bytes, CAST(sum(CASE WHEN f.byte_len IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing
FROM t LEFT JOIN fx_frame_len f ON f.identifier = t.slide_id AND f.frame_index = t.tx + t.nx * t.ty GROUP BY t.request_id""")
def region_plan(spark, sf):
    tiles = T.tiles_of(_requests(spark, sf))
    nx = G.tiles(F.col("width"), F.col("tile_w"))
    tiles = tiles.withColumn("frame_index", F.col("tile_x") + nx * F.col("tile_y")).withColumnRenamed("slide_id", "identifier")
    joined = T.with_frames(tiles, fx(spark, sf, "fx_frame_len"), ["identifier", "frame_index"])
    return joined.groupBy("request_id").agg(F.count("*").alias("tiles"), F.sum(F.coalesce("byte_len", F.lit(0))).alias("bytes"), F.count_if(F.col("byte_len").isNull()).alias("missing"))


@query("jn03_closest_level", f"SELECT request_id, stored, scale, width FROM ({_STORED})")
def closest_level(spark, sf):
    levels = fx(spark, sf, "fx_level").select("slide_id", "level", "width", "height", "tile_w", "tile_h")
    found = T.closest_level(fx(spark, sf, "fx_request"), levels)
    return found.select("request_id", "stored", F.pow(F.lit(2), F.col("level") - F.col("stored")).cast("bigint").alias("scale"), "width")


@query("geo06_region_crop", f"WITH {_CROPPED} SELECT request_id, x, y, w, h FROM c")
def region_crop(spark, sf):
    return _requests(spark, sf).select("request_id", "x", "y", "w", "h")


@query("jn06_region_tiles", f"""WITH {_CROPPED} SELECT r.request_id, u.tx AS tile_x, r.ty AS tile_y FROM
  (SELECT c.*, unnest(generate_series(CAST(floor(y / tile_h) AS BIGINT), CAST(floor((y + h - 1) / tile_h) AS BIGINT))) AS ty FROM c WHERE w > 0 AND h > 0) r,
  LATERAL (SELECT unnest(generate_series(CAST(floor(r.x / r.tile_w) AS BIGINT), CAST(floor((r.x + r.w - 1) / r.tile_w) AS BIGINT))) AS tx) u""")
def region_tiles(spark, sf):
    return T.tiles_of(_requests(spark, sf)).select("request_id", "tile_x", "tile_y")


_PLACED = f"""WITH {_CROPPED}, t AS (SELECT r.*, u.tx FROM
  (SELECT c.*, unnest(generate_series(CAST(floor(y / tile_h) AS BIGINT), CAST(floor((y + h - 1) / tile_h) AS BIGINT))) AS ty FROM c WHERE w > 0 AND h > 0) r,
  LATERAL (SELECT unnest(generate_series(CAST(floor(r.x / r.tile_w) AS BIGINT), CAST(floor((r.x + r.w - 1) / r.tile_w) AS BIGINT))) AS tx) u)"""


@query("geo07_inside_crop", _PLACED + """ SELECT request_id, tx AS tile_x, ty AS tile_y, greatest(x - tx * tile_w, 0) AS clip_x, least(x + w, (tx + 1) * tile_w) - greatest(x, tx * tile_w) AS clip_w,
  greatest(y - ty * tile_h, 0) AS clip_y, least(y + h, (ty + 1) * tile_h) - greatest(y, ty * tile_h) AS clip_h FROM t""")
def inside_crop(spark, sf):
    x, w = G.inside_crop(F.col("tile_x"), F.col("tile_w"), F.col("x"), F.col("w"))
    y, h = G.inside_crop(F.col("tile_y"), F.col("tile_h"), F.col("y"), F.col("h"))
    return T.tiles_of(_requests(spark, sf)).select("request_id", "tile_x", "tile_y", x.alias("clip_x"), w.alias("clip_w"), y.alias("clip_y"), h.alias("clip_h"))


@query("geo22_stitch_placement", _PLACED + " SELECT request_id, tx AS tile_x, ty AS tile_y, greatest(tx * tile_w - x, 0) AS to_x, greatest(ty * tile_h - y, 0) AS to_y FROM t")
def stitch_placement(spark, sf):
    at = [F.greatest(F.col(f"tile_{a}") * F.col(f"tile_{s}") - F.col(a), F.lit(0)).alias(f"to_{a}") for a, s in (("x", "w"), ("y", "h"))]
    return T.tiles_of(_requests(spark, sf)).select("request_id", "tile_x", "tile_y", *at)


@query("geo01_size_arithmetic", """SELECT slide_id, level, CAST(trunc(width / 3) AS BIGINT) AS third, CAST(ceil(width / 3) AS BIGINT) AS third_up, CAST(trunc(-height / 7) AS BIGINT) AS negative, width * height AS area, greatest(width, height) AS longest FROM fx_level""")
def size_arithmetic(spark, sf):
    w, h = F.col("width"), F.col("height")
    return fx(spark, sf, "fx_level").select("slide_id", "level", G.truncate(w / 3).alias("third"), G.ceil_div(w, F.lit(3)).alias("third_up"), G.truncate(-h / 7).alias("negative"), (w * h).alias("area"), F.greatest(w, h).alias("longest"))


@query("geo02_point_arithmetic", "SELECT request_id, ((x - 900) % 256 + 256) % 256 AS x_mod, CAST(trunc((y - 700) / 256) AS BIGINT) AS y_div, least(x, y) AS lo, greatest(x, y) AS hi FROM fx_request")
def point_arithmetic(spark, sf):
    x, y = F.col("x"), F.col("y")
    return fx(spark, sf, "fx_request").select("request_id", F.pmod(x - 900, F.lit(256)).alias("x_mod"), G.truncate((y - 700) / 256).alias("y_div"), F.least(x, y).alias("lo"), F.greatest(x, y).alias("hi"))


@query("geo03_size_mm", "SELECT slide_id, level, round(width * spacing_x, 9) AS width_mm, round(height * spacing_x / 2, 9) AS half_height_mm FROM fx_level")
def size_mm(spark, sf):
    return fx(spark, sf, "fx_level").select("slide_id", "level", F.round(F.col("width") * F.col("spacing_x"), 9).alias("width_mm"), F.round(F.col("height") * F.col("spacing_x") / 2, 9).alias("half_height_mm"))


@query("geo08_region_zoom", "SELECT request_id, CAST(trunc(x * 2.0 + (w * 2.0 - w) / 2) AS BIGINT) AS x, CAST(trunc(y * 0.5 + (h * 0.5 - h) / 2) AS BIGINT) AS y FROM fx_request")
def region_zoom(spark, sf):
    return fx(spark, sf, "fx_request").select("request_id", G.zoom(F.col("x"), F.col("w"), F.lit(2.0)).alias("x"), G.zoom(F.col("y"), F.col("h"), F.lit(0.5)).alias("y"))


@query("geo12_image_to_slide", """SELECT request_id, round(20 - sin(radians(slide_id * 90 % 360)) * x * 0.00025 + cos(radians(slide_id * 90 % 360)) * y * 0.00025, 7) AS sx,
  round(40 + cos(radians(slide_id * 90 % 360)) * x * 0.00025 + sin(radians(slide_id * 90 % 360)) * y * 0.00025, 7) AS sy FROM fx_request""")
def image_to_slide(spark, sf):
    turn = F.col("slide_id") * 90 % 360
    sx, sy = G.image_to_slide(F.col("x") * 0.00025, F.col("y") * 0.00025, F.lit(20.0), F.lit(40.0), turn)
    return fx(spark, sf, "fx_request").select("request_id", F.round(sx, 7).alias("sx"), F.round(sy, 7).alias("sy"))


@query("geo12_round_trip", "SELECT request_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM fx_request")
def round_trip(spark, sf):
    sx, sy = G.image_to_slide(F.col("x"), F.col("y"), F.lit(20.0), F.lit(40.0), F.col("slide_id") * 90 % 360)
    rows = fx(spark, sf, "fx_request").withColumns({"sx": sx, "sy": sy})
    x, y = G.slide_to_image(F.col("sx"), F.col("sy"), F.lit(20.0), F.lit(40.0), F.col("slide_id") * 90 % 360)
    return rows.select("request_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y")).select("request_id", (F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y"))


@query("geo16_level_index", "SELECT slide_id, level, CAST(round_even(log2(spacing_x / 0.00025), 0) AS BIGINT) AS found FROM fx_level")
def level_index(spark, sf):
    return fx(spark, sf, "fx_level").select("slide_id", "level", G.level_index(F.col("spacing_x"), F.lit(0.00025)).alias("found"))


@query("geo17_highest_level", "SELECT slide_id, level, CAST(ceil(log2(greatest(width, height))) AS BIGINT) AS highest, CAST(greatest(0, ceil(log2(greatest(width / 256, height / 256)))) AS BIGINT) AS single, CAST(POWER(2, 5 - level) AS BIGINT) AS scale FROM fx_level")
def highest_level(spark, sf):
    w, h = F.col("width"), F.col("height")
    return fx(spark, sf, "fx_level").select("slide_id", "level", G.highest_level(w, h).alias("highest"), G.single_tile_level(w, h, F.col("tile_w"), F.col("tile_h")).alias("single"), F.pow(F.lit(2), 5 - F.col("level")).cast("bigint").alias("scale"))


@query("geo18_tiled_size", "SELECT slide_id, level, CAST(ceil(width / tile_w) AS BIGINT) AS tiles_x, CAST(ceil(height / tile_h) AS BIGINT) AS tiles_y FROM fx_level")
def tiled_size(spark, sf):
    return fx(spark, sf, "fx_level").select("slide_id", "level", G.tiles(F.col("width"), F.col("tile_w")).alias("tiles_x"), G.tiles(F.col("height"), F.col("tile_h")).alias("tiles_y"))


@query("geo19_full_frame_index", """WITH g AS (SELECT slide_id, level, CAST(ceil(width / 256) AS BIGINT) AS nx, CAST(ceil(height / 256) AS BIGINT) AS ny, n_planes, n_paths FROM fx_level),
t AS (SELECT g.*, unnest(generate_series(0, nx * ny * n_planes * n_paths - 1)) AS f FROM g)
SELECT slide_id, level, f AS frame, f % nx AS x, CAST(floor(f / nx) AS BIGINT) % ny AS y, CAST(floor(f / (nx * ny)) AS BIGINT) % n_planes AS z, CAST(floor(f / (nx * ny * n_planes)) AS BIGINT) AS p FROM t""")
def full_frame_index(spark, sf):
    nx, ny = G.tiles(F.col("width"), F.col("tile_w")), G.tiles(F.col("height"), F.col("tile_h"))
    rows = tables.spread(fx(spark, sf, "fx_level").select("slide_id", "level", nx.alias("nx"), ny.alias("ny"), "n_planes", "n_paths"), ["slide_id", "level"])
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1))
    rows = rows.withColumn("p", upto("n_paths")).withColumn("z", upto("n_planes")).withColumn("y", upto("ny")).withColumn("x", upto("nx"))
    frame = G.full_frame(*[F.col(c) for c in ("x", "y", "z", "p", "nx", "ny", "n_planes")])
    return rows.select("slide_id", "level", frame.alias("frame"), "x", "y", "z", "p")


@query("geo20_sparse_tile_index", """SELECT slide_id, x, y, z, path, max(frame_no) AS frame FROM (SELECT slide_id, CAST(floor((col_pos - 1) / 256) AS BIGINT) AS x, CAST(floor((row_pos - 1) / 256) AS BIGINT) AS y, CAST(round_even(z * 1000, 0) AS BIGINT) AS z, path, frame_no FROM fx_sparse_frame) GROUP BY slide_id, x, y, z, path""")
def sparse_tile_index(spark, sf):
    z = G.half_even(F.col("z") * 1000)
    rows = fx(spark, sf, "fx_sparse_frame").select("slide_id", G.sparse_tile(F.col("col_pos"), F.lit(256)).alias("x"), G.sparse_tile(F.col("row_pos"), F.lit(256)).alias("y"), z.alias("z"), "path", "frame_no")
    return T.last_frame(rows, ["slide_id", "x", "y", "z", "path"], "frame_no").withColumnRenamed("frame_no", "frame")


def _grids(spark, sf, frames):
    """(slide_id, x, y) of all tiles, of slides that have frames and of those that have none: only the first ask for a frame and are shuffled."""
    nx, ny = G.tiles(F.col("width"), F.col("tile_w")), G.tiles(F.col("height"), F.col("tile_h"))
    levels = fx(spark, sf, "fx_level").where("level = 0").select("slide_id", nx.alias("nx"), ny.alias("ny"))
    slides = frames.select("slide_id").distinct()

    def tiles(kind: str):
        rows = tables.spread(levels.join(slides, "slide_id", kind), ["slide_id"])
        return rows.withColumn("y", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("ny") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nx") - 1))).select("slide_id", "x", "y")

    return tiles("left_semi"), tiles("left_anti")


@query("jn01_tile_frame", """WITH g AS (SELECT slide_id, CAST(ceil(width / 256) AS BIGINT) AS nx, CAST(ceil(height / 256) AS BIGINT) AS ny FROM fx_level WHERE level = 0),
t AS (SELECT slide_id, nx, ny, unnest(generate_series(0, nx * ny - 1)) AS i FROM g),
f AS (SELECT slide_id, CAST(floor((col_pos - 1) / 256) AS BIGINT) AS x, CAST(floor((row_pos - 1) / 256) AS BIGINT) AS y, max(frame_no) AS frame FROM fx_sparse_frame WHERE z = 0 GROUP BY ALL)
SELECT t.slide_id, CAST(count(*) AS BIGINT) AS tiles, CAST(count(f.frame) AS BIGINT) AS stored, CAST(sum(CASE WHEN f.frame IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS blank
FROM t LEFT JOIN f ON f.slide_id = t.slide_id AND f.x = t.i % t.nx AND f.y = CAST(floor(t.i / t.nx) AS BIGINT) GROUP BY t.slide_id""")
def tile_frame(spark, sf):
    frames = fx(spark, sf, "fx_sparse_frame").where("z = 0").select("slide_id", G.sparse_tile(F.col("col_pos"), F.lit(256)).alias("x"), G.sparse_tile(F.col("row_pos"), F.lit(256)).alias("y"), "frame_no")
    last = tables.table(T.last_frame(frames, ["slide_id", "x", "y"], "frame_no"), "frames")
    grid, blank = _grids(spark, sf, last)
    joined = T.with_frames(grid, last, ["slide_id", "x", "y"]).unionByName(blank, allowMissingColumns=True)
    return joined.groupBy("slide_id").agg(F.count("*").alias("tiles"), F.count("frame_no").alias("stored"), F.count_if(F.col("frame_no").isNull()).alias("blank"))


@query("flt14_sparse_tiles", """WITH g AS (SELECT slide_id, CAST(ceil(width / 256) AS BIGINT) AS nx, CAST(ceil(height / 256) AS BIGINT) AS ny FROM fx_level WHERE level = 0),
t AS (SELECT slide_id, nx, unnest(generate_series(0, nx * ny - 1)) AS i FROM g)
SELECT slide_id, i % nx AS x, CAST(floor(i / nx) AS BIGINT) AS y FROM t ANTI JOIN (SELECT DISTINCT slide_id AS s, CAST(floor((col_pos - 1) / 256) AS BIGINT) AS x, CAST(floor((row_pos - 1) / 256) AS BIGINT) AS y FROM fx_sparse_frame) f
ON f.s = t.slide_id AND f.x = t.i % t.nx AND f.y = CAST(floor(t.i / t.nx) AS BIGINT)""")
def sparse_tiles(spark, sf):
    frames = fx(spark, sf, "fx_sparse_frame").select("slide_id", G.sparse_tile(F.col("col_pos"), F.lit(256)).alias("x"), G.sparse_tile(F.col("row_pos"), F.lit(256)).alias("y")).distinct()
    stored = tables.table(frames, "frames")
    grid, blank = _grids(spark, sf, stored)
    return grid.join(stored, ["slide_id", "x", "y"], "left_anti").unionByName(blank)


@query("geo23_thumbnail_size", "SELECT slide_id, level, greatest(CAST(round_even(width * least(200 / width, 150 / height, 1.0), 0) AS BIGINT), 1) AS w, greatest(CAST(round_even(height * least(200 / width, 150 / height, 1.0), 0) AS BIGINT), 1) AS h FROM fx_level")
def thumbnail_size(spark, sf):
    w, h = G.fit(F.col("width"), F.col("height"), F.lit(200), F.lit(150))
    return fx(spark, sf, "fx_level").select("slide_id", "level", w.cast("bigint").alias("w"), h.cast("bigint").alias("h"))


@query("src13_file_of_frame", "SELECT f.identifier, f.frame_index, c.part, f.frame_index - c.frame_offset AS local_index FROM fx_frame_len f JOIN fx_concat_file c ON c.identifier = f.identifier AND f.frame_index >= c.frame_offset AND f.frame_index < c.frame_offset + c.n_frames")
def file_of_frame(spark, sf):
    return T.file_of_frame(fx(spark, sf, "fx_frame_len"), fx(spark, sf, "fx_concat_file")).select("identifier", "frame_index", "part", (F.col("frame_index") - F.col("frame_offset")).alias("local_index"))


@query("src14_native_index", "SELECT identifier, part, k AS frame, 1000 + k * 256 * 256 * 3 AS byte_offset FROM (SELECT identifier, part, unnest(generate_series(0, n_frames - 1)) AS k FROM fx_concat_file)")
def native_index(spark, sf):
    return fx(spark, sf, "fx_concat_file").select("identifier", "part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_frames") - 1)).alias("frame")).withColumn("byte_offset", 1000 + F.col("frame") * (256 * 256 * 3))


@query("snk15_offset_table", "SELECT identifier, frame_index, CAST(coalesce(sum(byte_len + 8) OVER (PARTITION BY identifier ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM fx_frame_len")
def offset_table(spark, sf):
    return T.offsets(fx(spark, sf, "fx_frame_len")).select("identifier", "frame_index", "offset")


@query("src15_basic_offset_lengths", "SELECT identifier, frame_index, byte_len AS length FROM fx_frame_len")
def basic_offset_lengths(spark, sf):
    table = T.offsets(fx(spark, sf, "fx_frame_len"))
    end = F.sum(F.col("byte_len") + 8).over(Window.partitionBy("identifier"))
    return T.lengths(table.withColumn("end_offset", end)).select("identifier", "frame_index", "length")


@query("src20_index_validation", "SELECT c.identifier, CAST(sum(c.n_frames) AS BIGINT) AS declared, CAST(max(f.n) AS BIGINT) AS found, sum(c.n_frames) <> max(f.n) AS wrong FROM fx_concat_file c JOIN (SELECT identifier, count(*) AS n FROM fx_frame_len GROUP BY identifier) f ON f.identifier = c.identifier GROUP BY c.identifier")
def index_validation(spark, sf):
    found = fx(spark, sf, "fx_frame_len").groupBy("identifier").agg(F.count("*").alias("found"))
    declared = fx(spark, sf, "fx_concat_file").groupBy("identifier").agg(F.sum("n_frames").alias("declared"))
    return declared.join(found, "identifier").select("identifier", "declared", "found", (F.col("declared") != F.col("found")).alias("wrong"))
