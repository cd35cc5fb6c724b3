"""Queries over file layout."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import layout as L
from tessera.operators import tiles as T
from tessera.plans.fixtures import fx
from tessera.plans.registry import query


@query("snk04_level_selection", "SELECT slide_id, level FROM (SELECT slide_id, level, row_number() OVER (PARTITION BY slide_id ORDER BY level) - 1 AS p, count(*) OVER (PARTITION BY slide_id) AS n FROM fx_level) WHERE p IN (0, 9) OR p - n = -1")
def level_selection(spark, sf):
    return L.select_levels(fx(spark, sf, "fx_level").select("slide_id", "level"), [0, 9, -1])


@query("snk05_level_plan", "WITH s AS (SELECT slide_id, level FROM fx_level WHERE (slide_id + level) % 3 <> 0 OR level = 0) SELECT w.slide_id, w.level, max(s.level) AS source, max(s.level) = w.level AS read FROM fx_level w JOIN s ON s.slide_id = w.slide_id AND s.level <= w.level GROUP BY w.slide_id, w.level")
def level_plan(spark, sf):
    rows = fx(spark, sf, "fx_level").select("slide_id", "level")
    return L.plan_levels(rows, rows.where("(slide_id + level) % 3 <> 0 or level = 0"))


@query("snk09_split_by_frames", "SELECT identifier, frame_index, CAST(floor((row_number() OVER (PARTITION BY identifier ORDER BY frame_index) - 1) / 64) AS BIGINT) AS part FROM fx_frame_len")
def split_by_frames(spark, sf):
    return L.split_by_frames(fx(spark, sf, "fx_frame_len"), 64).select("identifier", "frame_index", "part")


@query("snk10_split_by_bytes", """WITH RECURSIVE o AS (SELECT identifier, frame_index, byte_len + 8 AS size, row_number() OVER (PARTITION BY identifier ORDER BY frame_index) AS n FROM fx_frame_len),
r AS (SELECT identifier, frame_index, n, 0 AS part, size AS held FROM o WHERE n = 1 UNION ALL
SELECT o.identifier, o.frame_index, o.n, CASE WHEN r.held + o.size > 4096 THEN r.part + 1 ELSE r.part END, CASE WHEN r.held + o.size > 4096 THEN o.size ELSE r.held + o.size END FROM r JOIN o ON o.identifier = r.identifier AND o.n = r.n + 1)
SELECT identifier, frame_index, CAST(part AS BIGINT) AS part FROM r""")
def split_by_bytes(spark, sf):
    return L.split_by_bytes(fx(spark, sf, "fx_frame_len"), 4096)


@query("snk11_no_split", "SELECT identifier, frame_index, CAST(0 AS BIGINT) AS part FROM fx_frame_len")
def no_split(spark, sf):
    return fx(spark, sf, "fx_frame_len").select("identifier", "frame_index", F.lit(0).cast("bigint").alias("part"))


@query("snk12_size_parsing", "SELECT request_id, CASE w % 4 WHEN 0 THEN w * 1048576 WHEN 1 THEN w * 1073741824 WHEN 2 THEN w END AS bytes FROM fx_request")
def size_parsing(spark, sf):
    unit = F.element_at(F.array(F.lit("MB"), F.lit(" g"), F.lit(""), F.lit("parsec")), (F.col("w") % 4 + 1).cast("int"))
    return fx(spark, sf, "fx_request").select("request_id", L.parse_size(F.concat(F.col("w").cast("string"), unit)).alias("bytes"))


@query("snk14_frame_order", "SELECT slide_id, frame_no, row_number() OVER (PARTITION BY slide_id ORDER BY path, z, row_pos, col_pos, frame_no) AS nth FROM fx_sparse_frame")
def frame_order(spark, sf):
    return fx(spark, sf, "fx_sparse_frame").select("slide_id", "frame_no", F.row_number().over(Window.partitionBy("slide_id").orderBy("path", "z", "row_pos", "col_pos", "frame_no")).cast("bigint").alias("nth"))


@query("snk18_compression_ratio", "SELECT identifier, round(CAST(count(*) * 65536 AS DOUBLE) / CAST(sum(byte_len) AS DOUBLE), 2) AS ratio FROM fx_frame_len GROUP BY identifier")
def compression_ratio(spark, sf):
    return fx(spark, sf, "fx_frame_len").groupBy("identifier").agg(F.round((F.count("*") * 65536).cast("double") / F.sum("byte_len").cast("double"), 2).alias("ratio"))


@query("win02_running_positions", "SELECT identifier, frame_index, CAST(sum(byte_len + 8) OVER (PARTITION BY identifier ORDER BY frame_index ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM fx_frame_len")
def running_positions(spark, sf):
    return fx(spark, sf, "fx_frame_len").select("identifier", "frame_index", F.sum(F.col("byte_len") + 8).over(Window.partitionBy("identifier").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))


@query("win07_plane_steps", "SELECT slide_id, z, z - lag(z) OVER (PARTITION BY slide_id ORDER BY z) AS step FROM (SELECT DISTINCT slide_id, z FROM fx_sparse_frame)")
def plane_steps(spark, sf):
    w = Window.partitionBy("slide_id").orderBy("z")
    return fx(spark, sf, "fx_sparse_frame").select("slide_id", "z").distinct().select("slide_id", "z", (F.col("z") - F.lag("z").over(w)).alias("step"))


@query("win01_offsets_to_lengths", "SELECT identifier, frame_index, CAST(byte_len AS BIGINT) AS length FROM fx_frame_len")
def offsets_to_lengths(spark, sf):
    """Lengths of frames from their offsets alone: to the next one, the last to the end."""
    placed = T.offsets(fx(spark, sf, "fx_frame_len"))
    ends = placed.groupBy("identifier").agg(F.max(F.col("offset") + 8 + F.col("byte_len")).alias("end_offset"))
    return T.lengths(placed.drop("byte_len").join(ends, "identifier")).select("identifier", "frame_index", "length")
