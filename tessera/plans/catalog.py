"""Queries over headers, instances, levels and pyramids."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera import tables
from tessera.functions import geometry as G
from tessera.operators import catalog as C
from tessera.plans.fixtures import fx
from tessera.plans.registry import query

@query("flt06_duplicates", "SELECT uid, count(*) AS n FROM fx_header GROUP BY uid HAVING count(*) > 1")
def duplicates(spark, sf):
    return C.duplicates(fx(spark, sf, "fx_header"), "uid")


@query("flt07_region_inside", "SELECT q.request_id, q.x >= 0 AND q.y >= 0 AND q.x + q.w <= l.width AND q.y + q.h <= l.height AS inside FROM fx_request q JOIN fx_level l ON l.slide_id = q.slide_id AND l.level = q.level")
def region_inside(spark, sf):
    rows = fx(spark, sf, "fx_request").join(fx(spark, sf, "fx_level"), ["slide_id", "level"])
    return rows.select("request_id", ((F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") + F.col("w") <= F.col("width")) & (F.col("y") + F.col("h") <= F.col("height"))).alias("inside"))


@query("flt08_valid_tile", "SELECT q.request_id, q.x % 40 < ceil(l.width / 256) AND q.y % 30 < ceil(l.height / 256) AND q.w % 4 < l.n_planes AND q.h % 3 < l.n_paths AS valid FROM fx_request q JOIN fx_level l ON l.slide_id = q.slide_id AND l.level = q.level")
def valid_tile(spark, sf):
    rows = fx(spark, sf, "fx_request").join(fx(spark, sf, "fx_level"), ["slide_id", "level"])
    inside = (F.col("x") % 40 < G.tiles(F.col("width"), F.col("tile_w"))) & (F.col("y") % 30 < G.tiles(F.col("height"), F.col("tile_h")))
    return rows.select("request_id", (inside & (F.col("w") % 4 < F.col("n_planes")) & (F.col("h") % 3 < F.col("n_paths"))).alias("valid"))


@query("flt09_size_comparisons", "SELECT request_id, w < 400 AND h < 300 AS all_less, w < 400 OR h < 300 AS any_less, w >= 400 AND h >= 300 AS all_not_less, w > 400 OR h > 300 AS any_more FROM fx_request")
def size_comparisons(spark, sf):
    w, h = F.col("w"), F.col("h")
    return fx(spark, sf, "fx_request").select("request_id", ((w < 400) & (h < 300)).alias("all_less"), ((w < 400) | (h < 300)).alias("any_less"), ((w >= 400) & (h >= 300)).alias("all_not_less"), ((w > 400) | (h > 300)).alias("any_more"))


@query("flt11_identifier_relaxed", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM fx_identifier a JOIN fx_identifier b ON a.s_suppkey % 10 = b.s_suppkey % 10 AND a.s_suppkey < b.s_suppkey WHERE a.issuer = '' OR b.issuer = '' OR a.issuer = b.issuer")
def identifier_relaxed(spark, sf):
    """Pairs, whose number is quadratic by nature; one side is spread, so that a task meets some of it with the other."""
    a, b = (fx(spark, sf, "fx_identifier").select(F.col("s_suppkey").alias(n), F.nullif("issuer", F.lit("")).alias(f"issuer_{n}"), (F.col("s_suppkey") % 10).alias("value")) for n in "ab")
    return tables.spread(a, ["a"], 500).join(b, "value").where((F.col("a") < F.col("b")) & (F.col("issuer_a").isNull() | F.col("issuer_b").isNull() | (F.col("issuer_a") == F.col("issuer_b")))).select("a", "b")


@query("flt12_code_equality", "SELECT count(*) AS pairs FROM fx_measurement a JOIN fx_measurement b ON a.annotation_id = b.annotation_id AND a.ordinal < b.ordinal AND a.code = b.code AND a.unit = b.unit")
def code_equality(spark, sf):
    a, b = (fx(spark, sf, "fx_measurement").select("annotation_id", F.col("ordinal").alias(f"o{n}"), F.struct("code", "unit").alias(f"c{n}")) for n in "ab")
    return a.join(b, "annotation_id").where((F.col("oa") < F.col("ob")) & (F.col("ca") == F.col("cb"))).agg(F.count("*").alias("pairs"))


@query("prj02_image_size", "SELECT file_id, CASE WHEN image_type <> 'VOLUME' AND n_frames = 1 AND total_columns > tile_size THEN tile_size ELSE total_columns END AS width FROM fx_header")
def image_size(spark, sf):
    one = (F.col("image_type") != "VOLUME") & (F.col("n_frames") == 1) & (F.col("total_columns") > F.col("tile_size"))
    return fx(spark, sf, "fx_header").select("file_id", F.when(one, F.col("tile_size")).otherwise(F.col("total_columns")).alias("width"))


@query("prj03_pixel_spacing", "SELECT file_id, CASE WHEN spacing > 0 THEN spacing END AS spacing_x FROM fx_header")
def pixel_spacing(spark, sf):
    return fx(spark, sf, "fx_header").select("file_id", F.when(F.col("spacing") > 0, F.col("spacing")).alias("spacing_x"))


@query("prj07_image_type", "SELECT file_id, (['ORIGINAL', 'PRIMARY', image_type, 'NONE'])[3] AS image_type FROM fx_header")
def image_type(spark, sf):
    return fx(spark, sf, "fx_header").select("file_id", F.element_at(F.array(F.lit("ORIGINAL"), F.lit("PRIMARY"), "image_type", F.lit("NONE")), 3).alias("image_type"))


@query("prj08_accessors", "SELECT slide_id, level, round(spacing_x * 1000, 9) AS mpp, round(width * spacing_x, 9) AS width_mm FROM fx_level")
def accessors(spark, sf):
    return fx(spark, sf, "fx_level").select("slide_id", "level", F.round(F.col("spacing_x") * 1000, 9).alias("mpp"), F.round(F.col("width") * F.col("spacing_x"), 9).alias("width_mm"))


@query("agg01_instances", "SELECT coalesce(concat_uid, uid) AS identifier, count(*) AS files, CAST(sum(n_frames) AS BIGINT) AS frames, max_by(file_id, total_columns * 1000000 - file_id) AS base_file FROM fx_header GROUP BY 1")
def instances(spark, sf):
    return C.instances(fx(spark, sf, "fx_header")).select("identifier", "files", "frames", "base_file")


@query("agg02_levels", "SELECT slide_id, width, height, count(*) AS n_instances, row_number() OVER (PARTITION BY slide_id ORDER BY width DESC, height DESC) AS rank FROM fx_instance GROUP BY slide_id, width, height")
def levels(spark, sf):
    return C.levels(fx(spark, sf, "fx_instance")).select("slide_id", "width", "height", "n_instances", F.col("rank").cast("bigint").alias("rank"))


@query("agg04_frame_count", "SELECT identifier, CAST(sum(n_frames) AS BIGINT) AS frames FROM fx_concat_file GROUP BY identifier")
def frame_count(spark, sf):
    return fx(spark, sf, "fx_concat_file").groupBy("identifier").agg(F.sum("n_frames").alias("frames"))


@query("agg05_ordered_paths", "SELECT user_id, event_type AS path, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id)) AS nth FROM events GROUP BY user_id, event_type")
def ordered_paths(spark, sf):
    first = fx(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("path")).agg(F.min("event_id").alias("at"))
    return first.select("user_id", "path", F.row_number().over(Window.partitionBy("user_id").orderBy("at")).cast("bigint").alias("nth"))


@query("agg06_focal_planes", "SELECT slide_id, CAST(count(DISTINCT z) AS BIGINT) AS planes, min(z) AS lowest, max(z) AS highest FROM fx_sparse_frame GROUP BY slide_id")
def focal_planes(spark, sf):
    planes = fx(spark, sf, "fx_sparse_frame").groupBy("slide_id").agg(F.sort_array(F.collect_set("z")).alias("z"))
    return planes.select("slide_id", F.size("z").cast("bigint").alias("planes"), F.element_at("z", 1).alias("lowest"), F.element_at("z", -1).alias("highest"))


@query("agg08_base_dataset", "SELECT slide_id, max_by(file_id, total_columns * 1000000 - file_id) AS base_file FROM fx_header WHERE image_type = 'VOLUME' GROUP BY slide_id")
def base_dataset(spark, sf):
    return fx(spark, sf, "fx_header").where("image_type = 'VOLUME'").groupBy("slide_id").agg(F.max_by("file_id", F.struct(F.col("total_columns"), -F.col("file_id"))).alias("base_file"))


@query("agg15_series_lists", "SELECT slide_id, string_agg(CAST(level AS VARCHAR), ',' ORDER BY spacing_x) AS levels, count(*) AS n FROM fx_level GROUP BY slide_id")
def series_lists(spark, sf):
    rows = fx(spark, sf, "fx_level").groupBy("slide_id").agg(F.sort_array(F.collect_list(F.struct("spacing_x", "level"))).alias("l"), F.count("*").alias("n"))
    return rows.select("slide_id", F.array_join(F.transform("l", lambda x: x["level"].cast("string")), ",").alias("levels"), "n")


@query("jn04_closest_spacing", "SELECT q.request_id, max(l.level) AS level FROM fx_request q JOIN fx_level l ON l.slide_id = q.slide_id AND l.spacing_x <= 0.0003E0 * (1 + q.w % 9) GROUP BY q.request_id")
def closest_spacing(spark, sf):
    stored = fx(spark, sf, "fx_level").groupBy("slide_id").agg(F.collect_list(F.struct("spacing_x", "level")).alias("l"))
    rows = fx(spark, sf, "fx_request").join(stored, "slide_id")
    best = F.array_max(F.filter("l", lambda x: x["spacing_x"] <= 0.0003 * (1 + F.col("w") % 9)))
    return rows.select("request_id", best["level"].alias("level")).where("level is not null")


@query("jn05_closest_size", "SELECT q.request_id, max(l.level) AS level FROM fx_request q LEFT JOIN fx_level l ON l.slide_id = q.slide_id AND l.width >= q.w * 4 GROUP BY q.request_id")
def closest_size(spark, sf):
    stored = fx(spark, sf, "fx_level").groupBy("slide_id").agg(F.collect_list(F.struct("width", "level")).alias("l"))
    rows = fx(spark, sf, "fx_request").join(stored, "slide_id", "left")
    best = F.array_min(F.filter("l", lambda x: x["width"] >= F.col("w") * 4))
    return rows.select("request_id", best["level"].alias("level"))


@query("jn08_last_instance", "SELECT slide_id, path_no, n_planes, max_by(uid, ordinal * 10 + level) AS uid FROM fx_instance GROUP BY slide_id, path_no, n_planes")
def last_instance(spark, sf):
    return fx(spark, sf, "fx_instance").groupBy("slide_id", "path_no", "n_planes").agg(F.max_by("uid", F.col("ordinal") * 10 + F.col("level")).alias("uid"))


@query("jn09_best_instance", "SELECT slide_id, level, path_no, uid FROM (SELECT *, row_number() OVER (PARTITION BY slide_id, level, path_no ORDER BY n_planes, ordinal) AS rn FROM fx_instance) WHERE rn = 1")
def best_instance(spark, sf):
    return C.best_instance(fx(spark, sf, "fx_instance"), ["slide_id", "level", "path_no"]).select("slide_id", "level", "path_no", "uid")


@query("srt01_levels_by_width", "SELECT slide_id, level, row_number() OVER (PARTITION BY slide_id ORDER BY width DESC) AS nth FROM fx_level")
def levels_by_width(spark, sf):
    return fx(spark, sf, "fx_level").select("slide_id", "level", F.row_number().over(Window.partitionBy("slide_id").orderBy(F.desc("width"))).cast("bigint").alias("nth"))


@query("srt02_files_by_offset", "SELECT identifier, part, row_number() OVER (PARTITION BY identifier ORDER BY frame_offset) AS nth FROM fx_concat_file")
def files_by_offset(spark, sf):
    return fx(spark, sf, "fx_concat_file").select("identifier", "part", F.row_number().over(Window.partitionBy("identifier").orderBy("frame_offset")).cast("bigint").alias("nth"))


@query("srt06_even_chunks", "SELECT identifier, frame_index, CAST(floor((row_number() OVER (PARTITION BY identifier ORDER BY frame_index) - 1) / ceil(count(*) OVER (PARTITION BY identifier) / 7.0)) AS BIGINT) AS chunk FROM fx_frame_len")
def even_chunks(spark, sf):
    w = Window.partitionBy("identifier")
    return fx(spark, sf, "fx_frame_len").select("identifier", "frame_index", F.floor((F.row_number().over(w.orderBy("frame_index")) - 1) / F.ceil(F.count("*").over(w) / 7)).cast("bigint").alias("chunk"))


@query("lim01_default_plane", "SELECT slide_id, arg_min(z, abs(z - mid) * 1000 + z) AS z FROM (SELECT slide_id, z, (min(z) OVER (PARTITION BY slide_id) + max(z) OVER (PARTITION BY slide_id)) / 2 AS mid FROM (SELECT DISTINCT slide_id, z FROM fx_sparse_frame)) GROUP BY slide_id")
def default_plane(spark, sf):
    planes = fx(spark, sf, "fx_sparse_frame").groupBy("slide_id").agg(F.sort_array(F.collect_set("z")).alias("z"))
    middle = (F.element_at("z", 1) + F.element_at("z", -1)) / 2
    nearest = F.array_min(F.transform("z", lambda z: F.struct(F.abs(z - middle).alias("d"), z.alias("z"))))
    return planes.select("slide_id", nearest["z"].alias("z"))


@query("set01_series_union", "SELECT slide_id, 'level' AS kind FROM fx_level UNION ALL SELECT slide_id, 'file' AS kind FROM fx_header")
def series_union(spark, sf):
    return fx(spark, sf, "fx_level").select("slide_id", F.lit("level").alias("kind")).unionByName(fx(spark, sf, "fx_header").select("slide_id", F.lit("file").alias("kind")))


@query("set02_plane_union", "SELECT slide_id, z FROM fx_sparse_frame UNION SELECT slide_id, CAST(n_planes AS DOUBLE) AS z FROM fx_level")
def plane_union(spark, sf):
    return fx(spark, sf, "fx_sparse_frame").select("slide_id", "z").union(fx(spark, sf, "fx_level").select("slide_id", F.col("n_planes").cast("double"))).distinct()


@query("set03_read_levels", "SELECT slide_id, level FROM fx_level INTERSECT SELECT slide_id, level FROM fx_request")
def read_levels(spark, sf):
    return fx(spark, sf, "fx_level").select("slide_id", "level").intersect(fx(spark, sf, "fx_request").select("slide_id", "level"))


@query("set04_bridged_levels", "SELECT slide_id, level FROM fx_request UNION SELECT slide_id, level FROM (SELECT slide_id, CAST(unnest(generate_series(0, m)) AS INT) AS level FROM (SELECT slide_id, max(level) AS m FROM fx_request GROUP BY slide_id))")
def bridged_levels(spark, sf):
    asked = fx(spark, sf, "fx_request").select("slide_id", "level")
    bridge = asked.groupBy("slide_id").agg(F.max("level").alias("m")).select("slide_id", F.explode(F.sequence(F.lit(0), F.col("m"))).alias("level"))
    return asked.union(bridge).distinct()
