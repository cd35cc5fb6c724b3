"""Queries over file headers by the rules of the file format."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import headers as H
from tessera.plans.fixtures import fx
from tessera.plans.registry import query

_REQUIRED = " AND ".join(f"{c} IS NOT NULL" for c in H.REQUIRED)
_OK = f"""sop_class = '1.2.840.10008.5.1.4.1.1.77.1.6' AND {_REQUIRED} AND image_type IN ('VOLUME', 'LABEL', 'OVERVIEW', 'THUMBNAIL') AND coalesce(representation, 0) = 0 AND coalesce(planar, 0) = 0
AND photometric IN ('MONOCHROME2', 'RGB', 'YBR_FULL', 'YBR_FULL_422', 'YBR_ICT', 'YBR_RCT', 'YBR_PARTIAL_420') AND (bits = 8 OR samples = 1)"""
_TILE = "CASE WHEN organization = 'TILED_FULL' THEN 'FULL' WHEN per_frame THEN 'SPARSE' WHEN image_type = 'LABEL' OR coalesce(n_frames, 1) = coalesce(planes, 1) * coalesce(paths, 1) THEN 'FULL' END"
_BASE = "SELECT DISTINCT ON (slide_id) slide_id, study_uid AS bs, frame_of_reference AS bf, tile_rows AS br, tile_columns AS bc FROM fx_file WHERE image_type = 'VOLUME' ORDER BY slide_id, total_columns DESC, total_rows DESC, file_id"
_MATCH = "SELECT f.slide_id, f.file_id, f.image_type, f.study_uid IS NOT DISTINCT FROM bs AND f.frame_of_reference IS NOT DISTINCT FROM bf AND (f.image_type <> 'VOLUME' OR (f.tile_rows = br AND f.tile_columns = bc)) AS matches FROM fx_file f JOIN b ON b.slide_id = f.slide_id"


def files(spark, sf):
    return fx(spark, sf, "fx_file")


@query("flt01_supported_files", f"SELECT file_id, image_type FROM fx_file WHERE {_OK}")
def supported_files(spark, sf):
    return files(spark, sf).where(H.supported()).select("file_id", "image_type")


@query("flt02_series_match", f"WITH b AS ({_BASE}) SELECT file_id, matches FROM ({_MATCH})")
def series_match(spark, sf):
    return H.series_match(files(spark, sf)).select("file_id", "matches")


@query("flt03_instance_match", f"""SELECT identifier, count(*) AS files, count(DISTINCT k) = 1 AS matches
FROM (SELECT coalesce(concat_uid, uid) AS identifier, concat_ws('|', coalesce(study_uid, '-'), series_uid, total_columns, total_rows, tile_rows, tile_columns, coalesce({_TILE}, '-'), coalesce(CAST(origin_x AS VARCHAR), '-'), coalesce(CAST(origin_y AS VARCHAR), '-'), coalesce(CAST(origin_z AS VARCHAR), '-')) AS k FROM fx_file) GROUP BY identifier""")
def instance_match(spark, sf):
    return H.instance_match(files(spark, sf))


@query("flt04_group_match", "SELECT slide_id, image_type, total_columns, count(DISTINCT concat_ws('|', coalesce(study_uid, '-'), coalesce(frame_of_reference, '-'), total_rows, tile_rows, tile_columns)) = 1 AS matches FROM fx_file GROUP BY ALL")
def group_match(spark, sf):
    return H.group_match(files(spark, sf))


_NOTES = "SELECT event_id AS annotation_id, CAST(FLOOR(event_id / 12) AS BIGINT) AS slide_id, CONCAT('1.9.', CAST(event_id AS VARCHAR(20))) AS annotation_uid, CASE WHEN event_id % 23 = 0 THEN '1.3.elsewhere' ELSE CONCAT('1.3.', CAST(FLOOR(event_id / 12) AS BIGINT)) END AS study_uid FROM events WHERE event_type = 'click'"


def _notes(spark, sf):
    return spark.sql(_NOTES.replace("FROM events", f"FROM parquet.`{sf}/events.parquet`"))


@query("flt05_violations", f"""WITH b AS ({_BASE}), m AS ({_MATCH}), a AS ({_NOTES})
SELECT 'duplicate' AS kind, uid AS id FROM fx_file GROUP BY slide_id, uid HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'series' AS kind, CAST(slide_id AS VARCHAR) || '/' || image_type AS id FROM m WHERE NOT matches
UNION ALL SELECT 'annotation' AS kind, annotation_uid AS id FROM a JOIN b ON b.slide_id = a.slide_id WHERE a.study_uid IS DISTINCT FROM b.bs""")
def violations(spark, sf):
    return H.violations(files(spark, sf), _notes(spark, sf))


@query("jn15_annotation_slide", f"WITH b AS ({_BASE}), a AS ({_NOTES}) SELECT a.annotation_id, b.bs IS NOT NULL AND a.study_uid = b.bs AS matches FROM a LEFT JOIN b ON b.slide_id = a.slide_id")
def annotation_slide(spark, sf):
    """Annotations by the identifiers of the slide that they were drawn on."""
    rows = files(spark, sf).where(F.col("image_type") == "VOLUME")
    base = rows.groupBy("slide_id").agg(F.max_by("study_uid", F.struct("total_columns", "total_rows", -F.col("file_id"))).alias("study"))
    return _notes(spark, sf).join(base, "slide_id", "left").select("annotation_id", F.coalesce(F.col("study_uid") == F.col("study"), F.lit(False)).alias("matches"))


@query("flt10_coordinate_match", "SELECT a.file_id AS a, b.file_id AS b FROM fx_file a JOIN fx_file b ON a.image_type = b.image_type AND a.rotation = b.rotation AND a.file_id < b.file_id AND sqrt(pow(a.origin_x - b.origin_x, 2) + pow(a.origin_y - b.origin_y, 2)) <= 0.02E0 WHERE a.slide_id = b.slide_id")
def coordinate_match(spark, sf):
    rows = files(spark, sf).where("origin_x is not null").select("file_id", "slide_id", "image_type", F.col("origin_x").alias("x"), F.col("origin_y").alias("y"), "rotation")
    return H.coordinates_match(rows, rows, ["slide_id", "image_type"]).where(F.col("l.file_id") < F.col("r.file_id")).select(F.col("l.file_id").alias("a"), F.col("r.file_id").alias("b"))


@query("prj01_tile_type", f"SELECT file_id, {_TILE} AS tile_type FROM fx_file")
def tile_type(spark, sf):
    return files(spark, sf).select("file_id", H.tile_type().alias("tile_type"))


@query("prj04_fallbacks", "SELECT file_id, coalesce(origin_z, shared_z, 0.0E0) AS z, coalesce(thickness, depth_mm / coalesce(planes, 1)) AS thickness, coalesce(focus_method, 'AUTO') AS focus_method, coalesce(n_frames, 1) AS n_frames, coalesce(planes, 1) AS planes, coalesce(paths, 1) AS paths FROM fx_file")
def fallbacks(spark, sf):
    one = [F.coalesce(c, F.lit(1)).alias(c) for c in ("n_frames", "planes", "paths")]
    return files(spark, sf).select("file_id", H.z_offset().alias("z"), H.slice_thickness().alias("thickness"), F.coalesce("focus_method", F.lit("AUTO")).alias("focus_method"), *one)


@query("prj05_identifier", "SELECT file_id, coalesce(concat_uid, uid) AS identifier, CASE WHEN concat_uid IS NULL THEN 0 ELSE concat_offset END AS frame_offset, concat_uid IS NOT NULL AND concat_offset IS NULL AS error FROM fx_file")
def identifier(spark, sf):
    return files(spark, sf).select("file_id", H.identifier().alias("identifier"), H.frame_offset().alias("frame_offset"), H.frame_offset().isNull().alias("error"))


@query("prj06_extended_depth", "SELECT file_id, coalesce(ext_dof = 'YES', false) AS extended, CASE WHEN ext_dof = 'YES' THEN coalesce(ext_planes, 1) END AS planes, CASE WHEN ext_dof = 'YES' THEN coalesce(ext_distance, 0.0E0) END AS distance FROM fx_file")
def extended_depth(spark, sf):
    return files(spark, sf).select("file_id", H.extended_depth().alias("e")).select("file_id", F.col("e").isNotNull().alias("extended"), "e.planes", "e.distance")


_PYRAMID_SQL = """WITH RECURSIVE o AS (SELECT slide_id, uid, CASE WHEN origin_x IS NOT NULL THEN {'x': origin_x, 'y': origin_y, 'r': rotation} END AS pos,
  CASE WHEN ext_dof = 'YES' THEN CAST(coalesce(ext_planes, 1) AS VARCHAR) || '/' || CAST(coalesce(ext_distance, 0.0E0) AS VARCHAR) END AS ext, row_number() OVER (PARTITION BY slide_id ORDER BY total_columns DESC, total_rows DESC, uid) AS n
  FROM (SELECT DISTINCT ON (slide_id, uid) * FROM fx_file WHERE image_type = 'VOLUME' ORDER BY slide_id, uid, file_id)),
r AS (SELECT slide_id, uid, n, CAST(0 AS BIGINT) AS pyramid, [{'pos': pos, 'ext': ext, 'm': [pos]}] AS g FROM o WHERE n = 1
UNION ALL
SELECT slide_id, uid, n, coalesce(p, len(g) + 1) - 1 AS pyramid, CASE WHEN p IS NULL THEN list_append(g, {'pos': pos, 'ext': ext, 'm': [pos]})
  ELSE list_transform(g, lambda x, k: CASE WHEN k = p THEN {'pos': x.pos, 'ext': x.ext, 'm': list_append(x.m, pos)} ELSE x END) END AS g
FROM (SELECT o.slide_id, o.uid, o.n, o.pos, o.ext, r.g, coalesce(
    list_position(list_transform(r.g, lambda x: x.ext IS NOT DISTINCT FROM o.ext AND o.pos IS NOT NULL AND len(list_filter(x.m, lambda m: coalesce(m.r = o.pos.r AND sqrt(pow(m.x - o.pos.x, 2) + pow(m.y - o.pos.y, 2)) <= 0.02E0, false))) = len(x.m)), true),
    list_position(list_transform(r.g, lambda x: x.ext IS NOT DISTINCT FROM o.ext AND x.pos IS NOT DISTINCT FROM o.pos), true)) AS p
  FROM r JOIN o ON o.slide_id = r.slide_id AND o.n = r.n + 1))
SELECT slide_id, uid, pyramid FROM r"""


def _instances(spark, sf):
    rows = files(spark, sf).where(F.col("image_type") == "VOLUME")
    first = rows.groupBy("slide_id", "uid").agg(F.min_by(F.struct(F.col("total_columns").alias("width"), F.col("total_rows").alias("height"), F.col("origin_x").alias("x"), F.col("origin_y").alias("y"), "rotation", H.extended_depth().alias("ext")), "file_id").alias("f"))
    return first.select("slide_id", "uid", "f.*")


@query("agg03_pyramids", _PYRAMID_SQL)
def pyramids(spark, sf):
    return H.pyramids(_instances(spark, sf))


@query("jn07_pyramid_members", f"SELECT slide_id, pyramid, count(*) AS members FROM ({_PYRAMID_SQL}) GROUP BY ALL")
def pyramid_members(spark, sf):
    """How many instances each pyramid has: a conditional join of each instance with the pyramids before it."""
    return H.pyramids(_instances(spark, sf)).groupBy("slide_id", "pyramid").agg(F.count("*").alias("members"))


@query("agg07_full_planes", """SELECT file_id, plane FROM (SELECT DISTINCT file_id, round_even(z + k * s * 1000, 3) AS plane FROM
  (SELECT file_id, coalesce(origin_z, shared_z, 0.0E0) AS z, coalesce(spacing_between, 0.0E0) AS s, unnest(generate_series(0, coalesce(planes, 1) - 1)) AS k FROM fx_file WHERE coalesce(planes, 1) = 1 OR spacing_between > 0))""")
def full_planes(spark, sf):
    planes = H.full_planes(F.col("spacing_between"), H.z_offset(), F.coalesce("planes", F.lit(1)))
    return files(spark, sf).select("file_id", F.explode(planes).alias("plane"))


@query("agg13_sparse_grid", """WITH p AS (SELECT slide_id, path, list_sort(list(DISTINCT z)) AS planes FROM fx_sparse_frame GROUP BY slide_id, path),
q AS (SELECT slide_id, path, planes FROM p UNION ALL SELECT slide_id, 'B', CASE WHEN slide_id % 3 = 0 THEN planes[1:1] ELSE planes END FROM p)
SELECT slide_id, bool_or(planes <> first_planes) AS sparse FROM (SELECT *, first_value(planes) OVER (PARTITION BY slide_id ORDER BY path) AS first_planes FROM q) GROUP BY slide_id""")
def sparse_grid(spark, sf):
    """Whether a path has other planes than the first path."""
    planes = fx(spark, sf, "fx_sparse_frame").groupBy("slide_id", "path").agg(F.array_sort(F.collect_set("z")).alias("planes"))
    second = planes.select("slide_id", F.lit("B").alias("path"), F.when(F.col("slide_id") % 3 == 0, F.slice("planes", 1, 1)).otherwise(F.col("planes")).alias("planes"))
    both = planes.unionByName(second).groupBy("slide_id").agg(F.min_by("planes", "path").alias("first"), F.collect_set("planes").alias("each"))
    return both.select("slide_id", F.exists("each", lambda p: p != F.col("first")).alias("sparse"))


@query("win06_previous_specimen", "SELECT o, s, lag(s) OVER (PARTITION BY o ORDER BY m, s) AS previous FROM (SELECT l_orderkey AS o, 'S' || CAST(l_suppkey % 5 AS VARCHAR) AS s, min(l_linenumber) AS m FROM lineitem GROUP BY 1, 2)")
def previous_specimen(spark, sf):
    """Specimens of a slide (here an order) in the order in which their steps are met."""
    steps = fx(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.concat(F.lit("S"), (F.col("l_suppkey") % 5).cast("string")).alias("s"), "l_linenumber").count()
    return H.previous_in_order(steps, "o", "l_linenumber", "s")


@query("snk07_equal_spacing", """WITH p AS (SELECT slide_id, list_sort(list(DISTINCT z)) AS z FROM (SELECT slide_id, z + CASE WHEN slide_id % 4 = 1 THEN z * z WHEN slide_id % 4 = 2 THEN z * 2e-7 ELSE 0 END AS z FROM fx_sparse_frame) GROUP BY slide_id)
SELECT slide_id, len(list_filter(generate_series(1, len(z) - 1), lambda i: abs((z[2] - z[1]) - (z[i + 1] - z[i])) > 1e-6)) = 0 AS equal FROM p""")
def equal_spacing(spark, sf):
    """Each step against the first one."""
    bent = F.col("z") + F.when(F.col("slide_id") % 4 == 1, F.col("z") * F.col("z")).when(F.col("slide_id") % 4 == 2, F.col("z") * 2e-7).otherwise(0)
    planes = fx(spark, sf, "fx_sparse_frame").groupBy("slide_id").agg(F.collect_set(bent).alias("z"))
    return planes.select("slide_id", H.equally_spaced(F.col("z")).alias("equal"))


_KEYS = ("photometric", "syntax", "extended", "ext_planes", "ext_distance", "focus_method")


@query("snk08_shared_files", "SELECT slide_id, photometric, syntax, extended, ext_planes, ext_distance, focus_method, count(*) AS files FROM (SELECT slide_id, photometric, syntax, coalesce(ext_dof = 'YES', false) AS extended, CASE WHEN ext_dof = 'YES' THEN coalesce(ext_planes, 1) END AS ext_planes, CASE WHEN ext_dof = 'YES' THEN coalesce(ext_distance, 0.0E0) END AS ext_distance, coalesce(focus_method, 'AUTO') AS focus_method FROM fx_file) GROUP BY ALL")
def shared_files(spark, sf):
    """Instances that can share a file: equal in what a file has once."""
    rows = files(spark, sf).withColumn("e", H.extended_depth())
    rows = rows.select("slide_id", "photometric", "syntax", F.col("e").isNotNull().alias("extended"), F.col("e.planes").alias("ext_planes"), F.col("e.distance").alias("ext_distance"), F.coalesce("focus_method", F.lit("AUTO")).alias("focus_method"))
    return rows.groupBy("slide_id", *_KEYS).agg(F.count("*").alias("files"))


@query("snk06_buckets", """WITH i AS (SELECT slide_id, uid, path_no, n_planes, CASE slide_id % 4 WHEN 0 THEN 'NONE' WHEN 1 THEN 'PATH' WHEN 2 THEN 'PLANE' ELSE 'BOTH' END AS split FROM fx_instance)
SELECT slide_id, CASE WHEN split IN ('PATH', 'BOTH') THEN path_no END AS path_no, CASE WHEN split IN ('PLANE', 'BOTH') THEN n_planes END AS n_planes, count(*) AS n FROM i GROUP BY ALL""")
def split_buckets(spark, sf):
    """Which instances go to one output instance: split by path, by plane, by both or not at all."""
    kinds = F.array(F.lit("NONE"), F.lit("PATH"), F.lit("PLANE"), F.lit("BOTH"))
    rows = fx(spark, sf, "fx_instance").withColumn("split", F.element_at(kinds, (F.col("slide_id") % 4 + 1).cast("int")))
    path, plane = F.when(F.col("split").isin("PATH", "BOTH"), F.col("path_no")), F.when(F.col("split").isin("PLANE", "BOTH"), F.col("n_planes"))
    return rows.groupBy("slide_id", path.alias("path_no"), plane.alias("n_planes")).agg(F.count("*").alias("n"))


@query("snk16_offset_table_kind", "SELECT file_id, CASE WHEN syntax = '1.2.840.10008.1.2.1' THEN 'NONE' WHEN file_id % 2 = 0 AND total_columns * total_rows * 700 > 4294967295 THEN 'EXTENDED' WHEN file_id % 2 = 0 THEN 'BASIC' ELSE 'EXTENDED' END AS kind FROM fx_file")
def offset_table_kind(spark, sf):
    wanted = F.when(F.col("file_id") % 2 == 0, "BASIC").otherwise("EXTENDED")
    return files(spark, sf).select("file_id", H.offset_table(F.col("syntax"), wanted, F.col("total_columns") * F.col("total_rows") * 700).alias("kind"))


@query("src19_index_order", "SELECT file_id, CASE WHEN syntax = '1.2.840.10008.1.2.1' THEN 'native' WHEN bits = 16 THEN 'extended' WHEN total_rows % 3 > 0 THEN 'basic' WHEN per_frame THEN 'tiff' ELSE 'items' END AS kind FROM fx_file")
def index_order(spark, sf):
    return files(spark, sf).select("file_id", H.frame_index_kind(F.col("syntax"), F.coalesce(F.col("bits") == 16, F.lit(False)), F.col("total_rows") % 3, F.col("per_frame")).alias("kind"))


@query("snk19_header_rewrite", """SELECT file_id, scale, 'TILED_FULL' AS organization, greatest(CAST(ceil(total_columns / scale) AS BIGINT), 1) AS total_columns, greatest(CAST(ceil(total_rows / scale) AS BIGINT), 1) AS total_rows, spacing * scale AS spacing, CAST(p AS BIGINT) AS planes, CAST(1 AS BIGINT) AS paths,
  greatest(CAST(ceil(ceil(total_columns / 256) / scale) * ceil(ceil(total_rows / 256) / scale) AS BIGINT), 1) * p AS n_frames, CASE WHEN coalesce(paths, 1) = 2 THEN '1' ELSE '0' END AS path_ids, CASE WHEN p > 1 THEN (1.5E0 - 0.5E0) / 1000 END AS spacing_between, 0.5E0 AS origin_z
FROM (SELECT *, CASE WHEN coalesce(planes, 1) > 1 THEN 2 ELSE 1 END AS p, CAST(unnest([1, 2, 4]) AS BIGINT) AS scale FROM fx_file)""")
def header_rewrite(spark, sf):
    """A level written as fully tiled at scales 1, 2 and 4, with one of its paths and at most two of its planes."""
    rows = files(spark, sf).withColumn("path_ids", F.transform(F.sequence(F.lit(0).cast("bigint"), F.coalesce("paths", F.lit(1)).cast("bigint") - 1), lambda k: k.cast("string")))
    planes = F.when(F.coalesce("planes", F.lit(1)) > 1, F.array(F.lit(0.5), F.lit(1.5))).otherwise(F.array(F.lit(0.5)))
    rows = rows.withColumn("scale", F.explode(F.array(*[F.lit(s).cast("bigint") for s in (1, 2, 4)])))
    tiles = [F.ceil(F.col(c) / 256) for c in ("total_columns", "total_rows")]
    out = rows.select("file_id", "scale", *H.rewritten(F.col("scale"), planes, F.array(F.lit("1")), *tiles))
    return out.withColumn("path_ids", F.array_join("path_ids", ","))


@query("snk20_compression_history", """SELECT file_id, scale, CASE WHEN syntax = '1.2.840.10008.1.2.4.50' THEN (CASE WHEN scale = 1 AND photometric = 'YBR_FULL_422' THEN 'OLD,' ELSE '' END) || 'ISO_10918_1' WHEN photometric = 'YBR_FULL_422' THEN 'OLD' ELSE '' END AS methods,
  CASE WHEN syntax = '1.2.840.10008.1.2.4.50' THEN (CASE WHEN scale = 1 AND photometric = 'YBR_FULL_422' THEN '7.5,' ELSE '' END) || CAST(tile_rows AS VARCHAR) WHEN photometric = 'YBR_FULL_422' THEN '7.5' ELSE '' END AS ratios
FROM (SELECT *, CAST(unnest([1, 2]) AS BIGINT) AS scale FROM fx_file)""")
def compression_history(spark, sf):
    """Methods and ratios after encoding; a lossless one changes nothing, a smaller image starts anew."""
    had = F.col("photometric") == "YBR_FULL_422"
    rows = files(spark, sf).withColumns({"methods": F.when(had, F.array(F.lit("OLD"))), "ratios": F.when(had, F.array(F.lit("7.5")))}).withColumn("scale", F.explode(F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"))))
    method = F.when(F.col("syntax") == "1.2.840.10008.1.2.4.50", "ISO_10918_1")
    out = rows.select("file_id", "scale", *H.compressed_again(method, F.col("tile_rows").cast("string"), F.col("scale")))
    return out.withColumns({c: F.array_join(c, ",") for c in ("methods", "ratios")})


_HEADER = ("study_uid", "photometric", "organization", "focus_method", "thickness")


@query("snk21_header_overlay", "SELECT file_id, CASE WHEN file_id % 3 = 0 THEN '1.3.new' ELSE study_uid END AS study_uid, photometric, coalesce(CASE WHEN file_id % 3 = 0 THEN 'TILED_FULL' END, organization) AS organization, coalesce(CASE WHEN file_id % 2 = 0 THEN 'MANUAL' END, focus_method) AS focus_method, coalesce(CASE WHEN file_id % 3 = 0 THEN 0.5E0 END, thickness) AS thickness FROM fx_file")
def header_overlay(spark, sf):
    """A header with the values that new metadata has; what it leaves out stays."""
    third, even = F.col("file_id") % 3 == 0, F.col("file_id") % 2 == 0
    new = F.struct(F.when(third, "1.3.new").alias("study_uid"), F.lit(None).cast("string").alias("photometric"), F.when(third, "TILED_FULL").alias("organization"), F.when(even, "MANUAL").alias("focus_method"), F.when(third, 0.5).alias("thickness"))
    return files(spark, sf).withColumn("new", new).select("file_id", *H.overlaid(list(_HEADER), "new"))


@query("snk22_transcode", """SELECT file_id, CASE WHEN (forced OR syntax <> '1.2.840.10008.1.2.4.50') AND wants THEN CASE WHEN bits = 8 AND samples = 3 THEN 'encode 1.2.840.10008.1.2.4.50' ELSE 'error' END
  WHEN syntax = '1.2.840.10008.1.2.5' THEN 'encode 1.2.840.10008.1.2.1' ELSE 'copy ' || syntax END AS action FROM (SELECT *, file_id % 5 = 0 AS forced, file_id % 3 > 0 AS wants FROM fx_file WHERE bits IS NOT NULL)""")
def transcode(spark, sf):
    """Frames are copied unless another syntax is wanted, encoding is forced, or their source can't give them encoded."""
    coder = lambda syntax, bits, samples: F.struct(F.lit(syntax).alias("syntax"), bits.cast("int").alias("bits"), samples.cast("int").alias("samples"))
    wanted = F.when(F.col("file_id") % 3 > 0, coder("1.2.840.10008.1.2.4.50", F.lit(8), F.lit(3)))
    own = F.when(F.col("syntax") == "1.2.840.10008.1.2.5", coder("1.2.840.10008.1.2.1", F.col("bits"), F.col("samples")))
    return files(spark, sf).where("bits is not null").select("file_id", H.transcoding(F.col("file_id") % 5 == 0, wanted, own).alias("action"))


@query("src10_negotiated_syntax", "SELECT slide_id, list_filter(['1.2.840.10008.1.2.4.90', '1.2.840.10008.1.2.4.50', '1.2.840.10008.1.2.5', '1.2.840.10008.1.2.1'], lambda s: list_contains(offered, s) AND s <> '1.2.840.10008.1.2.4.90')[1] AS syntax FROM (SELECT slide_id, list(DISTINCT syntax) AS offered FROM fx_file GROUP BY slide_id)")
def negotiated_syntax(spark, sf):
    """Of the syntaxes in order of preference, the first that the slide's files offer and that can be decoded."""
    wanted = F.array(*[F.lit(f"1.2.840.10008.1.2{s}") for s in (".4.90", ".4.50", ".5", ".1")])
    decodable = F.array(*[F.lit(f"1.2.840.10008.1.2{s}") for s in (".1", ".5", ".4.50")])
    offered = files(spark, sf).groupBy("slide_id").agg(F.collect_set("syntax").alias("offered"))
    return offered.select("slide_id", F.get(F.array_intersect(F.array_intersect(wanted, F.col("offered")), decodable), 0).alias("syntax"))


@query("set06_syntax_intersection", "SELECT a.slide_id, count(b.syntax) AS n FROM (SELECT DISTINCT slide_id, syntax FROM fx_file) a LEFT JOIN (SELECT DISTINCT slide_id - 1 AS slide_id, syntax FROM fx_file) b ON a.slide_id = b.slide_id AND a.syntax = b.syntax GROUP BY a.slide_id")
def syntax_intersection(spark, sf):
    """Syntaxes that a slide has in common with the next one."""
    own = files(spark, sf).groupBy("slide_id").agg(F.collect_set("syntax").alias("own"))
    following = own.select((F.col("slide_id") - 1).alias("slide_id"), F.col("own").alias("other"))
    return own.join(following, "slide_id", "left").select("slide_id", F.coalesce(F.size(F.array_intersect("own", "other")), F.lit(0)).cast("bigint").alias("n"))


@query("jn14_kept_paths", """WITH f AS (SELECT file_id, CASE WHEN coalesce(paths, 1) = 2 THEN ['0', '1'] ELSE ['0'] END AS own, CASE file_id % 3 WHEN 0 THEN ['1'] WHEN 1 THEN ['0', '7'] ELSE ['9'] END AS kept FROM fx_file)
SELECT file_id, array_to_string(CASE WHEN len(list_filter(own, lambda p: list_contains(kept, p))) > 0 THEN list_filter(own, lambda p: list_contains(kept, p)) ELSE own END, ',') AS paths FROM f""")
def kept_paths(spark, sf):
    """The optical paths that are asked for; all, if none of them is there."""
    own = F.when(F.coalesce("paths", F.lit(1)) == 2, F.array(F.lit("0"), F.lit("1"))).otherwise(F.array(F.lit("0")))
    kept = F.when(F.col("file_id") % 3 == 0, F.array(F.lit("1"))).when(F.col("file_id") % 3 == 1, F.array(F.lit("0"), F.lit("7"))).otherwise(F.array(F.lit("9")))
    some = F.filter(own, lambda p: F.array_contains(kept, p))
    return files(spark, sf).select("file_id", F.array_join(F.when(F.size(some) > 0, some).otherwise(own), ",").alias("paths"))


@query("geo13_centred_origin", """SELECT file_id, round(25.0E0 / 2 + sx * across / 2, 6) AS x, round(54.0E0 / 2 + sy * along / 2, 6) AS y FROM (SELECT file_id, CASE rotation WHEN 0 THEN total_rows WHEN 180 THEN total_rows ELSE total_columns END * 0.00025E0 AS across,
  CASE rotation WHEN 0 THEN total_columns WHEN 180 THEN total_columns ELSE total_rows END * 0.00025E0 AS along, CASE WHEN rotation IN (0, 270) THEN -1 ELSE 1 END AS sx, CASE WHEN rotation IN (0, 90) THEN -1 ELSE 1 END AS sy FROM fx_file WHERE rotation IS NOT NULL)""")
def centred_origin(spark, sf):
    """Origin of an image that lies in the middle of the slide: its first pixel's corner, as the rotation turns it."""
    upright = F.col("rotation").isin(0.0, 180.0)
    across = F.when(upright, F.col("total_rows")).otherwise(F.col("total_columns")) * 0.00025
    along = F.when(upright, F.col("total_columns")).otherwise(F.col("total_rows")) * 0.00025
    sx, sy = (F.when(F.col("rotation").isin(*r), -1).otherwise(1) for r in ((0.0, 270.0), (0.0, 90.0)))
    return files(spark, sf).where("rotation is not null").select("file_id", F.round(12.5 + sx * across / 2, 6).alias("x"), F.round(27.0 + sy * along / 2, 6).alias("y"))


@query("src23_readiness", f"SELECT slide_id, bool_and(coalesce({_TILE}, '') = 'FULL' AND (syntax = '1.2.840.10008.1.2.1' OR total_rows % 3 > 0)) AS ready FROM fx_file WHERE {_OK} GROUP BY slide_id")
def readiness(spark, sf):
    """Whether all files of a slide are fully tiled and have a table of offsets (or need none)."""
    kind = H.frame_index_kind(F.col("syntax"), F.lit(False), F.col("total_rows") % 3, F.lit(False))
    ready = (F.coalesce(H.tile_type(), F.lit("")) == "FULL") & kind.isin("native", "basic", "extended")
    return files(spark, sf).where(H.supported()).groupBy("slide_id").agg(F.bool_and(ready).alias("ready"))


@query("src03_class_filter", "SELECT file_id, sop_class FROM fx_file WHERE planes IS NOT NULL AND sop_class = '1.2.840.10008.5.1.4.1.1.77.1.6'")
def class_filter(spark, sf):
    """Streams that begin with a preamble, and of those the ones of the slide class."""
    mark = F.when(F.col("planes").isNotNull(), "DICM").otherwise("%PDF")
    stream = F.concat(F.repeat(F.lit("\0"), 128), mark, F.col("sop_class")).cast("binary")
    rows = files(spark, sf).select("file_id", stream.alias("content"))
    is_file = F.substring("content", 129, 4) == F.lit(b"DICM")
    return rows.where(is_file).select("file_id", F.substring("content", 133, 64).cast("string").alias("sop_class")).where(F.col("sop_class") == H.SLIDE_CLASS)


@query("snk03_writer_plan", f"""SELECT slide_id, CASE image_type WHEN 'VOLUME' THEN 'pyramid' ELSE lower(image_type) END AS kind, CAST(CASE WHEN image_type = 'VOLUME' THEN total_columns ELSE file_id END AS BIGINT) AS grp, count(*) AS files, CASE image_type WHEN 'VOLUME' THEN 0 WHEN 'THUMBNAIL' THEN 1 WHEN 'OVERVIEW' THEN 2 ELSE 3 END AS turn
FROM fx_file WHERE {_OK} GROUP BY ALL""")
def writer_plan(spark, sf):
    """What is written, in which order: the levels of the pyramids, thumbnails, overviews, labels."""
    volume = F.col("image_type") == "VOLUME"
    kind = F.when(volume, "pyramid").otherwise(F.lower("image_type"))
    turn = F.array_position(F.array(*[F.lit(k) for k in ("VOLUME", "THUMBNAIL", "OVERVIEW", "LABEL")]), F.col("image_type")) - 1
    group = F.when(volume, F.col("total_columns")).otherwise(F.col("file_id")).cast("bigint")
    return files(spark, sf).where(H.supported()).groupBy("slide_id", kind.alias("kind"), group.alias("grp"), turn.cast("int").alias("turn")).agg(F.count("*").alias("files"))


@query("src04_split_by_kind", f"SELECT slide_id, " + ", ".join(f"CAST(sum(CASE WHEN image_type = '{k.upper()}' THEN 1 ELSE 0 END) AS BIGINT) AS {k}s" for k in ("volume", "label", "overview", "thumbnail")) + f" FROM fx_file WHERE {_OK} GROUP BY slide_id")
def split_by_kind(spark, sf):
    kinds = [F.count_if(F.col("image_type") == k.upper()).alias(k + "s") for k in ("volume", "label", "overview", "thumbnail")]
    return files(spark, sf).where(H.supported()).groupBy("slide_id").agg(*kinds)
