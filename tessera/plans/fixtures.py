"""Slide-shaped projections of the driver's tables, the same text for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

VIEWS: dict[str, str] = {
    "fx_level": """SELECT slide_id, level, CAST(CEIL(bw / POWER(2, level)) AS BIGINT) AS width, CAST(CEIL(bh / POWER(2, level)) AS BIGINT) AS height,
       256 AS tile_w, 256 AS tile_h, CAST(0.00025E0 * POWER(2, level) AS DOUBLE) AS spacing_x, 1 + slide_id % 3 AS n_planes, 1 + slide_id % 2 AS n_paths
FROM (SELECT slide_id, level, 1024 + (slide_id * 977) % 7168 AS bw, 768 + (slide_id * 613) % 5120 AS bh
      FROM (SELECT CAST(FLOOR(p_partkey / 4) AS BIGINT) AS slide_id, CAST(p_partkey % 4 AS INT) AS level FROM part) a) b""",
    "fx_sparse_frame": """SELECT e.slide_id, e.frame_no, 1 + (e.lin % e.tx) * 256 AS col_pos, 1 + CAST(FLOOR(e.lin / e.tx) AS BIGINT) * 256 AS row_pos,
       CAST((e.frame_no % e.n_planes) * 1.5E0 AS DOUBLE) AS z, CAST('0' AS VARCHAR(1)) AS path
FROM (SELECT l.slide_id, CAST(FLOOR(v.event_id / 50) AS BIGINT) AS frame_no, l.n_planes, CAST(CEIL(l.width / 256) AS BIGINT) AS tx,
             (v.event_id * 7919) % (CAST(CEIL(l.width / 256) AS BIGINT) * CAST(CEIL(l.height / 256) AS BIGINT)) AS lin
      FROM events v JOIN fx_level l ON l.slide_id = v.event_id % 50 AND l.level = 0) e""",
    "fx_concat_file": """SELECT identifier, part, n_frames, CAST(COALESCE(SUM(n_frames) OVER (PARTITION BY identifier ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS frame_offset
FROM (SELECT s_suppkey % 20 AS identifier, CAST(FLOOR(s_suppkey / 20) AS BIGINT) AS part, 1 + s_suppkey % 17 AS n_frames FROM supplier) s""",
    "fx_frame_len": "SELECT event_id % 20 AS identifier, CAST(FLOOR(event_id / 20) AS BIGINT) AS frame_index, 2 * (1 + CAST(FLOOR(value) AS BIGINT) % 500) AS byte_len FROM events",
    "fx_vertex": "SELECT CAST(FLOOR(event_id / 5) AS BIGINT) AS annotation_id, event_id % 5 AS ordinal, CAST(FLOOR(event_id / 5) AS BIGINT) % 10 AS group_id, value AS x, CAST((event_id % 997) * 0.5E0 AS DOUBLE) AS y FROM events",
    "fx_measurement": "SELECT CAST(FLOOR(event_id / 5) AS BIGINT) AS annotation_id, event_id % 5 AS ordinal, event_type AS code, 'um' AS unit, value FROM events",
    "fx_specimen_edge": """SELECT CONCAT('N', CAST(n_nationkey AS VARCHAR(20))) AS child, CONCAT('R', CAST(n_regionkey AS VARCHAR(20))) AS parent FROM nation
UNION ALL SELECT CONCAT('S', CAST(s_suppkey AS VARCHAR(20))), CONCAT('N', CAST(s_nationkey AS VARCHAR(20))) FROM supplier""",
    "fx_identifier": "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN s_name WHEN 1 THEN CONCAT(s_name, '^1.2.3^ISO') WHEN 2 THEN '^example.org^DNS' ELSE '' END AS issuer FROM supplier",
    # texts of headers, one a customer, as files have them
    "fx_record": """SELECT c_custkey AS file_id, CONCAT('1.3.', CAST(c_custkey AS VARCHAR(20))) AS study_uid, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CONCAT('T', CAST(c_custkey % 50 AS VARCHAR(20))) END AS study_id, CONCAT('2024', CASE WHEN c_custkey % 2 = 0 THEN '02' ELSE '11' END, CAST(10 + c_custkey % 19 AS VARCHAR(20))) AS study_date,
       CONCAT(CAST(10 + c_custkey % 13 AS VARCHAR(20)), CAST(10 + c_custkey % 49 AS VARCHAR(20)), CAST(10 + c_custkey % 47 AS VARCHAR(20)), CASE WHEN c_custkey % 3 = 0 THEN '.250000' ELSE '' END) AS study_time, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CONCAT('A', CAST(c_custkey AS VARCHAR(20))) END AS accession_number,
       CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'House^Gregory' END AS referring_physician, CONCAT('1.4.', CAST(c_custkey AS VARCHAR(20))) AS series_uid, CAST(c_custkey % 9 AS INT) AS series_number,
       CASE c_custkey % 4 WHEN 0 THEN CONCAT(c_mktsegment, '^', c_name) WHEN 1 THEN c_mktsegment WHEN 2 THEN CONCAT(c_mktsegment, '^Ann^Lee^^Jr') ELSE CONCAT('^', c_name) END AS patient_name, CAST(c_nationkey AS VARCHAR(20)) AS patient_id, CONCAT(CAST(1940 + c_custkey % 60 AS VARCHAR(20)), '0', CAST(1 + c_custkey % 9 AS VARCHAR(20)), '17') AS birth_date,
       CASE c_custkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'M' ELSE 'O' END AS sex, CASE WHEN c_custkey % 2 = 0 THEN 'NO' ELSE NULL END AS identity_removed, c_mktsegment AS manufacturer, 'model 1' AS model, CAST(c_custkey AS VARCHAR(20)) AS serial, CASE WHEN c_custkey % 7 = 0 THEN 'v1\v2' ELSE 'v1' END AS software,
       CONCAT('202402', CAST(10 + c_custkey % 19 AS VARCHAR(20)), '153000.', CASE WHEN c_custkey % 2 = 0 THEN '500000' ELSE '000000' END) AS acquired, 'VOLUME' AS image_type, CASE WHEN c_custkey % 3 = 1 THEN 'MANUAL' ELSE NULL END AS focus_method, CAST(0.00025E0 * (1 + c_custkey % 4) AS DOUBLE) AS spacing_x, CASE WHEN c_custkey % 5 < 2 THEN '01' ELSE '00' END AS lossy,
       CAST(c_custkey % 2 AS VARCHAR(20)) AS path_id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'brightfield' END AS path_description, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE '111744^DCM^Brightfield illumination' END AS illumination FROM customer""",
    # samplings: slide samples from sections from blocks from specimens, some from two, some limited to one way up
    "fx_sampling": """SELECT CONCAT(child, '<', parent) AS sampling, child, parent, ordinal, CASE WHEN follows_no IS NOT NULL AND substring(child, 1, 1) = 'S' THEN CONCAT(parent, '<B', CAST(follows_no AS VARCHAR(20))) ELSE NULL END AS follows,
       CASE WHEN follows_no IS NULL THEN NULL WHEN follows_no % 7 = 0 THEN 'P999' ELSE CONCAT('B', CAST(follows_no AS VARCHAR(20))) END AS constraint_source
FROM (SELECT CONCAT('S', CAST(o_orderkey AS VARCHAR(20))) AS child, CONCAT('C', CAST(o_orderkey % 300 AS VARCHAR(20))) AS parent, CAST(0 AS BIGINT) AS ordinal, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 300 % 60 ELSE NULL END AS follows_no FROM orders
UNION ALL SELECT CONCAT('S', CAST(o_orderkey AS VARCHAR(20))), CONCAT('C', CAST((o_orderkey + 1) % 300 AS VARCHAR(20))), CAST(1 AS BIGINT), NULL FROM orders WHERE o_orderkey % 4 = 0
UNION ALL SELECT DISTINCT CONCAT('C', CAST(s_suppkey % 300 AS VARCHAR(20))), CONCAT('B', CAST(s_suppkey % 300 % 60 AS VARCHAR(20))), CAST(0 AS BIGINT), CAST(NULL AS BIGINT) FROM supplier
UNION ALL SELECT DISTINCT CONCAT('C', CAST(s_suppkey % 300 AS VARCHAR(20))), CONCAT('B', CAST((s_suppkey % 300 + 7) % 60 AS VARCHAR(20))), CAST(1 AS BIGINT), CAST(NULL AS BIGINT) FROM supplier WHERE s_suppkey % 300 % 5 = 0
UNION ALL SELECT DISTINCT CONCAT('B', CAST(n_nationkey AS VARCHAR(20))), CONCAT('P', CAST(n_nationkey % 10 AS VARCHAR(20))), CAST(0 AS BIGINT), CAST(NULL AS BIGINT) FROM nation
UNION ALL SELECT DISTINCT CONCAT('B', CAST(n_nationkey AS VARCHAR(20))), CONCAT('P', CAST((n_nationkey + 3) % 10 AS VARCHAR(20))), CAST(1 AS BIGINT), CAST(NULL AS BIGINT) FROM nation WHERE n_nationkey % 10 = 0) x""",
    # headers of instances: one for each slide, level and plane set, some of which share a pyramid
    "fx_instance": """SELECT l.slide_id, l.level, k AS ordinal, CONCAT('1.2.', CAST(l.slide_id AS VARCHAR(20)), '.', CAST(l.level AS VARCHAR(4)), '.', CAST(k AS VARCHAR(4))) AS uid, l.width, l.height, l.spacing_x,
       1 + (l.slide_id + k) % 3 AS n_planes, CAST((l.slide_id % 5) * 0.015E0 AS DOUBLE) AS origin_x, CAST(k % 2 AS INT) AS path_no, CASE WHEN (l.slide_id + k) % 7 = 0 THEN 'YES' ELSE 'NO' END AS ext_dof
FROM fx_level l CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) x""",
    # header fields as files have them, with the faults that a scan must reject
    "fx_header": """SELECT event_id AS file_id, event_id % 200 AS slide_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE CONCAT('1.3.', CAST(event_id % 200 AS VARCHAR(20))) END AS study_uid,
       CASE event_id % 5 WHEN 0 THEN 'VOLUME' WHEN 1 THEN 'LABEL' WHEN 2 THEN 'OVERVIEW' WHEN 3 THEN 'THUMBNAIL' ELSE 'OTHER' END AS image_type,
       CASE event_id % 3 WHEN 0 THEN 'RGB' WHEN 1 THEN 'YBR_FULL_422' ELSE 'MONOCHROME2' END AS photometric, CASE WHEN event_id % 3 = 2 THEN 1 ELSE 3 END AS samples, CASE WHEN event_id % 4 = 0 THEN 16 ELSE 8 END AS bits,
       256 AS tile_size, 256 * (1 + event_id % 9) AS total_columns, 256 * (1 + event_id % 7) AS total_rows, 1 + event_id % 63 AS n_frames, CASE event_id % 4 WHEN 0 THEN 'TILED_FULL' WHEN 1 THEN 'TILED_SPARSE' ELSE NULL END AS organization,
       1 + event_id % 2 AS planes, 1 + event_id % 2 AS paths, CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(event_id % 6 AS DOUBLE) * 0.5E0 END AS z_offset, CASE WHEN event_id % 9 = 0 THEN CONCAT('1.4.', CAST(event_id % 50 AS VARCHAR(20))) ELSE NULL END AS concat_uid,
       CONCAT('1.5.', CAST(event_id % 9000 AS VARCHAR(20))) AS uid, value AS amount, CASE WHEN event_id % 8 = 0 THEN -1.0E0 ELSE 0.00025E0 * (1 + event_id % 4) END AS spacing
FROM events""",
    # headers of slide files as a scan finds them: twelve files a slide, with values missing and wrong here and there
    "fx_file": """SELECT event_id AS file_id, slide AS slide_id, CASE WHEN b % 41 = 0 THEN NULL WHEN b % 37 = 0 THEN '1.3.other' ELSE CONCAT('1.3.', CAST(slide AS VARCHAR(20))) END AS study_uid, CONCAT('1.4.', CAST(slide AS VARCHAR(20))) AS series_uid,
       CASE WHEN c % 29 = 0 THEN NULL WHEN c % 31 = 0 THEN '1.6.other' ELSE CONCAT('1.6.', CAST(slide AS VARCHAR(20))) END AS frame_of_reference, CASE WHEN a % 43 = 0 THEN '1.2.840.10008.5.1.4.1.1.77.1.5' ELSE '1.2.840.10008.5.1.4.1.1.77.1.6' END AS sop_class,
       CASE WHEN a % 7 = 0 THEN CONCAT('1.5.', CAST(slide AS VARCHAR(20)), '.0') ELSE CONCAT('1.5.', CAST(event_id AS VARCHAR(20))) END AS uid, CASE WHEN b % 5 = 0 THEN CONCAT('1.7.', CAST(slide AS VARCHAR(20)), '.', CAST(k % 3 AS VARCHAR(4))) ELSE NULL END AS concat_uid,
       CASE WHEN b % 5 = 0 AND c % 11 <> 0 THEN k * 4 ELSE NULL END AS concat_offset, CASE k WHEN 8 THEN 'LABEL' WHEN 9 THEN 'OVERVIEW' WHEN 10 THEN 'THUMBNAIL' WHEN 11 THEN 'OTHER' ELSE 'VOLUME' END AS image_type,
       CASE WHEN b % 3 = 0 THEN 1 ELSE 3 END AS samples, CASE WHEN c % 23 = 0 THEN NULL WHEN c % 7 = 0 THEN 16 ELSE 8 END AS bits, CASE WHEN a % 59 = 0 THEN 1 WHEN a % 2 = 0 THEN 0 ELSE NULL END AS representation, CASE WHEN a % 61 = 0 THEN 1 WHEN a % 3 = 0 THEN 0 ELSE NULL END AS planar,
       CASE b % 9 WHEN 0 THEN 'MONOCHROME2' WHEN 1 THEN 'RGB' WHEN 2 THEN 'YBR_FULL' WHEN 3 THEN 'YBR_FULL_422' WHEN 4 THEN 'YBR_ICT' WHEN 5 THEN 'YBR_RCT' WHEN 6 THEN 'YBR_PARTIAL_420' WHEN 7 THEN 'MONOCHROME1' ELSE 'RGB' END AS photometric,
       CASE WHEN (slide + k) % 7 < 2 THEN '1.2.840.10008.1.2.1' WHEN (slide + k) % 7 = 2 THEN '1.2.840.10008.1.2.5' WHEN (slide + k) % 7 < 5 THEN '1.2.840.10008.1.2.4.50' ELSE '1.2.840.10008.1.2.4.90' END AS syntax,
       CASE WHEN c % 47 = 0 THEN 512 ELSE 256 END AS tile_rows, 256 AS tile_columns, CAST(CEIL((1024 + (slide * 977) % 7168) / POWER(2, k % 4)) AS BIGINT) AS total_columns, CAST(CEIL((768 + (slide * 613) % 5120) / POWER(2, k % 4)) AS BIGINT) AS total_rows, CAST(0.00025E0 * POWER(2, k % 4) AS DOUBLE) AS spacing,
       CASE WHEN a % 4 = 0 THEN NULL ELSE 1 + a % 6 END AS n_frames, CASE WHEN a % 6 = 0 THEN NULL ELSE 1 + a % 3 END AS planes, CASE WHEN b % 6 = 0 THEN NULL ELSE 1 + b % 2 END AS paths, CASE c % 4 WHEN 0 THEN 'TILED_FULL' WHEN 1 THEN 'TILED_SPARSE' ELSE NULL END AS organization, c % 5 < 2 AS per_frame,
       CASE WHEN a % 13 = 0 THEN NULL ELSE 10 + 0.004E0 * (b % 9) END AS origin_x, CASE WHEN a % 13 = 0 THEN NULL ELSE 20 + 0.005E0 * (c % 3) END AS origin_y, CASE WHEN a % 13 = 0 THEN NULL WHEN b % 8 = 0 THEN CAST(90 * (b % 4) AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS rotation,
       CASE WHEN a % 5 = 0 THEN 0.5E0 * (a % 4) ELSE NULL END AS origin_z, CASE WHEN b % 4 = 0 THEN 0.25E0 * (b % 7) ELSE NULL END AS shared_z, CASE WHEN c % 6 = 0 THEN NULL ELSE 0.0005E0 * (c % 4) END AS spacing_between, CASE WHEN c % 3 = 0 THEN 0.001E0 * (c % 7) ELSE NULL END AS thickness,
       CASE WHEN b % 3 = 1 THEN 0.006E0 ELSE NULL END AS depth_mm, CASE WHEN a % 4 = 1 THEN 'YES' WHEN a % 4 = 2 THEN 'NO' ELSE NULL END AS ext_dof, CASE WHEN c % 8 = 0 THEN NULL ELSE 2 + c % 2 END AS ext_planes, CASE WHEN c % 10 = 0 THEN NULL ELSE 0.5E0 END AS ext_distance, CASE WHEN b % 2 = 0 THEN 'MANUAL' ELSE NULL END AS focus_method
FROM (SELECT event_id, CAST(FLOOR(event_id / 12) AS BIGINT) AS slide, event_id % 12 AS k, (event_id * 7919) % 1009 AS a, (event_id * 104729) % 997 AS b, (event_id * 1299709) % 991 AS c FROM events) v""",
    # regions that are asked for
    "fx_request": """SELECT event_id AS request_id, event_id % 50 AS slide_id, CAST(event_id % 6 AS INT) AS level, (event_id * 37) % 2000 AS x, (event_id * 53) % 1500 AS y, 1 + (event_id * 11) % 900 AS w, 1 + (event_id * 17) % 700 AS h FROM events""",
}
PIXEL_SPARK = """SELECT vec_id, vec_id % 20 AS tile_x, CAST(FLOOR(vec_id/20) AS BIGINT) AS tile_y, CAST(p % 8 AS INT) AS px, CAST(FLOOR(p/8) AS INT) AS py, CAST(FLOOR((CAST(e AS DOUBLE)+1.0E0)*127.5E0) AS INT) AS v
FROM embeddings LATERAL VIEW posexplode(embedding) q AS p, e"""
PIXEL_DUCKDB = """SELECT vec_id, vec_id % 20 AS tile_x, CAST(FLOOR(vec_id/20) AS BIGINT) AS tile_y, CAST((p-1) % 8 AS INT) AS px, CAST(FLOOR((p-1)/8) AS INT) AS py, CAST(FLOOR((CAST(embedding[p] AS DOUBLE)+1.0E0)*127.5E0) AS INT) AS v
FROM (SELECT vec_id, embedding, UNNEST(generate_series(1,64)) AS p FROM embeddings) q"""


def _needed(name: str) -> list[str]:
    out: list[str] = []
    for other in VIEWS:
        if other != name and other in VIEWS[name]:
            out += [x for x in [*_needed(other), other] if x not in out]
    return out


def fx(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A projection, or a table of the driver, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    views = {"fx_pixel": PIXEL_SPARK} if name == "fx_pixel" else {v: VIEWS[v] for v in [*_needed(name), name]}
    text = " ".join(views.values())
    tables = {t: f"SELECT * FROM parquet.`{sf_dir}/{t}.parquet`" for t in TABLES if f"FROM {t}" in text or f"JOIN {t}" in text}
    return spark.sql("WITH " + ", ".join(f"{n} AS ({s})" for n, s in (tables | views).items()) + f" SELECT * FROM {name}")


def oracle(sql: str) -> str:
    """SQL over the projections as DuckDB runs it: what it names comes first."""
    names: list[str] = []
    for v in VIEWS:
        if v in sql:
            names += [x for x in [*_needed(v), v] if x not in names]
    parts = [f"{v} AS ({VIEWS[v]})" for v in names]
    if "fx_pixel" in sql:
        parts.append(f"fx_pixel AS ({PIXEL_DUCKDB})")
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join(parts) + (", " if parts else "") + body[14:].strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join([*parts, body[5:].strip()])
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body
