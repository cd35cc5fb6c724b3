"""Queries over annotations and measurements."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import annotations as A
from tessera.plans.fixtures import fx
from tessera.plans.registry import query

_LIST = "SELECT group_id, annotation_id, count(*) AS n FROM fx_vertex GROUP BY group_id, annotation_id"


@query("agg09_bounding_box", "SELECT annotation_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM fx_vertex GROUP BY annotation_id")
def bounding_box(spark, sf):
    return A.polygons(fx(spark, sf, "fx_vertex")).select("annotation_id", F.col("min_x").alias("x0"), F.col("min_y").alias("y0"), F.col("max_x").alias("x1"), F.col("max_y").alias("y1"))


@query("win03_point_index", f"SELECT group_id, annotation_id, CAST(1 + coalesce(sum(2 * n) OVER (PARTITION BY group_id ORDER BY annotation_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM ({_LIST})")
def point_index(spark, sf):
    return A.flat(A.polygons(fx(spark, sf, "fx_vertex"))).select("group_id", "annotation_id", "start")


@query("win04_index_slices", f"SELECT group_id, annotation_id, CAST(coalesce(sum(n) OVER (PARTITION BY group_id ORDER BY annotation_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first, n FROM ({_LIST})")
def index_slices(spark, sf):
    starts = A.flat(A.polygons(fx(spark, sf, "fx_vertex")))
    return A.unflat(starts.select("group_id", "annotation_id", "start"), starts.groupBy("group_id").agg(F.sum("n").alias("n_points")))


@query("ann01_homogeneous", "SELECT group_id, count(DISTINCT k) = 1 AS homogeneous, count(*) AS annotations FROM (SELECT group_id, annotation_id, CASE WHEN count(*) = 1 THEN 'POINT' WHEN annotation_id % 2 = 0 THEN 'POLYGON' ELSE 'POLYLINE' END AS k FROM fx_vertex GROUP BY group_id, annotation_id) GROUP BY group_id")
def homogeneous(spark, sf):
    kind = F.when(F.size("points") == 1, "POINT").when(F.col("annotation_id") % 2 == 0, "POLYGON").otherwise("POLYLINE")
    return A.polygons(fx(spark, sf, "fx_vertex")).groupBy("group_id").agg((F.count_distinct(kind) == 1).alias("homogeneous"), F.count("*").alias("annotations"))


@query("ann05_slice_access", f"SELECT group_id, annotation_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY annotation_id) AS rn FROM ({_LIST})) WHERE rn BETWEEN 3 AND 7")
def slice_access(spark, sf):
    rows = A.polygons(fx(spark, sf, "fx_vertex")).withColumn("rn", F.row_number().over(Window.partitionBy("group_id").orderBy("annotation_id")))
    return rows.where("rn between 3 and 7").select("group_id", "annotation_id")


@query("agg10_measurement_types", "SELECT DISTINCT code, unit FROM fx_measurement")
def measurement_types(spark, sf):
    return fx(spark, sf, "fx_measurement").select("code", "unit").distinct()


@query("agg11_one_to_one", "WITH t AS (SELECT count(DISTINCT annotation_id) AS total FROM fx_vertex), e AS (SELECT code, annotation_id, count(*) AS n FROM fx_measurement GROUP BY code, annotation_id) SELECT code, count(*) = max(total) AND max(n) = 1 AS one_to_one FROM e CROSS JOIN t GROUP BY code")
def one_to_one(spark, sf):
    return A.one_to_one(fx(spark, sf, "fx_vertex"), fx(spark, sf, "fx_measurement"), ["code"])


@query("flt13_measurement_filter", "SELECT annotation_id, ordinal, value FROM fx_measurement WHERE code = (SELECT min(code) FROM fx_measurement) AND unit = 'um'")
def measurement_filter(spark, sf):
    rows = fx(spark, sf, "fx_measurement")
    wanted = rows.agg(F.min("code").alias("wanted"))
    return rows.join(F.broadcast(wanted), F.col("code") == F.col("wanted")).where("unit = 'um'").select("annotation_id", "ordinal", "value")  # one row


@query("win05_measurement_index", "SELECT annotation_id, code, row_number() OVER (PARTITION BY code ORDER BY annotation_id, ordinal) AS nth FROM fx_measurement")
def measurement_index(spark, sf):
    return fx(spark, sf, "fx_measurement").select("annotation_id", "code", F.row_number().over(Window.partitionBy("code").orderBy("annotation_id", "ordinal")).cast("bigint").alias("nth"))


@query("arr01_pairs", "SELECT annotation_id, CAST(2 * count(*) AS BIGINT) AS flat, count(*) AS pairs FROM fx_vertex GROUP BY annotation_id")
def pairs(spark, sf):
    flat = A.flat(A.polygons(fx(spark, sf, "fx_vertex")))
    back = F.transform(F.sequence(F.lit(1), F.size("coordinates"), F.lit(2)), lambda i: F.array(F.element_at("coordinates", i), F.element_at("coordinates", i + 1)))
    return flat.select("annotation_id", F.size("coordinates").cast("bigint").alias("flat"), F.size(back).cast("bigint").alias("pairs"))
