"""Vector annotations: vertices, flat coordinate lists with indices, and measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def polygons(vertices: DataFrame) -> DataFrame:
    """Vertices to annotations: points in order, and their box."""
    points = F.sort_array(F.collect_list(F.struct("ordinal", "x", "y")))
    out = vertices.groupBy("annotation_id", "group_id").agg(points.alias("v"), *[f(c).alias(f"{n}_{c}") for c in "xy" for f, n in ((F.min, "min"), (F.max, "max"))])
    return out.withColumn("points", F.transform("v", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))).drop("v")


def flat(annotations: DataFrame) -> DataFrame:
    """A group's annotations as one list of coordinates, and the 1-based index where each begins."""
    w = Window.partitionBy("group_id").orderBy("annotation_id")
    sizes = annotations.withColumn("n", F.size("points"))
    start = 1 + F.coalesce(F.sum(2 * F.col("n")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.withColumn("start", start).withColumn("coordinates", F.flatten(F.transform("points", lambda p: F.array(p["x"], p["y"]))))


def unflat(starts: DataFrame, total: DataFrame) -> DataFrame:
    """Point ranges (first, n) of each annotation from its group's index list; total: group_id, n_points."""
    w = Window.partitionBy("group_id").orderBy("start")
    rows = starts.join(total, "group_id")
    first = F.floor((F.col("start") - 1) / 2)
    following = F.coalesce(F.floor((F.lead("start").over(w) - 1) / 2), F.col("n_points"))
    return rows.select("group_id", "annotation_id", first.alias("first"), (following - first).alias("n"))


def one_to_one(annotations: DataFrame, measurements: DataFrame, keys: list[str]) -> DataFrame:
    """For each kind of measurement whether every annotation has exactly one."""
    total = annotations.select("annotation_id").distinct().agg(F.count("*").alias("total"))
    each = measurements.groupBy(*keys, "annotation_id").agg(F.count("*").alias("n"))
    kinds = each.groupBy(*keys).agg(F.count("*").alias("having"), F.max("n").alias("most"))
    return kinds.crossJoin(F.broadcast(total)).select(*keys, ((F.col("having") == F.col("total")) & (F.col("most") == 1)).alias("one_to_one"))  # total is one row


def with_index(lists: DataFrame, values: str, index: str) -> DataFrame:
    """(..., nth, value): a list of values with the numbers of the annotations (from 1) that they are of, or of one each if there are no numbers; lists of other lengths are left out."""
    own = F.coalesce(F.col(index), F.sequence(F.lit(1).cast("bigint"), F.size(values).cast("bigint")))
    rows = lists.withColumn(index, own).where(F.size(index) == F.size(values))
    others = [c for c in lists.columns if c not in (values, index)]
    return rows.select(*others, F.explode(F.arrays_zip(F.col(index).alias("nth"), F.col(values).alias("value"))).alias("z")).select(*others, F.col("z.nth").alias("nth"), F.col("z.value").alias("value"))


def from_geojson(features: DataFrame, text: str) -> DataFrame:
    """(..., graphic, points) of GeoJSON features: Point, MultiPoint (one annotation a point), LineString, Polygon (its outer ring); others have no row."""
    kind, coordinates = F.get_json_object(text, "$.geometry.type"), F.get_json_object(text, "$.geometry.coordinates")
    one = F.array(F.array(F.from_json(coordinates, "array<double>")))
    many = F.transform(F.from_json(coordinates, "array<array<double>>"), lambda p: F.array(p))
    line = F.array(F.from_json(coordinates, "array<array<double>>"))
    ring = F.array(F.get(F.from_json(coordinates, "array<array<array<double>>>"), 0))
    each = F.when(kind == "Point", one).when(kind == "MultiPoint", many).when(kind == "LineString", line).when(kind == "Polygon", ring)
    graphic = F.when(kind == "Polygon", "POLYGON").when(kind == "LineString", "POLYLINE").otherwise("POINT")
    others = [c for c in features.columns if c != text]
    return features.select(*others, graphic.alias("graphic"), F.explode(each).alias("points"))
