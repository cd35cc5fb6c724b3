"""From requested regions to tiles to stored frames, as joins and generated keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import geometry as G


def closest_level(requests: DataFrame, levels: DataFrame) -> DataFrame:
    """Each request with the stored level nearest below or at the one it asks for.

    requests: slide_id, level and others; levels: slide_id, level, width, height, tile_w, tile_h. The
    levels of a slide are a handful, so they travel as one array a slide.
    """
    fields = [c for c in levels.columns if c not in ("slide_id", "level")]
    stored = levels.groupBy("slide_id").agg(F.collect_list(F.struct(F.col("level").alias("stored"), *fields)).alias("stored_levels"))
    picked = F.array_max(F.filter("stored_levels", lambda s: s["stored"] <= F.col("level")))
    return requests.join(stored, "slide_id").withColumn("s", picked).drop("stored_levels").where(F.col("s").isNotNull()).select(*requests.columns, "s.*")


def tiles_of(requests: DataFrame) -> DataFrame:
    """A row for each tile (tile_x, tile_y) that a region touches: keys are generated, not searched.

    requests: x, y, w, h in pixels of the stored level, which lie inside it, and tile_w, tile_h. Empty
    regions have no tile.
    """
    rows = requests.where("w > 0 and h > 0")
    (x0, x1), (y0, y1) = G.tile_range(F.col("x"), F.col("w"), F.col("tile_w")), G.tile_range(F.col("y"), F.col("h"), F.col("tile_h"))
    return rows.withColumn("tile_y", F.explode(F.sequence(y0, y1 - 1))).withColumn("tile_x", F.explode(F.sequence(x0, x1 - 1)))


def scaled(requests: DataFrame) -> DataFrame:
    """Regions of the level asked for, in pixels of the stored one, cropped to it."""
    factor = F.pow(F.lit(2), F.col("level") - F.col("stored")).cast("bigint")
    rows = requests.withColumn("scale", factor)
    x, w = G.crop(F.lit(0).cast("bigint"), F.col("width"), F.col("x") * F.col("scale"), F.col("w") * F.col("scale"))
    y, h = G.crop(F.lit(0).cast("bigint"), F.col("height"), F.col("y") * F.col("scale"), F.col("h") * F.col("scale"))
    return rows.select(*[c for c in rows.columns if c not in ("x", "y", "w", "h")], x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def with_frames(tiles: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """Tiles with their stored frames; a tile without one keeps nulls and is drawn blank."""
    return tiles.join(frames, keys, "left")


def last_frame(frames: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of frames at one place the last one written."""
    rest = [c for c in frames.columns if c not in (*keys, order)]
    return frames.groupBy(*keys).agg(F.max_by(F.struct(order, *rest), order).alias("f")).select(*keys, "f.*")


def file_of_frame(frames: DataFrame, files: DataFrame) -> DataFrame:
    """The part file that holds each frame; parts of an identifier follow each other without gaps.

    A frame's file is the last one that begins at it or before it: both go through one sort by position,
    instead of a join that pairs every frame with every part.
    """
    rest = [c for c in files.columns if c != "identifier"]
    kinds = {f.name: f.dataType for f in files.schema}
    own = [c for c in frames.columns if c != "identifier"]
    parts = files.select("identifier", F.col("frame_offset").alias("_at"), F.lit(0).alias("_turn"), F.struct(*rest).alias("_file"), F.lit(None).cast(frames.select(F.struct(*own).alias("x")).schema["x"].dataType).alias("_frame"))
    asked = frames.select("identifier", F.col("frame_index").alias("_at"), F.lit(1).alias("_turn"), F.lit(None).cast(parts.schema["_file"].dataType).alias("_file"), F.struct(*own).alias("_frame"))
    so_far = Window.partitionBy("identifier").orderBy("_at", "_turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = parts.unionByName(asked).withColumn("_file", F.last("_file", ignorenulls=True).over(so_far)).where("_turn = 1 and _at < _file.frame_offset + _file.n_frames")
    return rows.select("identifier", "_frame.*", *[F.col(f"_file.{c}").cast(kinds[c]).alias(c) for c in rest])


def offsets(frames: DataFrame, key: str = "identifier", index: str = "frame_index", length: str = "byte_len", item_header: int = 8) -> DataFrame:
    """Byte position of each frame's item in its file."""
    before = Window.partitionBy(key).orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    return frames.withColumn("offset", F.coalesce(F.sum(F.col(length) + item_header).over(before), F.lit(0)))


def lengths(table: DataFrame, key: str = "identifier", index: str = "frame_index", end: str = "end_offset", item_header: int = 8) -> DataFrame:
    """Length of each frame from the offset table: up to the next item, the last up to the end."""
    w = Window.partitionBy(key).orderBy(index)
    return table.withColumn("length", F.coalesce(F.lead("offset").over(w), F.col(end)) - F.col("offset") - item_header)
