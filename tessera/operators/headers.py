"""Rules over the headers of slide files: which are read, which belong together, and what their fields mean.

Columns are those of the `dicomslides` source or have the same names; an absent attribute is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the file format.
SLIDE_CLASS = "1.2.840.10008.5.1.4.1.1.77.1.6"
IMAGE_TYPES = ("VOLUME", "LABEL", "OVERVIEW", "THUMBNAIL")
PHOTOMETRIC = ("MONOCHROME2", "RGB", "YBR_FULL", "YBR_FULL_422", "YBR_ICT", "YBR_RCT", "YBR_PARTIAL_420")
REQUIRED = ("uid", "study_uid", "series_uid", "image_type", "tile_rows", "tile_columns", "total_columns", "total_rows", "samples", "photometric", "bits")
NATIVE = ("1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.2")
#: Largest offset that a basic table can hold.
BASIC_TABLE_LIMIT = 2**32 - 1


def supported() -> Column:
    """Whether a file can be read: the class, everything required, unsigned and interleaved samples, more than 8 bits of one sample only."""
    out = F.col("sop_class").eqNullSafe(SLIDE_CLASS)
    for c in REQUIRED:
        out = out & F.col(c).isNotNull()
    out = out & F.col("image_type").isin(*IMAGE_TYPES) & F.col("photometric").isin(*PHOTOMETRIC)
    out = out & (F.coalesce("representation", F.lit(0)) == 0) & (F.coalesce("planar", F.lit(0)) == 0)
    return F.coalesce(out & ((F.col("bits") == 8) | (F.col("samples") == 1)), F.lit(False))


def tile_type(strict: bool = False) -> Column:
    """FULL as declared; else SPARSE with positions by frame; a label and one frame a plane and path are FULL. Else null, or an error if strict."""
    frames, cells = F.coalesce("n_frames", F.lit(1)), F.coalesce("planes", F.lit(1)) * F.coalesce("paths", F.lit(1))
    known = F.when(F.col("organization") == "TILED_FULL", "FULL").when(F.col("per_frame"), "SPARSE").when((F.col("image_type") == "LABEL") | (frames == cells), "FULL")
    return known.otherwise(F.raise_error(F.concat(F.lit("tile type undetermined: "), F.col("uid")))) if strict else known


def identifier() -> Column:
    """Files of one instance share it."""
    return F.coalesce("concat_uid", "uid")


def frame_offset(strict: bool = False) -> Column:
    """First frame of the file in its instance: 0 unless it is one of several, which must say it. Else null, or an error if strict."""
    missing = F.raise_error(F.concat(F.lit("part of a concatenation without its frame offset: "), F.col("uid"))) if strict else F.lit(None)
    return F.when(F.col("concat_uid").isNull(), F.lit(0).cast("bigint")).when(F.col("concat_offset").isNotNull(), F.col("concat_offset").cast("bigint")).otherwise(missing.cast("bigint"))


def extended_depth() -> Column:
    """Null unless the depth of field is extended; then planes (1 if not said) and their distance (0 if not said)."""
    return F.when(F.col("ext_dof") == "YES", F.struct(F.coalesce("ext_planes", F.lit(1)).cast("bigint").alias("planes"), F.coalesce("ext_distance", F.lit(0.0)).alias("distance")))


def z_offset() -> Column:
    return F.coalesce("origin_z", "shared_z", F.lit(0.0))


def slice_thickness() -> Column:
    """As measured, else the imaged depth over the planes."""
    return F.coalesce("thickness", F.col("depth_mm") / F.coalesce("planes", F.lit(1)))


def series_match(files: DataFrame, strict: bool = True) -> DataFrame:
    """(file_id, matches): whether a file belongs to its slide, as its widest volume file tells.

    Study, and frame of reference if strict, must be the same; of volumes the tile size, too.
    """
    volumes = files.where(F.col("image_type") == "VOLUME")
    base = volumes.groupBy("slide_id").agg(F.max_by(F.struct("study_uid", "frame_of_reference", "tile_rows", "tile_columns"), F.struct("total_columns", "total_rows", -F.col("file_id"))).alias("b"))
    same = F.col("study_uid").eqNullSafe(F.col("b.study_uid"))
    if strict:
        same = same & F.col("frame_of_reference").eqNullSafe(F.col("b.frame_of_reference"))
    tiles = (F.col("image_type") != "VOLUME") | ((F.col("tile_rows") == F.col("b.tile_rows")) & (F.col("tile_columns") == F.col("b.tile_columns")))
    return files.join(base, "slide_id").select("slide_id", "file_id", (same & tiles).alias("matches"))


def _one(*columns: Column | str) -> Column:
    """Whether all rows of a group agree, null counting as a value."""
    each = F.struct(*columns)
    return F.min(each).eqNullSafe(F.max(each))


def instance_match(files: DataFrame) -> DataFrame:
    """(identifier, files, matches): whether the files of an instance agree in identifiers, sizes, tile type and origin."""
    same = _one("study_uid", "series_uid", "total_columns", "total_rows", "tile_rows", "tile_columns", tile_type().alias("tile_type"), "origin_x", "origin_y", "origin_z")
    return files.groupBy(identifier().alias("identifier")).agg(F.count("*").alias("files"), same.alias("matches"))


def group_match(files: DataFrame) -> DataFrame:
    """(slide_id, image_type, total_columns, matches): whether the instances of a group agree in identifiers, size and tile size."""
    same = _one("study_uid", "frame_of_reference", "total_rows", "tile_rows", "tile_columns")
    return files.groupBy("slide_id", "image_type", "total_columns").agg(same.alias("matches"))


def violations(files: DataFrame, annotations: DataFrame, strict: bool = True) -> DataFrame:
    """(kind, id): repeated files and series that don't match are errors, annotations that don't are warnings."""
    twice = files.groupBy("slide_id", "uid").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate").alias("kind"), F.col("uid").alias("id"))
    apart = series_match(files, strict).where("not matches").join(files.select("file_id", "image_type"), "file_id").select(F.lit("series").alias("kind"), F.concat_ws("/", F.col("slide_id").cast("string"), "image_type").alias("id")).distinct()
    base = files.where(F.col("image_type") == "VOLUME").groupBy("slide_id").agg(F.max_by("study_uid", F.struct("total_columns", "total_rows", -F.col("file_id"))).alias("study"))
    notes = annotations.join(base, "slide_id").where(~F.col("study_uid").eqNullSafe(F.col("study"))).select(F.lit("annotation").alias("kind"), F.col("annotation_uid").alias("id"))
    return twice.unionByName(apart).unionByName(notes)


def coordinates_match(a: DataFrame, b: DataFrame, keys: list[str], threshold: float = 0.02) -> DataFrame:
    """Pairs of rows (x, y, rotation) of equal keys and rotation not more than threshold apart.

    Places are dealt to a grid of that size and one side also to the cells around its own: an equi-join, not a theta-join.
    """
    cell = lambda c: F.floor(F.col(c) / threshold)
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    left = a.withColumns({"cx": cell("x"), "cy": cell("y")})
    right = b.withColumn("cx", F.explode(F.transform(near, lambda d: cell("x") + d))).withColumn("cy", F.explode(F.transform(near, lambda d: cell("y") + d)))
    same = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in [*keys, "rotation", "cx", "cy"]]
    apart = F.sqrt(F.pow(F.col("l.x") - F.col("r.x"), 2) + F.pow(F.col("l.y") - F.col("r.y"), 2))
    return left.alias("l").join(right.alias("r"), same).where(apart <= threshold)


def pyramids(instances: DataFrame, threshold: float = 0.02) -> DataFrame:
    """(slide_id, uid, pyramid): instances, the largest first, join the first pyramid whose members all match them.

    instances: slide_id, uid, width, height, x, y, rotation (null without a coordinate system), ext (a
    struct or null). Those without a coordinate system make a pyramid of their own for each depth of
    field. Matching isn't transitive, so the order is part of the meaning: of equal sizes the smaller
    uid. One fold over a slide's few instances, on the JVM.
    """
    place = "struct<x:double,y:double,rotation:double>"
    depth = "struct<planes:bigint,distance:double>"
    whole = F.sort_array(F.collect_list(F.struct((-F.col("width")).alias("w"), (-F.col("height")).alias("h"), "uid", F.when(F.col("x").isNotNull(), F.struct("x", "y", "rotation")).cast(place).alias("at"), F.col("ext").cast(depth).alias("ext"))))

    def match(m: Column, i: Column) -> Column:
        apart = F.sqrt(F.pow(m["x"] - i["at"]["x"], 2) + F.pow(m["y"] - i["at"]["y"], 2))
        return F.coalesce((m["rotation"] == i["at"]["rotation"]) & (apart <= threshold), F.lit(False))

    def step(groups: Column, i: Column) -> Column:
        joins = F.transform(groups, lambda g: g["ext"].eqNullSafe(i["ext"]) & i["at"].isNotNull() & F.forall(g["members"], lambda m: match(m["at"], i)))
        alike = F.transform(groups, lambda g: g["ext"].eqNullSafe(i["ext"]) & g["at"].eqNullSafe(i["at"]))
        first = F.array_position(joins, F.lit(True))
        nth = F.when(first > 0, first).otherwise(F.array_position(alike, F.lit(True)))
        member = F.struct(i["uid"].alias("uid"), i["at"].alias("at"))
        new = F.struct(i["at"].alias("at"), i["ext"].alias("ext"), F.array(member).alias("members"))
        grown = F.transform(groups, lambda g, k: F.when(k + 1 == nth, g.withField("members", F.array_append(g["members"], member))).otherwise(g))
        return F.when(nth > 0, grown).otherwise(F.array_append(groups, new))

    none = F.array().cast(f"array<struct<at:{place},ext:{depth},members:array<struct<uid:string,at:{place}>>>>")
    folded = instances.groupBy("slide_id").agg(whole.alias("all")).select("slide_id", F.posexplode(F.aggregate("all", none, step)).alias("pyramid", "g"))
    return folded.select("slide_id", F.explode("g.members").alias("m"), F.col("pyramid").cast("bigint").alias("pyramid")).select("slide_id", "m.uid", "pyramid")


def full_planes(spacing_mm: Column, z0: Column, planes: Column) -> Column:
    """The focal planes of a full instance in micrometres, to three decimals, each once, in order.

    Several planes must have a spacing; null if they don't.
    """
    spacing = F.when(spacing_mm.isNull() & (planes == 1), 0.0).otherwise(spacing_mm)
    ok = spacing.isNotNull() & ((spacing != 0) | (planes == 1))
    steps = F.transform(F.sequence(F.lit(0).cast("bigint"), planes.cast("bigint") - 1), lambda k: F.bround(z0 + k * spacing * 1000, 3))
    return F.when(ok, F.array_sort(F.array_distinct(steps)))


def equally_spaced(planes: Column, threshold: float = 1e-6) -> Column:
    """Whether every step between the planes (an array) is the first one's size."""
    z = F.array_sort(planes)
    step = lambda i: F.get(z, i + 1) - F.get(z, i)
    steps = F.transform(F.sequence(F.lit(0), F.size(z) - 2), step)
    return F.when(F.size(z) < 3, True).otherwise(F.forall(steps, lambda s: F.abs(F.get(z, F.lit(1)) - F.get(z, F.lit(0)) - s) <= threshold))


def rewritten(scale: Column, planes: Column, paths: Column, tiles_x: Column, tiles_y: Column) -> list[Column]:
    """Header columns of a level written as fully tiled, smaller by scale: planes and paths (arrays) are the kept ones."""
    least = lambda c: F.greatest(F.ceil(c / scale), F.lit(1).cast("bigint"))
    kept = F.filter("path_ids", lambda p: F.array_contains(paths, p))
    step = F.when(F.size(planes) > 1, (F.get(F.array_sort(planes), F.lit(1)) - F.array_min(planes)) / 1000)
    return [
        F.lit("TILED_FULL").alias("organization"), least(F.col("total_columns")).alias("total_columns"), least(F.col("total_rows")).alias("total_rows"), (F.col("spacing") * scale).alias("spacing"),
        F.size(planes).cast("bigint").alias("planes"), F.size(paths).cast("bigint").alias("paths"), (F.greatest(F.ceil(tiles_x / scale) * F.ceil(tiles_y / scale), F.lit(1).cast("bigint")) * F.size(planes) * F.size(paths)).alias("n_frames"),
        F.when(F.size(kept) > 0, kept).otherwise(F.col("path_ids")).alias("path_ids"), step.alias("spacing_between"), F.get(planes, F.lit(0)).alias("origin_z"),
    ]


def compressed_again(method: Column, ratio: Column, scale: Column) -> list[Column]:
    """(methods, ratios) after encoding: one more of each, after clearing what a smaller image no longer has; unchanged if lossless."""
    out = []
    for name, new in (("methods", method), ("ratios", ratio)):
        old = F.when(scale != 1, F.array().cast("array<string>")).otherwise(F.coalesce(F.col(name), F.array().cast("array<string>")))
        out.append(F.when(method.isNull(), F.coalesce(F.col(name), F.array().cast("array<string>"))).otherwise(F.array_append(old, new)).alias(name))
    return out


def overlaid(old: list[str], new: str) -> list[Column]:
    """Columns of the old header, those that the struct `new` has a value for replaced."""
    return [F.coalesce(F.col(f"{new}.{c}"), F.col(c)).alias(c) for c in old]


def transcoding(forced: Column, wanted: Column, own: Column, strict: bool = False) -> Column:
    """What is done with an image's frames, of (syntax, bits, samples) structs: copied, encoded as wanted or as their source asks, or error.

    own: the source's encoder, null if its frames can be copied.
    """
    as_wanted = wanted.isNotNull() & (forced | (F.col("syntax") != wanted["syntax"]))
    coder = F.when(as_wanted, wanted).otherwise(own)
    fits = (coder["bits"] == F.col("bits")) & (coder["samples"] == F.col("samples"))
    error = F.raise_error(F.lit("bits or samples of the encoder differ from the image's")) if strict else F.lit("error")
    return F.when(coder.isNull(), F.concat(F.lit("copy "), F.col("syntax"))).when(fits, F.concat(F.lit("encode "), coder["syntax"])).otherwise(error)


def offset_table(syntax: Column, wanted: Column, size: Column) -> Column:
    """Kind of the table of frame offsets: none for native pixels, else as wanted, extended where a basic one can't hold the offsets."""
    return F.when(syntax.isin(*NATIVE), "NONE").when((wanted == "BASIC") & (size > BASIC_TABLE_LIMIT), "EXTENDED").otherwise(wanted)


def frame_index_kind(syntax: Column, extended: Column, basic_bytes: Column, tiff: Column) -> Column:
    """Which way a reader finds frames: the first that is there, in this order."""
    return F.when(syntax.isin(*NATIVE), "native").when(extended, "extended").when(basic_bytes > 0, "basic").when(tiff, "tiff").otherwise("items")


def previous_in_order(steps: DataFrame, key: str, ordinal: str, name: str) -> DataFrame:
    """(key, name, previous): names in the order in which they are first met (of ties by name), each with the one before."""
    first = steps.groupBy(key, name).agg(F.min(ordinal).alias("at"))
    return first.select(key, name, F.lag(name).over(Window.partitionBy(key).orderBy("at", name)).alias("previous"))
