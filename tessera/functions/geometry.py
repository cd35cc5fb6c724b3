"""Pixel and millimetre geometry as Column expressions.

A size, point or region is given by its columns. Division truncates toward zero, remainders are
floor-modulo, and rounding is half to even, each in one helper, as the slide formats need them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncate(x: Column) -> Column:
    """Toward zero, as bigint."""
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("bigint")


def half_even(x: Column) -> Column:
    """To the nearest integer, ties to the even one."""
    return F.bround(x, 0).cast("bigint")


def ceil_div(a: Column, b: Column) -> Column:
    return F.ceil(a / b).cast("bigint")


def tiles(size: Column, tile: Column) -> Column:
    """Tiles along an axis."""
    return ceil_div(size, tile)


def crop(position: Column, size: Column, other_position: Column, other_size: Column) -> tuple[Column, Column]:
    """Position and size along an axis of what one interval leaves of the other."""
    end, other_end = position + size, other_position + other_size
    start = F.least(F.greatest(other_position, position), end)
    stop = F.greatest(F.least(other_end, end), position)
    return start, stop - start


def inside_crop(tile_no: Column, tile: Column, position: Column, size: Column) -> tuple[Column, Column]:
    """The part of a tile that an interval covers, relative to the tile."""
    start, length = crop(tile_no * tile, tile, position, size)
    return F.pmod(start, tile), length


def zoom(position: Column, size: Column, factor: Column) -> Column:
    """Position of an interval of the same size around the scaled centre."""
    return truncate(position * factor + (size * factor - size) / 2)


def tile_range(position: Column, size: Column, tile: Column) -> tuple[Column, Column]:
    """First tile and one past the last that an interval of at least one pixel touches."""
    return F.floor(position / tile).cast("bigint"), F.floor((position + size - 1) / tile).cast("bigint") + 1


def mm_to_pixel(mm: Column, spacing: Column) -> Column:
    return truncate(mm / spacing)


def rotation(o0: Column, o3: Column) -> Column:
    """Degrees in 0..360 of a direction cosine pair."""
    return F.pmod(F.degrees(F.atan2(-o0, o3)), F.lit(360.0))


def image_to_slide(x: Column, y: Column, origin_x: Column, origin_y: Column, degrees: Column) -> tuple[Column, Column]:
    """A point of the image on the slide."""
    a = F.radians(degrees)
    return origin_x - F.sin(a) * x + F.cos(a) * y, origin_y + F.cos(a) * x + F.sin(a) * y


def slide_to_image(x: Column, y: Column, origin_x: Column, origin_y: Column, degrees: Column) -> tuple[Column, Column]:
    """A point of the slide in the image; the inverse of `image_to_slide`."""
    a = F.radians(degrees)
    dx, dy = x - origin_x, y - origin_y
    return -F.sin(a) * dx + F.cos(a) * dy, F.cos(a) * dx + F.sin(a) * dy


def level_index(spacing: Column, base: Column, tolerance: float = 0.01) -> Column:
    """Level of a spacing, null where it is no power of two of the base's."""
    exact = F.log2(spacing / base)
    return F.when(F.abs(exact - F.bround(exact, 0)) <= tolerance, half_even(exact))


def highest_level(width: Column, height: Column) -> Column:
    """The level at which the image is one pixel."""
    return F.ceil(F.log2(F.greatest(width, height).cast("double"))).cast("bigint")


def single_tile_level(width: Column, height: Column, tile_w: Column, tile_h: Column) -> Column:
    """The first level that fits in one tile."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(width / tile_w, height / tile_h)))).cast("bigint")


def full_frame(x: Column, y: Column, z_no: Column, path_no: Column, tiles_x: Column, tiles_y: Column, planes: Column) -> Column:
    """Frame of a tile of a fully tiled instance: x, then y, then plane, then path."""
    return x + tiles_x * y + z_no * tiles_x * tiles_y + path_no * planes * tiles_x * tiles_y


def sparse_tile(position: Column, tile: Column) -> Column:
    """Tile of a frame's 1-based pixel position."""
    return F.floor((position - 1) / tile).cast("bigint")


def fit(width: Column, height: Column, most_w: Column, most_h: Column) -> tuple[Column, Column]:
    """Size that fits, never larger than the image, at least one pixel."""
    factor = F.least(most_w / width, most_h / height, F.lit(1.0))
    return F.greatest(half_even(width * factor), F.lit(1)), F.greatest(half_even(height * factor), F.lit(1))


def orientation(degrees: Column) -> list[Column]:
    """The six direction cosines of a rotation, to eight decimals."""
    x, y = F.round(F.sin(F.radians(degrees)), 8), F.round(F.cos(F.radians(degrees)), 8)
    return [-x, y, F.lit(0.0), y, x, F.lit(0.0)]


def transformed(o: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    """A point turned by an orientation."""
    return o[0] * x + o[3] * y, o[1] * x + o[4] * y


def transformed_back(o: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    """The inverse of `transformed`."""
    d = o[0] * o[4] - o[3] * o[1]
    return (o[4] * x - o[3] * y) / d, (o[0] * y - o[1] * x) / d


def interleaved(x: Column, y: Column, bits: int = 24) -> Column:
    """The bits of x and y in turns: the order in which blocks are walked through quarter by quarter."""
    each = [F.shiftright(c.cast("bigint"), b).bitwiseAND(F.lit(1).cast("bigint")) * F.lit(1 << (2 * b + k)).cast("bigint") for b in range(bits) for k, c in enumerate((x, y))]
    return sum(each[1:], each[0])
