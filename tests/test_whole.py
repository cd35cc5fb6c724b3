"""Queries over whole tables; those with SQL are compared with it in test_entry."""

from pathlib import Path

import pytest

from tessera.plans import registry
from tessera.plans.fixtures import fx

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")

def test_slides_without_frames(spark):
    data = "/root/testdata/sf0.01"
    if not Path(data).exists():
        pytest.skip("no test tables here")
    rows = registry.QUERIES["jn01_tile_frame"](spark, data).collect()
    assert len(rows) == fx(spark, data, "fx_level").where("level = 0").count() > 50
    assert all(r.stored == 0 and r.blank == r.tiles for r in rows if r.slide_id >= 50)
    blank = {r.slide_id: r["count"] for r in registry.QUERIES["flt14_sparse_tiles"](spark, data).groupBy("slide_id").count().collect()}
    assert all(blank[r.slide_id] == r.tiles for r in rows if r.slide_id >= 50)


def test_stitch_against_brute_force(spark):
    import numpy as np

    pixels = fx(spark, DATA, "fx_pixel").toPandas()
    image = np.zeros((int(pixels.tile_y.max() + 1) * 8, 160), np.int64)
    image[pixels.tile_y * 8 + pixels.py, pixels.tile_x * 8 + pixels.px] = pixels.v
    expected = {}
    for r in fx(spark, DATA, "fx_request").collect():
        x, y, w, h = r.x % 150, r.y % 150, 1 + r.w % 40, 1 + r.h % 30
        expected[r.request_id] = (w, h, int(image[y : y + h, x : x + w].sum()))
    got = {r.request_id: (r.w, r.h, r.total) for r in registry.QUERIES["pix04_stitch"](spark, DATA).collect()}
    assert len(got) > 500 and got == expected


def test_coordinates_match_against_brute_force(spark):
    """Pairs over cell borders too."""
    import math
    import random

    from tessera.operators.headers import coordinates_match

    r = random.Random(3)
    rows = [(i, r.uniform(-0.2, 0.2), r.uniform(-0.1, 0.1), float(r.choice([0, 90])), "a") for i in range(300)]
    df = spark.createDataFrame(rows, "i int, x double, y double, rotation double, k string")
    got = {(p[0], p[1]) for p in coordinates_match(df, df, ["k"]).select("l.i", "r.i").collect()}
    assert got == {(a[0], b[0]) for a in rows for b in rows if a[3] == b[3] and math.hypot(a[1] - b[1], a[2] - b[2]) <= 0.02}


def test_undetermined_headers_raise(spark):
    """What the format doesn't allow is an error where it is asked for strictly."""
    from pyspark.errors import PySparkException

    from tessera.operators import headers as H

    row = spark.createDataFrame([("1", None, None, "VOLUME", 3, 1, 1, False, "2", None)], "uid string, organization string, concat_uid2 string, image_type string, n_frames int, planes int, paths int, per_frame boolean, concat_uid string, concat_offset int")
    for column in (H.tile_type(strict=True), H.frame_offset(strict=True)):
        with pytest.raises(PySparkException):
            row.select(column).collect()


def test_level_cascade_against_brute_force(spark):
    """Every level down to a single tile, whatever the mosaic's size."""
    import numpy as np

    pixels = fx(spark, DATA, "fx_pixel").toPandas()
    image, expected, tiles = np.zeros((int(pixels.tile_y.max() + 1) * 8, 160), np.int64), {}, {(int(y), int(x)) for y, x in zip(pixels.tile_y, pixels.tile_x, strict=True)}
    image[pixels.tile_y * 8 + pixels.py, pixels.tile_x * 8 + pixels.px] = pixels.v
    level = 0
    while True:
        expected[level] = (len(tiles), int(image.sum()))
        if tiles == {(0, 0)}:
            break
        image = np.pad(image, [(0, -n % 16) for n in image.shape])
        image = (image.reshape(image.shape[0] // 2, 2, -1, 2).sum(axis=(1, 3)) + 2) // 4
        tiles, level = {(y // 2, x // 2) for y, x in tiles}, level + 1
    got = {r.level: (r.tiles, r.total) for r in registry.QUERIES["str02_level_cascade"](spark, DATA).collect()}
    assert level > 3 and got == expected
