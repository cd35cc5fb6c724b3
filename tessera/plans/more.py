"""Further queries over geometry, sources, codes and pixels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.operators import pixels as P
from tessera.operators import tiles as T
from tessera.plans.fixtures import fx
from tessera.plans.pixels import packed, unpacked
from tessera.plans.registry import query


@query("geo05_region_ends", "SELECT request_id, x + w AS x1, y + h AS y1, (x + w) * 3 AS x3 FROM fx_request")
def region_ends(spark, sf):
    end = F.col("x") + F.col("w")
    return fx(spark, sf, "fx_request").select("request_id", end.alias("x1"), (F.col("y") + F.col("h")).alias("y1"), (end * 3).alias("x3"))


@query("geo09_iterate_region", "SELECT request_id, px, py FROM (SELECT request_id, w, unnest(generate_series(0, h % 5)) AS py FROM fx_request) r, LATERAL (SELECT unnest(generate_series(0, r.w % 6)) AS px) u")
def iterate_region(spark, sf):
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), c))
    return fx(spark, sf, "fx_request").withColumn("py", upto(F.col("h") % 5)).withColumn("px", upto(F.col("w") % 6)).select("request_id", "px", "py")


@query("geo10_region_mm_shift", "SELECT request_id, round(x * 0.001E0 + 2.5E0, 6) AS x0, round(x * 0.001E0 + 2.5E0 + w * 0.001E0, 6) AS x1 FROM fx_request")
def region_mm_shift(spark, sf):
    x0 = F.col("x") * 0.001 + 2.5
    return fx(spark, sf, "fx_request").select("request_id", F.round(x0, 6).alias("x0"), F.round(x0 + F.col("w") * 0.001, 6).alias("x1"))


@query("lim02_top_per_key", "SELECT slide_id, file_id FROM (SELECT slide_id, file_id, row_number() OVER (PARTITION BY slide_id ORDER BY total_columns DESC, file_id) AS rn FROM fx_header) WHERE rn = 1")
def top_per_key(spark, sf):
    return fx(spark, sf, "fx_header").groupBy("slide_id").agg(F.max_by("file_id", F.struct(F.col("total_columns"), -F.col("file_id"))).alias("file_id"))


@query("srt03_tile_order", "SELECT slide_id, frame_no, rank() OVER (PARTITION BY slide_id ORDER BY path, z, row_pos, col_pos) AS nth FROM fx_sparse_frame")
def tile_order(spark, sf):
    return fx(spark, sf, "fx_sparse_frame").select("slide_id", "frame_no", F.rank().over(Window.partitionBy("slide_id").orderBy("path", "z", "row_pos", "col_pos")).cast("bigint").alias("nth"))


@query("str03_resequenced", "SELECT identifier, frame_index, CAST(sum(byte_len) OVER (PARTITION BY identifier ORDER BY frame_index) AS BIGINT) AS upto FROM fx_frame_len")
def resequenced(spark, sf):
    """Frames that arrive out of order, in the order of the file again."""
    shuffled = fx(spark, sf, "fx_frame_len").repartition(7, F.xxhash64("frame_index"))
    return T.offsets(shuffled, item_header=0).select("identifier", "frame_index", (F.col("offset") + F.col("byte_len")).alias("upto"))
