"""How frames are laid out in files: splits, order, levels to read or derive."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import tables

#: 1024-based units of sizes.
UNITS = {"": 1, "B": 1, "K": 1 << 10, "KB": 1 << 10, "M": 1 << 20, "MB": 1 << 20, "G": 1 << 30, "GB": 1 << 30}


def parse_size(text: Column) -> Column:
    """Bytes of "100MB", "2G" or "512"; null for anything else."""
    number = F.regexp_extract(text, r"^\s*(\d+)\s*([A-Za-z]*)\s*$", 1)
    unit = F.upper(F.regexp_extract(text, r"^\s*(\d+)\s*([A-Za-z]*)\s*$", 2))
    factor = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    return F.when(number != "", number.cast("bigint") * F.try_element_at(factor, unit))


def split_by_frames(frames: DataFrame, count: int, key: str = "identifier", order: str = "frame_index") -> DataFrame:
    """Part of each frame: a cut every `count` frames."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return frames.withColumn("part", F.floor((n - 1) / count))


def split_by_bytes(frames: DataFrame, most: int, item_header: int = 8, key: str = "identifier", order: str = "frame_index", length: str = "byte_len") -> DataFrame:
    """(key, order, part): greedy, a new part where the next item would go beyond `most`; a part takes one at least.

    The running size starts anew with every part, so no window frame expresses it. Frames are dealt out by
    instance and sorted, and one running size goes through them: linear, and nothing is held.
    """
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, held = None, 0, 0
        for batch in batches:
            out = []
            for k, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                size = n + item_header
                if k != now:
                    now, part, held = k, 0, 0
                elif held + size > most:
                    part, held = part + 1, 0
                held += size
                out.append(part)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], names=[key, order, "part"])

    return tables.together(frames.select(key, order, length), [key], order).mapInArrow(run, f"{key} {kinds[key]}, {order} {kinds[order]}, part long")


def select_levels(levels: DataFrame, positions: list[int] | None) -> DataFrame:
    """Levels by position from the top, negative ones from the end; out of range is ignored, None is all."""
    if positions is None:
        return levels
    w = Window.partitionBy("slide_id")
    nth, n = F.row_number().over(w.orderBy("level")) - 1, F.count("*").over(w)
    rows = levels.withColumns({"nth": nth, "n": n})
    return rows.where(F.col("nth").isin(positions) | (F.col("nth") - F.col("n")).isin(positions)).drop("nth", "n")


def plan_levels(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """How each wanted level is made: read where it is stored, else derived from the nearest stored one below."""
    have = stored.groupBy("slide_id").agg(F.collect_set("level").alias("have"))
    rows = wanted.join(have, "slide_id", "left")
    source = F.array_max(F.filter("have", lambda h: h <= F.col("level")))
    return rows.select("slide_id", "level", source.alias("source"), (source == F.col("level")).alias("read"))
