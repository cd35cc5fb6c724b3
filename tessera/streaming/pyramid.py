"""Building a pyramid from tiles that arrive in any order.

A 2x2 block of tiles is reduced when all of its members that exist have arrived (blocks at the edge have
fewer, and so have those of a level with gaps, which tiles say themselves); what has come so far is the block's state, and goes when the block is emitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.pixels import halve

_OUT = "tile_x long, tile_y long, data binary"
_STATE = "xs array<int>, ys array<int>, data array<binary>"


def members(x: int, y: int, tiles_x: int, tiles_y: int) -> int:
    """Tiles of the level below that a block at (x, y) has."""
    return max(0, min(2, tiles_x - 2 * x)) * max(0, min(2, tiles_y - 2 * y))


def with_members(tiles: DataFrame) -> DataFrame:
    """Stored tiles with the number of those in their block."""
    block = [F.floor(F.col(c) / 2).alias(f"block_{c}") for c in ("tile_x", "tile_y")]
    there = tiles.select("tile_x", "tile_y").distinct().groupBy(*block).agg(F.count("*").cast("int").alias("members"))
    return tiles.select("*", *block).join(there, ["block_tile_x", "block_tile_y"]).drop("block_tile_x", "block_tile_y")


def accumulate(tiles: DataFrame, size: int, tiles_x: int, tiles_y: int) -> DataFrame:
    """A stream (tile_x, tile_y, data) of one level to the stream of the next.

    A column `members` says how many tiles of its block there are; without it the whole grid is expected.
    """
    said = "members" in tiles.columns
    half = size // 2

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        x, y = key
        xs, ys, data = ([list(s) for s in state.get] if state.exists else [[], [], []])
        wanted = None if said else members(x, y, tiles_x, tiles_y)
        for frame in frames:
            if said and len(frame):
                wanted = int(frame["members"].iloc[0])
            for tx, ty, d in zip(frame["tile_x"], frame["tile_y"], frame["data"], strict=True):
                small = halve(np.frombuffer(d, np.uint8).reshape(size, size)).astype(np.uint8).tobytes()
                at = (int(tx % 2), int(ty % 2))
                have = list(zip(xs, ys, strict=True))
                if at in have:  # the last one to arrive counts
                    data[have.index(at)] = small
                else:
                    xs.append(at[0])
                    ys.append(at[1])
                    data.append(small)
        if wanted is None or len(data) < wanted:
            state.update((xs, ys, data))
            return
        if state.exists:
            state.remove()
        out = np.zeros((size, size), np.uint8)
        for dx, dy, d in zip(xs, ys, data, strict=True):
            out[dy * half : dy * half + half, dx * half : dx * half + half] = np.frombuffer(d, np.uint8).reshape(half, half)
        yield pd.DataFrame({"tile_x": [x], "tile_y": [y], "data": [out.tobytes()]})

    blocks = tiles.withColumns({"x": F.floor(F.col("tile_x") / 2), "y": F.floor(F.col("tile_y") / 2)})
    return blocks.groupBy("x", "y").applyInPandasWithState(run, _OUT, _STATE, "append", "NoTimeout")
