"""Pixel kernels on packed tiles, and the plans that apply them.

A tile is a row with its rows, columns and samples and its bytes; it crosses into Python once, as Arrow.
Halving works tile by tile before tiles meet, so a shuffle carries a quarter of the pixels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import tables

#: Numbers that a step holds of a batch at once.
_CELLS = 1 << 16
#: Support of each filter, in pixels of the smaller image.
SUPPORT = {"nearest": 0.0, "box": 0.5, "bilinear": 1.0, "hamming": 1.0, "bicubic": 2.0, "lanczos": 3.0}


def halve(a: np.ndarray) -> np.ndarray:
    """Mean of each 2x2 block, half up; an odd last row or column is averaged with itself."""
    a = np.pad(a, [(0, a.shape[0] % 2), (0, a.shape[1] % 2)] + [(0, 0)] * (a.ndim - 2), mode="edge").astype(np.int64)
    return ((a[::2, ::2] + a[1::2, ::2] + a[::2, 1::2] + a[1::2, 1::2] + 2) >> 2).astype(np.int64)


def _kernel(name: str, x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    if name == "box":
        return (x <= 0.5).astype(float)
    if name == "bilinear":
        return np.maximum(1 - x, 0)
    if name == "hamming":
        return np.where(x < 1, np.sinc(x) * (0.54 + 0.46 * np.cos(np.pi * x)), 0)
    if name == "bicubic":  # a = -0.5
        return np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0))
    return np.where(x < 3, np.sinc(x) * np.sinc(x / 3), 0)


def _weights(n: int, to: int, name: str) -> np.ndarray:
    scale = n / to
    centre = (np.arange(to) + 0.5) * scale - 0.5
    if name == "nearest":
        out = np.zeros((to, n))
        out[np.arange(to), np.minimum(((np.arange(to) + 0.5) * scale).astype(int), n - 1)] = 1
        return out
    w = _kernel(name, (np.arange(n)[None, :] - centre[:, None]) / max(scale, 1.0))
    return w / w.sum(axis=1, keepdims=True)


def resample(a: np.ndarray, rows: int, columns: int, name: str = "bilinear") -> np.ndarray:
    """To a size, by one of six separable filters; overshoot is clamped to the type's range."""
    out = np.tensordot(_weights(a.shape[0], rows, name), a.astype(float), axes=(1, 0))
    out = np.moveaxis(np.tensordot(_weights(a.shape[1], columns, name), out, axes=(1, 1)), 0, 1)
    top = np.iinfo(a.dtype).max if a.dtype.kind == "u" else 255
    return np.clip(np.floor(out + 0.5), 0, top).astype(a.dtype)


def kernel(name: str, n: int, to: int) -> str:
    """Which kernel shrinks n pixels to `to`: strides and block means where they are the same as weights, else weights."""
    if n % to == 0 and name == "nearest":
        return "stride"
    if n % to == 0 and name == "box":
        return "blocks"
    return "weights"


def shrink(a: np.ndarray, rows: int, columns: int, name: str = "box") -> np.ndarray:
    """`resample` by the cheapest kernel that gives its result."""
    kinds = {kernel(name, a.shape[0], rows), kernel(name, a.shape[1], columns)}
    if kinds == {"stride"}:
        v, h = a.shape[0] // rows, a.shape[1] // columns
        return a[v // 2 :: v, h // 2 :: h]
    if kinds == {"blocks"}:
        v, h = a.shape[0] // rows, a.shape[1] // columns
        sums = a.astype(np.int64).reshape(rows, v, columns, h, *a.shape[2:]).sum(axis=(1, 3))
        return ((2 * sums + v * h) // (2 * v * h)).astype(a.dtype)
    return resample(a, rows, columns, name)


def pad(a: np.ndarray, rows: int, columns: int, blank: int) -> np.ndarray:
    """At the upper left of a blank tile."""
    out = np.full((rows, columns, *a.shape[2:]), blank, a.dtype)
    out[: a.shape[0], : a.shape[1]] = a
    return out


def blank_value(photometric: str) -> int:
    return 0 if photometric == "MONOCHROME2" else 255


def pack_bits(row: bytes) -> bytes:
    """PackBits of one row."""
    out, i, n = bytearray(), 0, len(row)
    while i < n:
        run = 1
        while i + run < n and run < 128 and row[i + run] == row[i]:
            run += 1
        if run > 1:
            out += bytes([257 - run, row[i]])
            i += run
            continue
        lo = i
        while i < n and i - lo < 128 and not (i + 1 < n and row[i + 1] == row[i]):
            i += 1
        out += bytes([i - lo - 1]) + row[lo:i]
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out[:size])


def rle_encode(a: np.ndarray) -> bytes:
    """A 64-byte header of segment positions, then the byte planes: samples in order, high byte first, each padded to even."""
    flat = a.reshape(*a.shape[:2], -1)
    planes = []
    for s in range(flat.shape[2]):
        plane = np.ascontiguousarray(flat[:, :, s])
        each = plane.view(np.uint8).reshape(*plane.shape, -1)
        planes += [each[:, :, b] for b in reversed(range(each.shape[2]))]
    if len(planes) > 15:
        raise ValueError("run-length frames have at most 15 segments")
    segments = []
    for p in planes:
        data = b"".join(pack_bits(r.tobytes()) for r in p)
        segments.append(data + b"\0" * (len(data) % 2))
    at = np.zeros(16, "<u4")
    at[0] = len(planes)
    at[1 : 1 + len(planes)] = 64 + np.cumsum([0, *[len(s) for s in segments[:-1]]])
    return at.tobytes() + b"".join(segments)


def rle_decode(data: bytes, rows: int, columns: int, samples: int, dtype: str) -> np.ndarray:
    at = np.frombuffer(data[:64], "<u4").astype(int)
    n, width = at[0], np.dtype(dtype).itemsize
    if n != samples * width:
        raise ValueError(f"{n} segments, {samples * width} expected")
    ends = [*at[2 : n + 1], len(data)]
    planes = [np.frombuffer(unpack_bits(data[a:b], rows * columns), np.uint8).reshape(rows, columns) for a, b in zip(at[1 : n + 1], ends, strict=True)]
    out = np.empty((rows, columns, samples, width), np.uint8)
    for s in range(samples):
        for b in range(width):
            out[:, :, s, width - 1 - b] = planes[s * width + b]
    out = out.reshape(rows, columns, samples * width).view(dtype)
    return out[:, :, 0] if samples == 1 else out


def cut(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows, so that what a step makes of one (`cells` numbers a row) stays small however many rows Spark sends at once."""
    rows = max(1, _CELLS // max(cells, 1))
    for batch in batches:
        for i in range(0, len(batch), rows):
            yield batch.slice(i, rows)


def packing(batches: Iterator[pa.RecordBatch], each: Callable[[bytes], bytes] | None = None) -> Iterator[pa.RecordBatch]:
    """Batches (vec_id, embedding of numbers from -1 to 1) to (vec_id, data), one byte a number; each: what becomes of a tile's bytes."""
    for batch in cut(batches, 64):
        v = np.floor((batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float) + 1) * 127.5).astype(np.uint8)
        data = [r.tobytes() for r in v.reshape(len(batch), -1)]
        yield pa.RecordBatch.from_pydict({"vec_id": batch.column(0), "data": pa.array([each(d) for d in data] if each else data, pa.binary())})


def apply_to_tiles(tiles: DataFrame, function, shape: tuple[int, int]) -> DataFrame:
    """Each tile's `data` through a kernel of two-dimensional 8-bit arrays; other columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, shape[0] * shape[1]):
            at = batch.schema.get_field_index("data")
            out = [None if d is None else function(np.frombuffer(d, np.uint8).reshape(shape)).astype(np.uint8).tobytes() for d in batch.column(at).to_pylist()]
            yield batch.set_column(at, "data", pa.array(out, pa.binary()))

    return tiles.mapInArrow(run, tiles.schema)


def reduce_level(tiles: DataFrame, size: int) -> DataFrame:
    """The next level: tiles (tile_x, tile_y, data of size x size) halved, then four to a tile; a missing one is blank."""
    half = size // 2
    small = apply_to_tiles(tiles.select("tile_x", "tile_y", "data"), halve, (size, size))
    keyed = small.select(F.floor(F.col("tile_x") / 2).alias("x"), F.floor(F.col("tile_y") / 2).alias("y"), (F.col("tile_x") % 2).alias("dx"), (F.col("tile_y") % 2).alias("dy"), "data")

    def put(frame: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((size, size), np.uint8)
        for dx, dy, d in zip(frame["dx"], frame["dy"], frame["data"], strict=True):
            out[dy * half : dy * half + half, dx * half : dx * half + half] = np.frombuffer(d, np.uint8).reshape(half, half)
        return pd.DataFrame({"tile_x": [frame["x"].iloc[0]], "tile_y": [frame["y"].iloc[0]], "data": [out.tobytes()]})

    return keyed.groupBy("x", "y").applyInPandas(put, "tile_x long, tile_y long, data binary")


def stitch(placed: DataFrame, key: str, size: int, parts: int | None = None) -> DataFrame:
    """Regions from their tiles: (key, w, h, data). placed: key, x, y, w, h, tile_x, tile_y, data (null is blank).

    Tiles are dealt out and sorted by region, and a task draws one region after the other. parts: over how many partitions,
    so that what a task sorts doesn't follow the input; else Spark decides.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, np.zeros((0, 0), np.uint8)
        done: list[tuple[int, int, int, bytes]] = []
        held = 0

        def batch() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(kinds)], names=[key, "w", "h", "data"])

        for rows in batches:
            for k, x, y, w, h, tx, ty, d in zip(*[c.to_pylist() for c in rows.columns], strict=True):
                if k != now:
                    if now is not None:
                        done.append((now, out.shape[1], out.shape[0], out.tobytes()))
                        held += out.size
                    now, out = k, np.zeros((h, w), np.uint8)
                    if held > 8 << 20:
                        yield batch()
                        done, held = [], 0
                if d is not None:
                    x0, y0, x1, y1 = max(x, tx * size), max(y, ty * size), min(x + w, (tx + 1) * size), min(y + h, (ty + 1) * size)
                    tile = np.frombuffer(d, np.uint8).reshape(size, size)
                    out[y0 - y : y1 - y, x0 - x : x1 - x] = tile[y0 - ty * size : y1 - ty * size, x0 - tx * size : x1 - tx * size]
        if now is not None:
            done.append((now, out.shape[1], out.shape[0], out.tobytes()))
        yield batch()

    names = [key, "x", "y", "w", "h", "tile_x", "tile_y", "data"]
    return tables.together(placed.select(*names), [key], parts=parts).mapInArrow(run, f"{key} long, w long, h long, data binary")
