"""Slides from other formats: a small interface, and arrays in .npy files as an example of it.

A source that can list images and cut tiles of them is made known to Spark by subclassing SlideSource;
its rows have the columns of SCHEMA, whatever it reads, so all operators on frames work on them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tessera.sources import dicom

SCHEMA = "path string, identifier string, kind string, width long, height long, samples int, tile_x long, tile_y long, data binary"


@dataclass
class Image:
    """One image of a source: kind is VOLUME, LABEL, OVERVIEW or THUMBNAIL."""

    identifier: str
    kind: str
    width: int
    height: int
    samples: int
    tile: int


class SlideSource(DataSource):
    """Subclasses say their name, list images of a path, and cut a tile; the last two run in the tasks, one path each."""

    def images(self, path: str) -> Iterator[Image]:
        raise NotImplementedError

    def tile(self, path: str, image: Image, x: int, y: int) -> np.ndarray:
        raise NotImplementedError

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self)


class _Reader(DataSourceReader):
    def __init__(self, source: SlideSource) -> None:
        self.source = source

    def partitions(self) -> list[InputPartition]:
        return dicom.whole_files(self.source.options["path"])

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path, i in ((p, i) for p, *_ in partition.files for i in self.source.images(p)):
            for y in range(-(-i.height // i.tile)):
                for x in range(-(-i.width // i.tile)):
                    yield path, i.identifier, i.kind, i.width, i.height, i.samples, x, y, np.ascontiguousarray(self.source.tile(path, i, x, y)).tobytes()


class ArraySlides(SlideSource):
    """Arrays (rows, columns) or (rows, columns, samples) of bytes in .npy files; option tile: side of a tile, unless given the whole image is one."""

    @classmethod
    def name(cls) -> str:
        return "arrayslides"

    def _array(self, path: str) -> np.ndarray:
        return np.load(path, mmap_mode="r")  # only the tiles that are cut are read

    def images(self, path: str) -> Iterator[Image]:
        a = self._array(path)
        yield Image(path.rsplit("/", 1)[-1].removesuffix(".npy"), "VOLUME", a.shape[1], a.shape[0], a.shape[2] if a.ndim > 2 else 1, int(self.options.get("tile", max(a.shape[:2]))))

    def tile(self, path: str, image: Image, x: int, y: int) -> np.ndarray:
        return self._array(path)[y * image.tile : (y + 1) * image.tile, x * image.tile : (x + 1) * image.tile]
