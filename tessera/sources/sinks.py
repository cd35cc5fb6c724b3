"""Writing slides: one file an instance part, its frames in order."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import tables
from tessera.sources import dicom

_RESULT = "slide long, part long, path string, n_frames long, bytes long"


class NotEmpty(FileExistsError):
    """The output folder has files already."""


def prepare_folder(folder: str) -> str:
    """Creates the folder; refuses one that isn't empty."""
    folder = folder.removeprefix("file://")
    os.makedirs(folder, exist_ok=True)
    if os.listdir(folder):
        raise NotEmpty(folder)
    return folder


def _values(r: dict, tile: int, samples: int, bits: int, photometric: str, sparse: list[tuple[int, int]] | None, parts: bool, kind: str) -> dict:
    """A file's header from the first row of its frames."""
    uid, across, whole = f"1.2.3.{r['slide']}", int(r["across"]), int(r["whole"])
    out = {
        "ImageType": ["ORIGINAL", "PRIMARY", kind, "NONE"], "SOPInstanceUID": f"{uid}.{r['part'] + 1}" if parts else uid, "StudyInstanceUID": "1.2.3", "SeriesInstanceUID": f"{uid}.1", "FrameOfReferenceUID": f"{uid}.2", "Modality": "SM",
        "DimensionOrganizationType": "TILED_SPARSE" if sparse else "TILED_FULL", "SamplesPerPixel": samples, "PhotometricInterpretation": photometric, "NumberOfFrames": int(r["frames"]), "Rows": tile, "Columns": tile,
        "BitsAllocated": bits, "BitsStored": bits, "HighBit": bits - 1, "PixelRepresentation": 0, "TotalPixelMatrixColumns": across * tile, "TotalPixelMatrixRows": -(-whole // across) * tile, "TotalPixelMatrixFocalPlanes": 1, "NumberOfOpticalPaths": 1,
        "SharedFunctionalGroupsSequence": [{"PixelMeasuresSequence": [{"PixelSpacing": [0.0005, 0.00025], "SliceThickness": 0.001}]}], "OpticalPathSequence": [{"OpticalPathIdentifier": "0"}],
        "TotalPixelMatrixOriginSequence": [{"XOffsetInSlideCoordinateSystem": 10.0, "YOffsetInSlideCoordinateSystem": 20.0}], "ImageOrientationSlide": [0.0, -1.0, 0.0, -1.0, 0.0, 0.0],
    }
    if samples > 1:
        out["PlanarConfiguration"] = 0
    if parts:
        out |= {"ConcatenationUID": f"{uid}.0", "SOPInstanceUIDOfConcatenationSource": f"{uid}.9", **dicom.numbered(int(r["part"]) + 1), "ConcatenationFrameOffsetNumber": int(r["first"])}
    if sparse:
        place = lambda x, y: {"PlanePositionSlideSequence": [{"ColumnPositionInTotalImagePixelMatrix": x * tile + 1, "RowPositionInTotalImagePixelMatrix": y * tile + 1, "ZOffsetInSlideCoordinateSystem": 0.0}]}
        out["PerFrameFunctionalGroupsSequence"] = [place(x, y) for x, y in sparse]
    return out


def save_slides(
    frames: DataFrame, folder: str, *, tile: int, columns: str, syntax: str = dicom.EXPLICIT, table: str = "basic", samples: int = 1, bits: int = 8, photometric: str = "MONOCHROME2",
    per_part: int | None = None, sparse: bool = False, undefined: bool = False, kind: str = "VOLUME",
) -> DataFrame:
    """Writes each slide's frames (slide, frame_index, data) in order to a file, or to one for every per_part frames; returns (slide, part, path, n_frames, bytes).

    The folder is one that all executors share. columns: name of the column with the tiles in a row.
    sparse: frames say their places themselves, in tile_x and tile_y. Frames are dealt out by file and sorted, and go through a task one
    after the other; only their places are held. A task that is run again writes the same file anew.
    """
    folder = prepare_folder(folder)
    part = F.floor(F.col("frame_index") / per_part) if per_part else F.lit(0).cast("bigint")
    place = [F.col("tile_x").cast("bigint"), F.col("tile_y").cast("bigint")] if sparse else [F.lit(0).cast("bigint")] * 2
    rows = frames.select(F.col("slide").cast("bigint").alias("slide"), part.alias("part"), F.col("frame_index").cast("bigint").alias("frame_index"), F.col(columns).cast("bigint").alias("across"), place[0].alias("x"), place[1].alias("y"), "data").where("slide is not null and part is not null")
    sizes = rows.groupBy("slide", "part").agg(F.count("*").alias("frames"), F.min("frame_index").alias("first"), F.min_by("across", F.struct("frame_index", "across")).alias("across"), F.sort_array(F.collect_list(F.struct("frame_index", "x", "y"))).alias("at") if sparse else F.lit(None).cast("array<struct<x:bigint,y:bigint>>").alias("at"))
    whole = rows.groupBy("slide").agg(F.max("frame_index").alias("last")).select("slide", (F.col("last") + 1).alias("whole"))
    heads = sizes.join(whole, "slide").withColumn("head", F.lit(True))
    body = rows.select("slide", "part", "frame_index", "data", F.lit(False).alias("head"))
    ordered = tables.together(heads.unionByName(body, allowMissingColumns=True), ["slide", "part"], F.desc("head"), "frame_index")  # a file's frames come after what its header says

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, key, partial, done = None, None, "", []

        def finish() -> None:
            writer.close()
            path = partial.rsplit(".", 2)[0]
            os.replace(partial, path)
            done.append((*key, path, writer.n, os.path.getsize(path)))

        for batch in batches:
            names = batch.schema.names
            for values in zip(*[batch.column(i).to_pylist() for i in range(len(names))], strict=True):
                r = dict(zip(names, values, strict=True))
                if r["head"]:
                    if writer is not None:
                        finish()
                    key = (r["slide"], r["part"])
                    name = f"{r['slide']}-{r['part']}" if per_part else str(r["slide"])
                    partial = os.path.join(folder, f"{name}.dcm.{os.getpid()}.part")
                    at = [(p["x"], p["y"]) for p in r["at"]] if sparse else None
                    writer = dicom.FrameWriter(partial, _values(r, tile, samples, bits, photometric, at, bool(per_part), kind), syntax, table, undefined)
                else:
                    writer.add(r["data"])
        if writer is not None:
            finish()
        columns_ = list(zip(*done, strict=True)) or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns_, kinds, strict=True)], names=["slide", "part", "path", "n_frames", "bytes"])

    return ordered.mapInArrow(write, _RESULT)
