"""Annotation files in the DICOM format: groups of points, lines and areas with measurements.

`dicomannotations` reads one row an annotation; `save_annotations` writes a file for each value of a
column. A group has one kind of graphic; its points follow one another in one array, and for lines and
areas a list of indices says where each annotation begins, counted from 1 in numbers. Measurements of
one code and unit are one list, with the indices of the annotations (from 1) unless each has one.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tessera import tables
from tessera.errors import AnnotationError, NotASlide
from tessera.sources import dicom
from tessera.sources import elements as E
from tessera.sources.elements import first

# Fixed values of the standard.
ANNOTATION_CLASS = "1.2.840.10008.5.1.4.1.1.91.1"
MODALITY = "ANN"
KINDS = ("POINT", "POLYLINE", "POLYGON", "ELLIPSE", "RECTANGLE")
#: Points of an annotation where the kind fixes them.
POINTS = {"POINT": 1, "ELLIPSE": 4, "RECTANGLE": 4}

_CODE = "struct<value:string,scheme:string,meaning:string>"
SCHEMA = f"path string, series_uid string, frame_of_reference string, kind_of_origin string, group_number int, group_uid string, label string, description string, graphic string, category {_CODE}, type {_CODE}, annotation_index long, points array<array<double>>, measurements array<struct<code:string,unit:string,value:double>>"


def encode_group(graphic: str, points: list[np.ndarray], measurements: dict[tuple[str, str], dict[int, float]] | None = None, double: bool = True, **more) -> dict:
    """A group's dataset. points: an (n, 2) or (n, 3) array an annotation; measurements: by (code, unit), by annotation from 0."""
    if len({p.shape[1] for p in points}) > 1:
        raise AnnotationError("points of two and three coordinates in one group")
    flat = np.concatenate([np.asarray(p, float).reshape(-1) for p in points]) if points else np.zeros(0)
    found = {k: (np.array(sorted(v), np.int64), np.array([v[i] for i in sorted(v)], float)) for k, v in (measurements or {}).items()}
    return _listed(_group(graphic, np.array([len(p) for p in points], np.int64), flat, points[0].shape[1] if points else 2, found, double) | more)


def _listed(v):
    """A dataset with lists for arrays."""
    return {k: _listed(x) for k, x in v.items()} if isinstance(v, dict) else [_listed(x) for x in v] if isinstance(v, list) else v.tolist() if isinstance(v, np.ndarray) else v


def _group(graphic: str, sizes: np.ndarray, flat: np.ndarray, width: int, measurements: dict[tuple[str, str], tuple[np.ndarray, np.ndarray]], double: bool) -> dict:
    """A group's dataset of arrays. sizes: points an annotation; measurements: annotations from 0, in order, and values."""
    if graphic not in KINDS:
        raise AnnotationError(f"no graphic kind {graphic}")
    if graphic in POINTS and (sizes != POINTS[graphic]).any():
        raise AnnotationError(f"a {graphic} has {POINTS[graphic]} points")
    out = {"GraphicType": graphic, "NumberOfAnnotations": len(sizes), "DoublePointCoordinatesData" if double else "PointCoordinatesData": flat}
    if graphic not in POINTS:
        out["LongPrimitivePointIndexList"] = (np.cumsum(sizes) - sizes) * width + 1
    items = []
    for (code, unit), (order, values) in sorted(measurements.items()):
        if len(order) and not 0 <= order[0] <= order[-1] < len(sizes):
            raise AnnotationError("a measurement of an annotation that isn't there")
        lists = {"FloatingPointValues": values}
        if not np.array_equal(order, np.arange(len(sizes))):
            lists["AnnotationIndexList"] = order + 1
        items.append({"ConceptNameCodeSequence": [_code(code)], "MeasurementUnitsCodeSequence": [_code(unit)], "MeasurementValuesSequence": [lists]})
    if items:
        out["MeasurementsSequence"] = items
    return out


def _code(value: str, meaning: str | None = None, scheme: str = "99LOCAL") -> dict:
    return {"CodeValue": value, "CodingSchemeDesignator": scheme, "CodeMeaning": meaning or value}


def decode_group(g: dict, width: int = 2) -> tuple[list[np.ndarray], list[list[tuple[str, str, float]]]]:
    """Points and (code, unit, value) measurements of each annotation of a group."""
    rows = list(_decoded(g, width))
    return [p for p, _ in rows], [m for _, m in rows]


def _array(d: dict, kind: type, *names: str) -> np.ndarray:
    return np.asarray(next((d[k] for k in names if d.get(k) is not None and len(d[k])), []), kind)


def _decoded(g: dict, width: int) -> Iterator[tuple[np.ndarray, list[tuple[str, str, float]]]]:
    """Points and measurements of one annotation after the other; lists may be arrays, and stay so."""
    n, graphic = g.get("NumberOfAnnotations") or 0, g.get("GraphicType")
    double = _array(g, np.float64, "DoublePointCoordinatesData")
    flat = double if len(double) else _array(g, np.float32, "PointCoordinatesData")
    if graphic in POINTS:
        if len(flat) != n * POINTS[graphic] * width:
            raise AnnotationError(f"{len(flat)} coordinates for {n} annotations")
        cuts = np.arange(n + 1) * POINTS[graphic] * width
    else:
        index = _array(g, np.int64, "LongPrimitivePointIndexList") - 1
        if len(index) != n or (n and (index[0] != 0 or (np.diff(index) <= 0).any() or index[-1] >= len(flat) or (index % width).any())):
            raise AnnotationError("the list of indices doesn't fit the points")
        cuts = np.append(index, len(flat))
    lists = []
    for m in g.get("MeasurementsSequence") or []:
        d = (first(m, "MeasurementValuesSequence") or [{}])[0]
        values, some = _array(d, np.float32, "FloatingPointValues"), d.get("AnnotationIndexList") is not None
        where = _array(d, np.int64, "AnnotationIndexList") if some else np.arange(1, n + 1)
        if len(where) != len(values):
            raise AnnotationError("as many measurements as annotations or indices are wanted")
        if len(where) and not 1 <= where.min() <= where.max() <= n:
            raise AnnotationError(f"a measurement of annotation {where.min()} or {where.max()} of {n}")
        order = np.argsort(where, kind="stable")
        lists.append((*(first(m, f"{k}Sequence", "CodeValue") for k in ("ConceptNameCode", "MeasurementUnitsCode")), where[order] - 1, values[order]))
    step = 10_000  # annotations at a time become Python's numbers
    for lo in range(0, n, step):
        hi = min(lo + step, n)
        found: list[list[tuple[str, str, float]]] = [[] for _ in range(hi - lo)]
        for code, unit, where, values in lists:
            a, b = np.searchsorted(where, [lo, hi])
            for i, v in zip((where[a:b] - lo).tolist(), values[a:b].tolist(), strict=True):
                found[i].append((code, unit, v))
        for i, (a, b) in enumerate(zip(cuts[lo:hi].tolist(), cuts[lo + 1 : hi + 1].tolist(), strict=True)):
            yield flat[a:b].astype(float).reshape(-1, width), found[i]


def write_annotations(path: str, groups: list[dict], series: str, frame_of_reference: str | None = None, volume: bool = False, syntax: str = dicom.EXPLICIT) -> None:
    """An annotation file. volume: places are on the slide in three coordinates, which needs a frame of reference; else pixels of the image."""
    if volume and not frame_of_reference:
        raise AnnotationError("places on the slide need a frame of reference")
    values = {
        "SOPClassUID": ANNOTATION_CLASS, "SOPInstanceUID": f"{series}.1", "Modality": MODALITY, "SeriesInstanceUID": series, "StudyInstanceUID": "1.2.3", "AnnotationCoordinateType": "3D" if volume else "2D",
        "AnnotationGroupSequence": [{"AnnotationGroupNumber": k + 1, **g} for k, g in enumerate(groups)],
    }
    if frame_of_reference:
        values["FrameOfReferenceUID"] = frame_of_reference
    dicom.write_dataset(path, values, syntax)


class _Reader(DataSourceReader):
    """One partition a file. Files of other classes or modalities, and places on the slide without a frame of reference, are left out."""

    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return dicom.whole_files(self.options["path"])

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path, *_ in partition.files:
            yield from self.rows(path)

    def rows(self, path: str) -> Iterator[tuple]:
        with dicom.open_stream(path) as f:
            try:
                v = dicom.read_header(f, arrays=True).values
            except (NotASlide, E.Truncated, struct.error, UnicodeDecodeError):
                return
        volume = v.get("AnnotationCoordinateType") == "3D"
        if v.get("SOPClassUID") != ANNOTATION_CLASS or v.get("Modality") != MODALITY or volume and not v.get("FrameOfReferenceUID"):
            return
        code = lambda s: None if not s else tuple(s[0].get(k) for k in ("CodeValue", "CodingSchemeDesignator", "CodeMeaning"))
        for g in v.get("AnnotationGroupSequence") or []:
            head = (
                path, v.get("SeriesInstanceUID"), v.get("FrameOfReferenceUID"), "volume" if volume else "image", g.get("AnnotationGroupNumber"), g.get("AnnotationGroupUID"), g.get("AnnotationGroupLabel"), g.get("AnnotationGroupDescription"),
                g.get("GraphicType"), code(g.get("AnnotationPropertyCategoryCodeSequence")), code(g.get("AnnotationPropertyTypeCodeSequence")),
            )
            for i, (points, found) in enumerate(_decoded(g, 3 if volume else 2)):
                yield (*head, i, points.tolist(), found)


class DicomAnnotations(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dicomannotations"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DicomAnnotations)


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, set[int], dict[tuple[str, str], tuple[np.ndarray, np.ndarray]]]:
    """Points an annotation, coordinates, numbers of coordinates a point, and measurements by code and unit, of rows of one group."""
    points = batch.column("points")
    flat = points.flatten()
    widths = set(pc.unique(pc.list_value_length(flat)).to_pylist())
    sizes = pc.fill_null(pc.list_value_length(points), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    found: dict[tuple[str, str], dict[int, float]] = {}
    for i, rows in enumerate(batch.column("measurements").to_pylist()):
        for m in rows or ():
            found.setdefault((m["code"], m["unit"]), {})[i] = m["value"]
    return sizes, flat.flatten().to_numpy(zero_copy_only=False).astype(float), widths, {k: (np.fromiter(v, np.int64), np.fromiter(v.values(), float)) for k, v in found.items()}


def save_annotations(annotations: DataFrame, folder: str, *, double: bool = True, volume: bool = False, syntax: str = dicom.EXPLICIT) -> DataFrame:
    """Writes (file, group_id, graphic, label, annotation_id, points, measurements) rows, a file a value of `file`; returns (file, path, annotations).

    Annotations go into their group in order of annotation_id. A task holds one file's annotations as arrays, as the
    format has them in one element. measurements: array of (code, unit, value) or null.
    """
    from tessera.sources.sinks import prepare_folder

    folder = prepare_folder(folder)

    def finished(key: int, gid: int, graphic: str, label: str, parts: list[tuple]) -> dict:
        widths = {w for p in parts for w in p[2]}
        if len(widths) > 1:
            raise AnnotationError("points of two and three coordinates in one group")
        begins = np.cumsum([0, *[len(p[0]) for p in parts]])
        found: dict[tuple[str, str], list[tuple[np.ndarray, np.ndarray]]] = {}
        for begin, p in zip(begins, parts, strict=False):
            for k, (i, v) in p[3].items():
                found.setdefault(k, []).append((i + begin, v))
        sizes, flat = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        parts.clear()
        measurements = {k: tuple(np.concatenate([x[i] for x in v]) for i in (0, 1)) for k, v in found.items()}
        head = {"AnnotationGroupUID": f"1.2.3.{key}.{gid}", "AnnotationGroupLabel": label, "AnnotationGroupGenerationType": "MANUAL", "AnnotationPropertyCategoryCodeSequence": [_code("91723000", "Anatomical structure", "SCT")], "AnnotationPropertyTypeCodeSequence": [_code("4421005", "Cell", "SCT")]}
        return _group(graphic, sizes, flat, next(iter(widths), 2), measurements, double) | head

    def store(key: int, groups: list[dict]) -> tuple[int, str, int]:
        path = os.path.join(folder, f"{key}.dcm")
        partial = f"{path}.{os.getpid()}.part"
        write_annotations(partial, groups, f"1.2.3.{key}", f"1.2.3.{key}.2" if volume else None, volume, syntax)
        os.replace(partial, path)
        return key, path, sum(g["NumberOfAnnotations"] for g in groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[dict] = []
        parts: list[tuple] = []  # of the group that isn't finished
        at, done = None, []

        def close() -> None:
            groups.append(finished(*at, parts))

        for batch in batches:
            heads = list(zip(*[batch.column(c).to_pylist() for c in ("file", "group_id", "graphic", "label")], strict=True))
            cuts = [0, *[i for i in range(1, len(heads)) if heads[i][:2] != heads[i - 1][:2]], len(heads)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if at is not None and heads[a][:2] != at[:2]:
                    close()
                    if heads[a][0] != at[0]:
                        done.append(store(at[0], groups))
                        groups.clear()
                    at = None
                at = at or heads[a]
                parts.append(_columns(batch.slice(a, b - a)))
        if at is not None:
            close()
            done.append(store(at[0], groups))
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate((pa.int64(), pa.string(), pa.int64()))], names=["file", "path", "annotations"])

    return tables.together(annotations, ["file"], "group_id", "annotation_id").mapInArrow(run, "file long, path string, annotations long")
