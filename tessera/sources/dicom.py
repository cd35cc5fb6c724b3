"""Slide files in the DICOM format as Spark data sources.

`dicomslides` reads one row a file with the typed header, and never the pixels; `dicomframes` one row a
frame with its place in the file and in the image, and its bytes. Paths may be folders, files, patterns
or a DICOMDIR manifest, on the local disk or on any store that Arrow opens by its address. Files that
aren't slides, can't be read to the pixels, or have none, are left out; a table of frames that
contradicts its header is an error.

Options: path; classes (SOP classes to read, comma-separated); data=false leaves the frames' bytes
unread. A large file is read in several partitions, each some ranges of its frames; many small files or
ranges go into one partition, so that their number follows the bytes and not the files.
"""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tessera.errors import FrameTableError, NotASlide
from tessera.sources import elements as E
from tessera.sources.elements import ITEM, PIXELS, SEQUENCE_END, UNDEFINED, first

# Fixed values of the standard.
IMPLICIT, EXPLICIT, RLE, JPEG = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.5", "1.2.840.10008.1.2.4.50"
SLIDE_CLASS = "1.2.840.10008.5.1.4.1.1.77.1.6"
TIFF_OFFSETS, TIFF_LENGTHS = (324, 273), (325, 279)

HEADER = """path string, sop_class string, transfer_syntax string, uid string, study_uid string, series_uid string, frame_of_reference string, concat_uid string, concat_source string, concat_number int, concat_offset long,
image_type string, photometric string, organization string, samples int, bits int, representation int, planar int, tile_rows int, tile_columns int, total_rows long, total_columns long, n_frames long, planes int, paths int, path_ids array<string>,
spacing_x double, spacing_y double, spacing_between double, thickness double, depth_mm double, origin_x double, origin_y double, origin_z double, shared_z double, orientation array<double>, focus_method string, ext_dof string, ext_planes int, ext_distance double,
lossy string, lossy_ratios array<string>, lossy_methods array<string>, per_frame boolean, frame_table string, pixels_at long"""
FRAME = "path string, identifier string, frame_index long, tile_x long, tile_y long, z double, optical_path string, byte_offset long, byte_length long, data binary"
_SPLIT = 64 << 20
#: Up to so many files or ranges there is a partition for each; a partition holds at most so many files.
_LEAST_PARTS, _MOST_FILES = 64, 256
#: Element that counts a concatenation's files where InConcatenationNumber, of 16 bits, can't: private, of this creator.
PART_CREATOR = "TESSERA PARTS"


@dataclass
class Header:
    values: dict = field(default_factory=dict)
    syntax: str = EXPLICIT
    #: Where the pixel element's value begins (-1 without one), and its length (UNDEFINED if encapsulated).
    pixels_at: int = -1
    pixels_length: int = 0
    #: The preamble: zeros, or the head of a TIFF file that shares the frames.
    preamble: bytes = b""


def read_header(f, of_frames: Callable[[int], range] | None = None, arrays: bool = False) -> Header:
    """The dataset up to the pixels, whose value isn't read. of_frames: the frames, of how many there are, whose own items are read; the first one's always is."""
    preamble = f.read(132)
    if preamble[128:] != b"DICM":
        raise NotASlide("no preamble")
    header = Header(preamble=preamble[:128])
    while True:
        at = f.tell()
        e = E.head(f, True)
        if e is None or e[0][0] != 2:
            f.seek(at)
            break
        raw = f.read(e[2])
        if e[0] == (2, 0x0010):
            header.syntax = raw.rstrip(b"\0 ").decode()
    header.values = E.parse(f, header.syntax != IMPLICIT, wanted=of_frames and {"PerFrameFunctionalGroupsSequence": lambda v: of_frames(frame_count(v))}, arrays=arrays)
    header.pixels_at, header.pixels_length = header.values.pop("", (-1, 0))
    return header


def frame_count(v: dict) -> int:
    n = v.get("NumberOfFrames")
    return 1 if n is None else n


def _native(f, h: Header) -> list[tuple[int, int]]:
    v = h.values
    size = v["Rows"] * v["Columns"] * v["SamplesPerPixel"] * (v["BitsAllocated"] // 8)
    n = min(frame_count(v), h.pixels_length // size if size else 0)
    return [(h.pixels_at + i * size, size) for i in range(n)]


def _between(f, start: int, offsets: list[int]) -> list[tuple[int, int]]:
    """Frames of a table of offsets: each ends where the next item begins; the last one's head says its length."""
    if offsets[0] != 0:
        raise FrameTableError("the offset table doesn't begin at 0")
    f.seek(start + offsets[-1])
    last = E.head(f, True)
    if last is None or last[0] != ITEM:
        raise FrameTableError("the last offset doesn't lead to an item")
    sizes = [b - a - 8 for a, b in zip(offsets, offsets[1:], strict=False)] + [last[2]]
    if any(n <= 0 or n % 2 for n in sizes):
        raise FrameTableError("a frame's length is odd or not positive")
    return [(start + a + 8, n) for a, n in zip(offsets, sizes, strict=True)]


def _items(f, start: int) -> list[tuple[int, int]]:
    """Frames by walking from item to item."""
    f.seek(start)
    out = []
    while (e := E.head(f, True)) is not None and e[0] == ITEM:
        if e[2] == 0 or e[2] % 2:
            raise FrameTableError("an item's length is odd or zero")
        out.append((f.tell(), e[2]))
        f.seek(e[2], 1)
    return out


def _tiff(f, preamble: bytes) -> list[tuple[int, int]]:
    """Frames by the tags of a TIFF file that shares them; none if the preamble isn't its head."""
    kinds = {3: "H", 4: "I", 16: "Q"}
    if preamble[:4] not in (b"II*\0", b"II+\0"):
        return []
    big = preamble[2] == 0x2B
    where = struct.unpack("<Q", preamble[8:16])[0] if big else struct.unpack("<I", preamble[4:8])[0]
    f.seek(where)
    n = struct.unpack("<Q" if big else "<H", f.read(8 if big else 2))[0]
    size, inline = (20, 8) if big else (12, 4)
    entries = f.read(size * n)
    tags: dict[int, tuple[int, ...]] = {}
    for i in range(n):
        tag, kind, count = struct.unpack("<HHQ" if big else "<HHI", entries[size * i : size * i + size - inline])
        if kind not in kinds:
            continue
        raw = entries[size * (i + 1) - inline : size * (i + 1)]
        length = count * struct.calcsize(kinds[kind])
        if length > inline:
            f.seek(struct.unpack("<Q" if big else "<I", raw)[0])
            raw = f.read(length)
        tags[tag] = struct.unpack(f"<{count}{kinds[kind]}", raw[:length])
    at, sizes = (next((tags[t] for t in names if t in tags), ()) for names in (TIFF_OFFSETS, TIFF_LENGTHS))
    return list(zip(at, sizes, strict=True))


def frame_index(f, h: Header) -> tuple[str, list[tuple[int, int]]]:
    """How the frames were found, and (position, length) of each: by arithmetic, by the first table there is, else by walking the items."""
    n = frame_count(h.values)
    if h.pixels_at < 0:
        raise NotASlide("no pixels")
    if h.pixels_length != UNDEFINED:
        kind, out = "native", _native(f, h)
    else:
        f.seek(h.pixels_at)
        table = E.head(f, True)
        if table is None or table[0] != ITEM:
            raise FrameTableError("no item for the offset table")
        basic = f.read(table[2])
        start = f.tell()
        extended, lengths = h.values.get("ExtendedOffsetTable"), h.values.get("ExtendedOffsetTableLengths")
        if extended:
            if len(extended) != len(lengths or ()):
                raise FrameTableError("the extended table has other numbers of offsets and lengths")
            kind, out = "extended", [(start + a + 8, size) for a, size in zip(extended, lengths, strict=True)]
        elif basic:
            kind, out = "basic", _between(f, start, list(struct.unpack(f"<{len(basic) // 4}I", basic)))
        elif tiff := _tiff(f, h.preamble):
            kind, out = "tiff", tiff
        else:
            kind, out = "items", _items(f, start)
    if len(out) != n:
        raise FrameTableError(f"{len(out)} frames are there, {n} expected")
    return kind, out


def frames(f, h: Header) -> Iterator[tuple[int, int]]:
    """(position, length) of each frame."""
    yield from frame_index(f, h)[1]


def places(h: Header, which: range) -> Iterator[tuple[int, int, float | None, str | None]]:
    """Column and row of the tile, focal plane (micrometres) and optical path of the frames: as they say themselves, else by their order."""
    v = h.values
    per_frame = v.get("PerFrameFunctionalGroupsSequence") or []
    ids = [p.get("OpticalPathIdentifier") for p in v.get("OpticalPathSequence") or []]
    z0 = first(v, "TotalPixelMatrixOriginSequence", "ZOffsetInSlideCoordinateSystem")
    if z0 is None:
        z0 = first(v, "SharedFunctionalGroupsSequence", "PlanePositionSlideSequence", "ZOffsetInSlideCoordinateSystem") or 0.0
    if v.get("DimensionOrganizationType") != "TILED_FULL" and per_frame and "PlanePositionSlideSequence" in per_frame[0]:
        for i in which:
            at = first(per_frame[i], "PlanePositionSlideSequence") or [{}]
            path = first(per_frame[i], "OpticalPathIdentificationSequence", "OpticalPathIdentifier")
            column, row = (first(at, k) for k in ("ColumnPositionInTotalImagePixelMatrix", "RowPositionInTotalImagePixelMatrix"))
            z = first(at, "ZOffsetInSlideCoordinateSystem")
            yield (column - 1) // v["Columns"], (row - 1) // v["Rows"], round(float(z0 if z is None else z), 3), str(path if path is not None else ids[0] if ids else "0")
        return
    across = -(-(v.get("TotalPixelMatrixColumns") or v["Columns"]) // v["Columns"])
    down = -(-(v.get("TotalPixelMatrixRows") or v["Rows"]) // v["Rows"])
    planes = v.get("TotalPixelMatrixFocalPlanes") or 1
    step = first(v, "SharedFunctionalGroupsSequence", "PixelMeasuresSequence", "SpacingBetweenSlices") or 0.0
    offset = v.get("ConcatenationFrameOffsetNumber") or 0
    for i in which:
        tile, rest = (i + offset) % (across * down), (i + offset) // (across * down)
        path = rest // planes
        yield tile % across, tile // across, round(z0 + rest % planes * step * 1000, 3), str(ids[path]) if path < len(ids) else str(path)


def _pad(raw: bytes) -> bytes:
    return raw + b"\0" * (len(raw) % 2)


def _meta(values: dict, syntax: str) -> bytes:
    each = b"".join(struct.pack("<HH", 2, e) + b"UI" + struct.pack("<H", len(_pad(u.encode()))) + _pad(u.encode()) for e, u in ((2, values["SOPClassUID"]), (3, values["SOPInstanceUID"]), (0x10, syntax)))
    return struct.pack("<HH", 2, 0) + b"UL" + struct.pack("<HI", 4, len(each)) + each


def write_dataset(path: str, values: dict, syntax: str = EXPLICIT, undefined: bool = False) -> None:
    """A file without pixels. Only little endian is written."""
    if syntax not in (IMPLICIT, EXPLICIT):
        raise ValueError(f"can't write a dataset as {syntax}")
    with open(path, "wb") as f:
        f.write(b"\0" * 128 + b"DICM" + _meta(values, syntax) + E.dataset(values, syntax != IMPLICIT, undefined))


class FrameWriter:
    """A slide file whose frames are written one after the other; only their positions are kept.

    table, for encapsulated frames: basic, extended, tiff or empty. Its room is left in front and filled in
    the end; a basic one that overflows is left empty, and the frames are found by walking the items.
    """

    def __init__(self, path: str, values: dict, syntax: str = EXPLICIT, table: str = "basic", undefined: bool = False) -> None:
        self.values = {"SOPClassUID": SLIDE_CLASS, **values}
        self.native, self.table, self.n = syntax in (IMPLICIT, EXPLICIT), table, frame_count(self.values)
        self.at: list[int] = []
        self.sizes: list[int] = []
        self.f = open(path, "wb")  # noqa: SIM115
        self.f.write(b"\0" * 128 + b"DICM" + _meta(self.values, syntax) + E.dataset(self.values, syntax != IMPLICIT, undefined))
        if self.native:
            v = self.values
            self.size = v["Rows"] * v["Columns"] * v["SamplesPerPixel"] * (v["BitsAllocated"] // 8)
            total = self.size * self.n
            self.f.write(struct.pack("<HH", *PIXELS) + (b"OB\0\0" if syntax == EXPLICIT else b"") + struct.pack("<I", total + total % 2))
        else:
            if table == "extended":
                for k in ("ExtendedOffsetTable", "ExtendedOffsetTableLengths"):
                    self.f.write(E.encoded(k, [0] * self.n))
            self.room = self.f.tell()
            self.f.write(struct.pack("<HH", *PIXELS) + b"OB\0\0" + struct.pack("<I", UNDEFINED))
            self.f.write(struct.pack("<HHI", *ITEM, 4 * self.n if table == "basic" else 0) + b"\0" * (4 * self.n if table == "basic" else 0))
        self.start = self.f.tell()

    def add(self, data: bytes) -> None:
        if len(self.at) == self.n:
            raise FrameTableError(f"more than the {self.n} frames that the header says")
        if self.native and len(data) != self.size:
            raise FrameTableError(f"a frame of {len(data)} bytes, {self.size} expected")
        self.at.append(self.f.tell() - self.start)
        self.sizes.append(len(data) + len(data) % 2)
        self.f.write(data if self.native else struct.pack("<HHI", *ITEM, self.sizes[-1]) + _pad(data))

    def close(self) -> None:
        if len(self.at) != self.n:
            raise FrameTableError(f"{len(self.at)} frames, {self.n} in the header")
        f = self.f
        if self.native:
            f.write(b"\0" * (self.size * self.n % 2))
        else:
            f.write(struct.pack("<HHI", *SEQUENCE_END, 0))
            if self.table == "tiff":
                columns = [[self.start + a + 8 for a in self.at], self.sizes]
                where = [f.tell(), f.tell() + 4 * self.n]
                f.write(b"".join(struct.pack(f"<{self.n}I", *c) for c in columns))
                directory = f.tell()
                entries = [struct.pack("<HHII", tag, 4, self.n, c[0] if self.n == 1 else w) for tag, c, w in zip((TIFF_OFFSETS[0], TIFF_LENGTHS[0]), columns, where, strict=True)]
                f.write(struct.pack("<H", 2) + b"".join(entries) + struct.pack("<I", 0))
                f.seek(0)
                f.write(b"II*\0" + struct.pack("<I", directory))
            elif self.table == "basic" and self.n and self.at[-1] <= UNDEFINED:
                f.seek(self.start - 4 * self.n)
                f.write(struct.pack(f"<{self.n}I", *self.at))
            elif self.table == "extended":
                f.seek(self.room - len(E.encoded("ExtendedOffsetTable", [0] * self.n)) * 2)
                f.write(E.encoded("ExtendedOffsetTable", self.at) + E.encoded("ExtendedOffsetTableLengths", self.sizes))
        f.close()


def write_file(path: str, values: dict, data: list[bytes], syntax: str = EXPLICIT, table: str = "basic", undefined: bool = False) -> None:
    """A slide file of the given frames."""
    if table == "basic" and sum(len(d) + 9 for d in data) > UNDEFINED:
        table = "extended"
    writer = FrameWriter(path, {**values, "NumberOfFrames": values.get("NumberOfFrames", len(data))}, syntax, table, undefined)
    for d in data:
        writer.add(d)
    writer.close()


def write_manifest(path: str, files: list[tuple[str, str]]) -> None:
    """A DICOMDIR of (path from its folder, SOP class)."""
    records = [{"DirectoryRecordType": "IMAGE", "ReferencedFileID": p.split("/"), "ReferencedSOPClassUIDInFile": c} for p, c in files]
    write_dataset(path, {"SOPClassUID": "1.2.840.10008.1.3.10", "SOPInstanceUID": "1.2.3", "DirectoryRecordSequence": records})


def numbered(n: int) -> dict:
    """Elements for the nth file of a concatenation, from 1."""
    return {"InConcatenationNumber": n} if n < 1 << 16 else {"PartCreator": PART_CREATOR, "PartNumber": n}


def part_number(v: dict) -> int | None:
    n = v.get("InConcatenationNumber")
    return v.get("PartNumber") if n is None and v.get("PartCreator") == PART_CREATOR else n


def _list(v) -> list:
    return [] if v is None else v if isinstance(v, list) else [v]


def header_row(path: str, h: Header, table: str | None) -> tuple:
    v = h.values
    measures = first(v, "SharedFunctionalGroupsSequence", "PixelMeasuresSequence")
    spacing = [x if x and x > 0 else None for x in (_list(first(measures, "PixelSpacing") or v.get("PixelSpacing")) + [None, None])[1::-1]]
    per_frame = v.get("PerFrameFunctionalGroupsSequence") or []
    origin = "TotalPixelMatrixOriginSequence"
    ids = [str(p["OpticalPathIdentifier"]) for p in v.get("OpticalPathSequence") or [] if p.get("OpticalPathIdentifier") is not None]
    number = lambda x: None if x is None else float(x)
    kind = _list(v.get("ImageType"))
    return (
        path, v.get("SOPClassUID"), h.syntax, v.get("SOPInstanceUID"), v.get("StudyInstanceUID"), v.get("SeriesInstanceUID"), v.get("FrameOfReferenceUID"), v.get("ConcatenationUID"), v.get("SOPInstanceUIDOfConcatenationSource"), part_number(v), v.get("ConcatenationFrameOffsetNumber"),
        kind[2] if len(kind) > 2 else None, v.get("PhotometricInterpretation"), v.get("DimensionOrganizationType"), v.get("SamplesPerPixel"), v.get("BitsStored"), v.get("PixelRepresentation"), v.get("PlanarConfiguration"), v.get("Rows"), v.get("Columns"),
        v.get("TotalPixelMatrixRows"), v.get("TotalPixelMatrixColumns"), frame_count(v), v.get("TotalPixelMatrixFocalPlanes") or 1, v.get("NumberOfOpticalPaths") or max(len(ids), 1), ids,
        *map(number, spacing), number(first(measures, "SpacingBetweenSlices")), number(first(measures, "SliceThickness") or v.get("SliceThickness")), number(v.get("ImagedVolumeDepth")),
        *[number(first(v, origin, f"{a}OffsetInSlideCoordinateSystem")) for a in "XYZ"], number(first(v, "SharedFunctionalGroupsSequence", "PlanePositionSlideSequence", "ZOffsetInSlideCoordinateSystem")), [float(x) for x in _list(v.get("ImageOrientationSlide"))] or None,
        v.get("FocusMethod"), v.get("ExtendedDepthOfField"), v.get("NumberOfFocalPlanes"), number(v.get("DistanceBetweenFocalPlanes")), v.get("LossyImageCompression"), [f"{x:g}" for x in _list(v.get("LossyImageCompressionRatio"))], _list(v.get("LossyImageCompressionMethod")),
        bool(per_frame) and "PlanePositionSlideSequence" in per_frame[0], table, h.pixels_at,
    )


def _store(path: str):
    """(file system, path in it) of an address; None for the local disk."""
    if "://" not in path or path.startswith("file://"):
        return None, path.removeprefix("file://")
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def open_stream(path: str):
    """A seekable stream of a file on the local disk or on a store; only what is read is fetched."""
    store, inside = _store(path)
    return open(inside, "rb") if store is None else store.open_input_file(inside)


def _listed(path: str) -> list[tuple[str, int]]:
    """(path, size) of a folder's files (not those of its folders), a file, a pattern's matches, or what a manifest names."""
    store, inside = _store(path)
    if store is not None:
        from pyarrow import fs

        info = store.get_file_info(inside)
        found = store.get_file_info(fs.FileSelector(inside)) if info.type == fs.FileType.Directory else [info]
        scheme = path.split("://")[0]
        return sorted((f"{scheme}://{i.path}" if scheme in ("s3", "gs") else path.rstrip("/") + (f"/{i.base_name}" if i.path != inside else ""), i.size) for i in found if i.type == fs.FileType.File)
    if os.path.basename(inside) == "DICOMDIR":
        folder = os.path.dirname(inside)
        return [(p, os.path.getsize(p)) for n in manifest(inside) if os.path.isfile(p := os.path.join(folder, n))]
    names = [os.path.join(inside, n) for n in os.listdir(inside)] if os.path.isdir(inside) else glob.glob(inside)
    return sorted((p, os.path.getsize(p)) for p in names if os.path.isfile(p))


def manifest(path: str) -> list[str]:
    """Files of the slide class that a DICOMDIR names, as paths from its folder."""
    with open_stream(path) as f:
        records = read_header(f).values.get("DirectoryRecordSequence") or []
    return [os.path.join(*_list(r["ReferencedFileID"])) for r in records if r.get("ReferencedSOPClassUIDInFile") == SLIDE_CLASS and r.get("ReferencedFileID")]


class _Parts(InputPartition):
    """Files, or (path, a, b, n): the ranges a to b of n equal ones of a file's frames."""

    def __init__(self, files: list[tuple[str, int, int, int]]) -> None:
        super().__init__(files)
        self.files = files


def dealt(n: int, least: int) -> list[range]:
    """Numbers up to n in equal runs, `least` of them or one for each."""
    k = min(n, max(least, _LEAST_PARTS))
    return [range(n * i // k, n * (i + 1) // k) for i in range(k)]


def partitions(listed: list[tuple[str, int]], ranges: Callable[[int], int]) -> list[InputPartition]:
    """Files, of (path, size), and ranges of them dealt to partitions. ranges: how many a file of a size has."""
    parts = [(p, i, n) for p, size in listed for n in [ranges(size)] for i in range(n)]
    out = []
    for run in dealt(len(parts), max(-(-len(listed) // _MOST_FILES), sum(-(-size // _SPLIT) for _, size in listed if size >= _SPLIT))):
        files: list[tuple[str, int, int, int]] = []
        for p, i, n in (parts[k] for k in run):
            if files and files[-1][0] == p:
                files[-1] = (p, files[-1][1], i + 1, n)
            else:
                files.append((p, i, i + 1, n))
        out.append(_Parts(files))
    return out


def whole_files(path: str) -> list[InputPartition]:
    return partitions(_listed(path), lambda size: 1)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options
        self.classes = [c.strip() for c in options.get("classes", SLIDE_CLASS).split(",")]

    def ranges(self, size: int) -> int:
        return 1

    def partitions(self) -> list[InputPartition]:
        return partitions(_listed(self.options["path"]), self.ranges)

    def needed(self, which: Callable[[int], range]) -> Callable[[int], range]:
        """Frames whose own items of the header are read, of those of a partition."""
        raise NotImplementedError

    def rows(self, path: str, f, header: Header, which: Callable[[int], range]) -> Iterator[tuple]:
        raise NotImplementedError

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path, a, b, n in partition.files:
            which = lambda frames, a=a, b=b, n=n: range(frames * a // n, frames * b // n)
            with open_stream(path) as f:
                try:
                    header = read_header(f, self.needed(which))
                except (NotASlide, E.Truncated, struct.error, UnicodeDecodeError):
                    continue
                if header.values.get("SOPClassUID") in self.classes:
                    yield from self.rows(path, f, header, which)


class _HeaderReader(_Reader):
    def needed(self, which: Callable[[int], range]) -> Callable[[int], range]:
        return lambda frames: range(0)

    def rows(self, path: str, f, header: Header, which: Callable[[int], range]) -> Iterator[tuple]:
        table = None
        if header.pixels_at >= 0:
            table = "native"
            if header.pixels_length == UNDEFINED:
                f.seek(header.pixels_at)
                item = E.head(f, True)
                tiff = header.preamble[:2] == b"II"
                table = "extended" if header.values.get("ExtendedOffsetTable") else "basic" if item and item[2] else "tiff" if tiff else "items"
        yield header_row(path, header, table)


class _FrameReader(_Reader):
    def ranges(self, size: int) -> int:
        return max(1, -(-size // int(self.options.get("splitbytes", _SPLIT))))

    def needed(self, which: Callable[[int], range]) -> Callable[[int], range]:
        return which

    def rows(self, path: str, f, header: Header, which: Callable[[int], range]) -> Iterator[tuple]:
        v = header.values
        name, begin = v.get("ConcatenationUID") or v.get("SOPInstanceUID"), v.get("ConcatenationFrameOffsetNumber") or 0
        try:
            _, found = frame_index(f, header)
        except NotASlide:
            return
        wanted = self.options.get("data", "true").lower() != "false"
        for i, (x, y, z, optical) in zip(which(len(found)), places(header, which(len(found))), strict=True):
            at, length = found[i]
            if wanted:
                f.seek(at)
            yield path, name, begin + i, x, y, z, optical, at, length, f.read(length) if wanted else None


class DicomHeaders(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dicomslides"

    def schema(self) -> str:
        return HEADER

    def reader(self, schema: StructType) -> DataSourceReader:
        return _HeaderReader(dict(self.options))


class DicomFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dicomframes"

    def schema(self) -> str:
        return FRAME

    def reader(self, schema: StructType) -> DataSourceReader:
        return _FrameReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes spark.read.format("dicomslides") and ("dicomframes") known."""
    spark.dataSource.register(DicomHeaders)
    spark.dataSource.register(DicomFrames)
