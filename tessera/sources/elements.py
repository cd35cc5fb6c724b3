"""Data elements of the DICOM format: parsing to nested dictionaries by keyword, and writing from them.

A dataset is a dictionary from keyword to value; a sequence is a list of datasets, a multiple value a
list. Explicit and implicit value representation, little endian; sequences and items with and without a
length. What the dictionary below doesn't name is skipped when reading and can't be written.
"""

from __future__ import annotations

import struct

import numpy as np

# Fixed values of the standard: elements by keyword, with tag and value representation.
ELEMENTS = {
    "FileSetID": (0x0004, 0x1130, "CS"), "DirectoryRecordSequence": (0x0004, 0x1220, "SQ"), "DirectoryRecordType": (0x0004, 0x1430, "CS"), "ReferencedFileID": (0x0004, 0x1500, "CS"), "ReferencedSOPClassUIDInFile": (0x0004, 0x1510, "UI"),
    "ImageType": (0x0008, 0x0008, "CS"), "SOPClassUID": (0x0008, 0x0016, "UI"), "SOPInstanceUID": (0x0008, 0x0018, "UI"), "StudyDate": (0x0008, 0x0020, "DA"), "StudyTime": (0x0008, 0x0030, "TM"), "AcquisitionDateTime": (0x0008, 0x002A, "DT"),
    "AccessionNumber": (0x0008, 0x0050, "SH"), "Modality": (0x0008, 0x0060, "CS"), "Manufacturer": (0x0008, 0x0070, "LO"), "ReferringPhysicianName": (0x0008, 0x0090, "PN"), "CodeValue": (0x0008, 0x0100, "SH"), "CodingSchemeDesignator": (0x0008, 0x0102, "SH"),
    "CodeMeaning": (0x0008, 0x0104, "LO"), "StudyDescription": (0x0008, 0x1030, "LO"), "ManufacturerModelName": (0x0008, 0x1090, "LO"), "ReferencedSOPClassUID": (0x0008, 0x1150, "UI"), "ReferencedSOPInstanceUID": (0x0008, 0x1155, "UI"), "ReferencedImageSequence": (0x0008, 0x1140, "SQ"),
    "PatientName": (0x0010, 0x0010, "PN"), "PatientID": (0x0010, 0x0020, "LO"), "PatientBirthDate": (0x0010, 0x0030, "DA"), "PatientSex": (0x0010, 0x0040, "CS"), "PatientIdentityRemoved": (0x0012, 0x0062, "CS"), "DeidentificationMethod": (0x0012, 0x0063, "LO"),
    "SliceThickness": (0x0018, 0x0050, "DS"), "SpacingBetweenSlices": (0x0018, 0x0088, "DS"), "DeviceSerialNumber": (0x0018, 0x1000, "LO"), "SoftwareVersions": (0x0018, 0x1020, "LO"),
    "StudyInstanceUID": (0x0020, 0x000D, "UI"), "SeriesInstanceUID": (0x0020, 0x000E, "UI"), "StudyID": (0x0020, 0x0010, "SH"), "SeriesNumber": (0x0020, 0x0011, "IS"), "InstanceNumber": (0x0020, 0x0013, "IS"), "FrameOfReferenceUID": (0x0020, 0x0052, "UI"),
    "SOPInstanceUIDOfConcatenationSource": (0x0020, 0x0242, "UI"), "ConcatenationUID": (0x0020, 0x9161, "UI"), "InConcatenationNumber": (0x0020, 0x9162, "US"), "InConcatenationTotalNumber": (0x0020, 0x9163, "US"), "ConcatenationFrameOffsetNumber": (0x0020, 0x9228, "UL"), "DimensionOrganizationType": (0x0020, 0x9311, "CS"),
    "SamplesPerPixel": (0x0028, 0x0002, "US"), "PhotometricInterpretation": (0x0028, 0x0004, "CS"), "PlanarConfiguration": (0x0028, 0x0006, "US"), "NumberOfFrames": (0x0028, 0x0008, "IS"), "Rows": (0x0028, 0x0010, "US"), "Columns": (0x0028, 0x0011, "US"), "PixelSpacing": (0x0028, 0x0030, "DS"),
    "BitsAllocated": (0x0028, 0x0100, "US"), "BitsStored": (0x0028, 0x0101, "US"), "HighBit": (0x0028, 0x0102, "US"), "PixelRepresentation": (0x0028, 0x0103, "US"), "BurnedInAnnotation": (0x0028, 0x0301, "CS"), "PixelMeasuresSequence": (0x0028, 0x9110, "SQ"), "ICCProfile": (0x0028, 0x2000, "OB"),
    "LossyImageCompression": (0x0028, 0x2110, "CS"), "LossyImageCompressionRatio": (0x0028, 0x2112, "DS"), "LossyImageCompressionMethod": (0x0028, 0x2114, "CS"), "ContainerIdentifier": (0x0040, 0x0512, "LO"), "SpecimenIdentifier": (0x0040, 0x0551, "LO"), "SpecimenUID": (0x0040, 0x0554, "UI"),
    "SpecimenDescriptionSequence": (0x0040, 0x0560, "SQ"), "XOffsetInSlideCoordinateSystem": (0x0040, 0x072A, "DS"), "YOffsetInSlideCoordinateSystem": (0x0040, 0x073A, "DS"), "ZOffsetInSlideCoordinateSystem": (0x0040, 0x074A, "DS"), "ConceptNameCodeSequence": (0x0040, 0xA043, "SQ"),
    "MeasurementUnitsCodeSequence": (0x0040, 0x08EA, "SQ"), "AnnotationGroupNumber": (0x0040, 0xA180, "US"), "ImagedVolumeWidth": (0x0048, 0x0001, "FL"), "ImagedVolumeHeight": (0x0048, 0x0002, "FL"), "ImagedVolumeDepth": (0x0048, 0x0003, "FL"),
    "TotalPixelMatrixColumns": (0x0048, 0x0006, "UL"), "TotalPixelMatrixRows": (0x0048, 0x0007, "UL"), "TotalPixelMatrixOriginSequence": (0x0048, 0x0008, "SQ"), "SpecimenLabelInImage": (0x0048, 0x0010, "CS"), "FocusMethod": (0x0048, 0x0011, "CS"), "ExtendedDepthOfField": (0x0048, 0x0012, "CS"),
    "NumberOfFocalPlanes": (0x0048, 0x0013, "US"), "DistanceBetweenFocalPlanes": (0x0048, 0x0014, "FL"), "ImageOrientationSlide": (0x0048, 0x0102, "DS"), "OpticalPathSequence": (0x0048, 0x0105, "SQ"), "OpticalPathIdentifier": (0x0048, 0x0106, "SH"), "OpticalPathDescription": (0x0048, 0x0107, "ST"),
    "OpticalPathIdentificationSequence": (0x0048, 0x0207, "SQ"), "PlanePositionSlideSequence": (0x0048, 0x021A, "SQ"), "ColumnPositionInTotalImagePixelMatrix": (0x0048, 0x021E, "SL"), "RowPositionInTotalImagePixelMatrix": (0x0048, 0x021F, "SL"), "NumberOfOpticalPaths": (0x0048, 0x0302, "UL"), "TotalPixelMatrixFocalPlanes": (0x0048, 0x0303, "UL"),
    "SharedFunctionalGroupsSequence": (0x5200, 0x9229, "SQ"), "PerFrameFunctionalGroupsSequence": (0x5200, 0x9230, "SQ"), "PointCoordinatesData": (0x0066, 0x0016, "OF"), "DoublePointCoordinatesData": (0x0066, 0x0022, "OD"), "LongPrimitivePointIndexList": (0x0066, 0x0040, "OL"), "MeasurementsSequence": (0x0066, 0x0121, "SQ"),
    "FloatingPointValues": (0x0066, 0x0125, "OF"), "MeasurementValuesSequence": (0x0066, 0x0132, "SQ"), "AnnotationCoordinateType": (0x006A, 0x0001, "CS"), "AnnotationGroupSequence": (0x006A, 0x0002, "SQ"), "AnnotationGroupUID": (0x006A, 0x0003, "UI"), "AnnotationGroupLabel": (0x006A, 0x0005, "LO"),
    "AnnotationGroupDescription": (0x006A, 0x0006, "UT"), "AnnotationGroupGenerationType": (0x006A, 0x0007, "CS"), "AnnotationPropertyCategoryCodeSequence": (0x006A, 0x0009, "SQ"), "AnnotationPropertyTypeCodeSequence": (0x006A, 0x000A, "SQ"), "NumberOfAnnotations": (0x006A, 0x000C, "UL"), "AnnotationIndexList": (0x006A, 0x000D, "OL"),
    "PartCreator": (0x0009, 0x0010, "LO"), "PartNumber": (0x0009, 0x1001, "UL"),
    "GraphicType": (0x0070, 0x0023, "CS"), "ExtendedOffsetTable": (0x7FE0, 0x0001, "OV"), "ExtendedOffsetTableLengths": (0x7FE0, 0x0002, "OV"),
}
LONG = {"OB", "OD", "OF", "OL", "OV", "OW", "SQ", "SV", "UC", "UN", "UR", "UT", "UV"}
NUMBERS = {"US": "H", "SS": "h", "UL": "I", "SL": "i", "FL": "f", "FD": "d", "OF": "f", "OD": "d", "OL": "I", "OV": "Q"}
ARRAYS = {"OF": "<f4", "OD": "<f8", "OL": "<u4", "OV": "<u8"}
PIXELS, ITEM, ITEM_END, SEQUENCE_END = (0x7FE0, 0x0010), (0xFFFE, 0xE000), (0xFFFE, 0xE00D), (0xFFFE, 0xE0DD)
UNDEFINED = 0xFFFFFFFF
_BY_TAG = {(g, e): (k, vr) for k, (g, e, vr) in ELEMENTS.items()}


class Truncated(ValueError):
    """The stream ends inside an element."""


def _read(f, n: int) -> bytes:
    raw = f.read(n)
    if len(raw) < n:
        raise Truncated(f"{n} bytes wanted, {len(raw)} left")
    return raw


def head(f, explicit: bool) -> tuple[tuple[int, int], str, int] | None:
    """Tag, value representation and length of the next element; None at the end."""
    raw = f.read(8)
    if len(raw) < 8:
        return None
    tag = struct.unpack("<HH", raw[:4])
    if tag[0] == 0xFFFE or not explicit:
        return tag, "", struct.unpack("<I", raw[4:])[0]
    vr = raw[4:6].decode("latin-1")
    return tag, vr, struct.unpack("<I", _read(f, 4))[0] if vr in LONG else struct.unpack("<H", raw[6:])[0]


def value(vr: str, raw: bytes, arrays: bool = False):
    """One value, or a list of several; None if there is none. arrays: long lists of numbers as arrays over the bytes."""
    if vr in ("OB", "OW", "UN"):
        return raw
    if vr in NUMBERS:
        kind = NUMBERS[vr]
        if arrays and vr[0] == "O":
            return np.frombuffer(raw, ARRAYS[vr])
        out: list = list(struct.unpack(f"<{len(raw) // struct.calcsize(kind)}{kind}", raw))
        if vr[0] == "O":
            return out
    elif vr in ("UT", "ST", "LT"):
        return raw.rstrip(b" \0").decode("utf-8", "replace")
    else:
        out = [x.strip(" ") for x in raw.rstrip(b" \0").decode("utf-8", "replace").split("\\")]
        if vr in ("IS", "DS"):
            out = [(int if vr == "IS" else float)(x) for x in out if x]
        elif out == [""]:
            return None
    return None if not out else out[0] if len(out) == 1 else out


def _skip(f, explicit: bool) -> None:
    """Over an element of undefined length that nobody asks for."""
    while (e := head(f, explicit)) is not None and e[0] not in (SEQUENCE_END, ITEM_END):
        if e[2] == UNDEFINED:
            _skip(f, explicit)
        else:
            f.seek(e[2], 1)


def _sequence(f, explicit: bool, length: int, wanted: range | None = None, arrays: bool = False) -> list[dict]:
    """Items; of those that aren't wanted, but for the first, only that they are there."""
    out: list[dict] = []
    end = None if length == UNDEFINED else f.tell() + length
    left_out: dict = {}
    while (end is None or f.tell() < end) and (e := head(f, explicit)) is not None and e[0] == ITEM:
        if wanted is None or not out or len(out) in wanted:
            out.append(parse(f, explicit, None if e[2] == UNDEFINED else f.tell() + e[2], arrays=arrays))
            continue
        if e[2] == UNDEFINED:
            _skip(f, explicit)
        else:
            f.seek(e[2], 1)
        out.append(left_out)
    if out and out[-1] is left_out:  # the bytes that were passed over must be there
        f.seek(-1, 1)
        _read(f, 1)
    return out


def parse(f, explicit: bool = True, end: int | None = None, wanted: dict | None = None, arrays: bool = False) -> dict:
    """The dataset from here to `end`, to the end of its item, or to the pixels, before whose value the stream is left.

    Pixels are told by the keys "" : (position of the value, length). wanted: for sequences of this dataset, by keyword, what
    tells from the dataset so far which items are read.
    """
    out: dict = {}
    while (end is None or f.tell() < end) and (e := head(f, explicit)) is not None:
        tag, vr, length = e
        if tag in (ITEM_END, SEQUENCE_END):
            break
        if tag == PIXELS:
            out[""] = (f.tell(), length)
            break
        keyword, known = _BY_TAG.get(tag, (None, vr))
        if known == "SQ" and keyword:
            out[keyword] = _sequence(f, explicit, length, wanted[keyword](out) if wanted and keyword in wanted else None, arrays)
        elif length == UNDEFINED:
            _skip(f, explicit)
        elif keyword == "PartNumber" and (length != 4 or "PartCreator" not in out):
            f.seek(length, 1)  # another creator's
        elif keyword:
            out[keyword] = value(known, _read(f, length), arrays)
        else:
            f.seek(length, 1)
    return out


def _padded(raw: bytes, by: bytes) -> bytes:
    return raw + by * (len(raw) % 2)


def encoded(keyword: str, v, explicit: bool = True, undefined: bool = False) -> bytes:
    """One element; undefined: sequences and items without a length."""
    group, element, vr = ELEMENTS[keyword]
    if vr == "SQ":
        items = []
        for d in v or ():
            body = dataset(d, explicit, undefined)
            items.append(struct.pack("<HHI", *ITEM, UNDEFINED if undefined else len(body)) + body + (struct.pack("<HHI", *ITEM_END, 0) if undefined else b""))
        raw = b"".join(items) + (struct.pack("<HHI", *SEQUENCE_END, 0) if undefined else b"")
    elif vr in ("OB", "OW", "UN"):
        raw = _padded(bytes(v), b"\0")
    elif isinstance(v, np.ndarray):
        raw = np.ascontiguousarray(v, ARRAYS[vr]).tobytes()
    else:
        values = [] if v is None else list(v) if isinstance(v, (list, tuple)) else [v]
        if vr in NUMBERS:
            raw = struct.pack(f"<{len(values)}{NUMBERS[vr]}", *values)
        else:
            raw = _padded("\\".join(f"{x:.10g}" if vr == "DS" and isinstance(x, float) else str(x) for x in values).encode(), b"\0" if vr == "UI" else b" ")
    length = UNDEFINED if vr == "SQ" and undefined else len(raw)
    tag = struct.pack("<HH", group, element)
    if not explicit:
        return tag + struct.pack("<I", length) + raw
    return tag + vr.encode() + (b"\0\0" + struct.pack("<I", length) if vr in LONG else struct.pack("<H", length)) + raw


def dataset(d: dict, explicit: bool = True, undefined: bool = False) -> bytes:
    """All elements in order of their tags."""
    return b"".join(encoded(k, d[k], explicit, undefined) for k in sorted((k for k in d if k), key=lambda k: ELEMENTS[k][:2]))


def first(d: dict | None, *path: str):
    """The value at the end of the path of keywords, the first item of each sequence on the way; None if there is none."""
    for k in path:
        if isinstance(d, list):
            d = d[0] if d else None
        d = d.get(k) if isinstance(d, dict) else None
    return d
