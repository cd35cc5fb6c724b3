"""Frames to pixels and back by transfer syntax, and what the syntaxes can hold.

Decoding is one Arrow step: the first decoder that supports a syntax and a kind of pixels is taken.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import Unsupported
from tessera.operators import jpeg, jpegls
from tessera.operators import pixels as P

# Fixed values of the standard: transfer syntaxes.
IMPLICIT, EXPLICIT, BIG_ENDIAN = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.2"
RLE = "1.2.840.10008.1.2.5"
JPEG_BASELINE, JPEG_EXTENDED, JPEG_LOSSLESS, JPEG_LOSSLESS_FIRST = (f"1.2.840.10008.1.2.4.{n}" for n in (50, 51, 57, 70))
JPEG_LS, JPEG_LS_NEAR = (f"1.2.840.10008.1.2.4.{n}" for n in (80, 81))
JPEG_2000_LOSSLESS, JPEG_2000 = (f"1.2.840.10008.1.2.4.{n}" for n in (90, 91))
HT_LOSSLESS, HT_LOSSLESS_RPCL, HT = (f"1.2.840.10008.1.2.4.{n}" for n in (201, 202, 203))
JPEG_XL_LOSSLESS, JPEG_XL = (f"1.2.840.10008.1.2.4.{n}" for n in (110, 112))
NATIVE = (IMPLICIT, EXPLICIT, BIG_ENDIAN)


def _native(data: bytes, syntax: str, rows: int, columns: int, samples: int, bits: int, rgb: bool) -> np.ndarray:
    kind = np.uint8 if bits <= 8 else ">u2" if syntax == BIG_ENDIAN else "<u2"
    a = np.frombuffer(data, kind, rows * columns * samples).astype(np.uint8 if bits <= 8 else np.uint16)
    return a.reshape(rows, columns, samples) if samples > 1 else a.reshape(rows, columns)


#: By syntax: a function of (data, syntax, rows, columns, samples, bits, whether RGB is wanted), the largest bits, and the bits that colour may have.
DECODERS: list[tuple[tuple[str, ...], Callable, int, int]] = [
    (NATIVE, _native, 16, 16),
    ((RLE,), lambda d, _, r, c, s, b, rgb: P.rle_decode(d, r, c, s, "uint8" if b <= 8 else "uint16"), 16, 16),
    ((JPEG_BASELINE,), lambda d, _, r, c, s, b, rgb: jpeg.decode(d, rgb), 8, 8),
    ((JPEG_EXTENDED,), lambda d, _, r, c, s, b, rgb: jpeg.decode(d, rgb), 12, 8),
    ((JPEG_LOSSLESS, JPEG_LOSSLESS_FIRST), lambda d, _, r, c, s, b, rgb: jpeg.decode(d, False), 16, 16),
    ((JPEG_LS, JPEG_LS_NEAR), lambda d, _, r, c, s, b, rgb: jpegls.decode(d), 16, 16),
]


def decoder(syntax: str, samples: int, bits: int) -> Callable | None:
    """The first decoder of a syntax for pixels of one or three samples and 8 to 16 bits."""
    for syntaxes, function, most, colour in DECODERS:
        if syntax in syntaxes and samples in (1, 3) and bits <= (most if samples == 1 else colour):
            return function
    return None


def decode_frame(data: bytes, syntax: str, rows: int, columns: int, samples: int = 1, bits: int = 8, photometric: str = "MONOCHROME2") -> np.ndarray:
    """(rows, columns) or (rows, columns, 3). Luminance and chroma become RGB, but for those of native and run-length frames."""
    function = decoder(syntax, samples, bits)
    if function is None:
        raise Unsupported(f"no decoder for {syntax} with {samples} samples of {bits} bits")
    out = function(data, syntax, rows, columns, samples, bits, photometric != "RGB")
    if out.shape[:2] != (rows, columns):
        raise Unsupported(f"a frame of {out.shape[:2]}, {rows} x {columns} expected")
    return out


def encode_frame(a: np.ndarray, syntax: str, quality: int = 90, halved: tuple[int, int] = (2, 1), near: int = 1, photometric: str = "YBR_FULL_422") -> bytes:
    """A frame in a syntax that this package writes. quality, halved: of lossy JPEG frames; near: how far pixels of near-lossless ones may be off."""
    if syntax in (IMPLICIT, EXPLICIT):
        return a.astype(a.dtype.newbyteorder("<")).tobytes()
    if syntax == BIG_ENDIAN:
        return a.astype(a.dtype.newbyteorder(">")).tobytes()
    if syntax == RLE:
        return P.rle_encode(a)
    if syntax in (JPEG_BASELINE, JPEG_EXTENDED):
        if syntax == JPEG_BASELINE and a.dtype != np.uint8:
            raise Unsupported("baseline frames have 8 bits")
        return jpeg.encode(a, quality, halved if photometric == "YBR_FULL_422" else (1, 1), photometric != "RGB")
    if syntax in (JPEG_LOSSLESS, JPEG_LOSSLESS_FIRST):
        return jpeg.encode_lossless(a)
    if syntax in (JPEG_LS, JPEG_LS_NEAR):
        return jpegls.encode(a, near=near if syntax == JPEG_LS_NEAR else 0)
    raise Unsupported(f"no encoder for {syntax}")


def transcoder(syntax: str, rows: int, columns: int, samples: int = 1, bits: int = 8, source: str = EXPLICIT, **options) -> Callable[[bytes], bytes]:
    """What encodes one frame's data anew, for steps that do so beside other things; data that has the syntax stays as it is."""
    if source == syntax:
        return lambda d: d
    return lambda d: encode_frame(decode_frame(d, source, rows, columns, samples, bits), syntax, **options)


def transcoded(frames: DataFrame, syntax: str, rows: int, columns: int, samples: int = 1, bits: int = 8, source: str = EXPLICIT, **options) -> DataFrame:
    """frames with their data encoded anew; those that have the syntax already stay as they are."""
    if source == syntax:
        return frames
    anew = transcoder(syntax, rows, columns, samples, bits, source, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in P.cut(batches, rows * columns * samples):
            at = batch.schema.get_field_index("data")
            yield batch.set_column(at, "data", pa.array([anew(d) for d in batch.column(at).to_pylist()], pa.binary()))

    return frames.mapInArrow(run, frames.schema)


def coding(kind: Column, bits: Column, channels: Column, lossless: Column, predictor: Column) -> Column:
    """(syntax, photometric) of encoder settings; null where they can't be had.

    kind: jpeg, jpeg_lossless, jpeg_ls, jpeg_2000, ht_jpeg_2000, jpeg_xl, rle, native or implicit; channels:
    grayscale, ybr or rgb; predictor: null for the first.
    """
    either = lambda name, yes, no: F.when(kind == name, F.when(lossless, yes).otherwise(no))
    syntax = F.coalesce(
        F.when((kind == "jpeg") & (bits == 8), JPEG_BASELINE).when((kind == "jpeg") & (bits == 12), JPEG_EXTENDED), F.when(kind == "jpeg_lossless", F.when(predictor.isNull(), JPEG_LOSSLESS_FIRST).otherwise(JPEG_LOSSLESS)),
        either("jpeg_ls", JPEG_LS, JPEG_LS_NEAR), either("jpeg_2000", JPEG_2000_LOSSLESS, JPEG_2000), either("ht_jpeg_2000", HT_LOSSLESS, HT), either("jpeg_xl", JPEG_XL_LOSSLESS, JPEG_XL),
        F.when(kind == "rle", RLE), F.when(kind == "native", EXPLICIT).when(kind == "implicit", IMPLICIT),
    )
    ybr = F.when(kind == "jpeg", "YBR_FULL_422").when(kind.isin("jpeg_2000", "ht_jpeg_2000"), F.when(lossless, "YBR_RCT").otherwise("YBR_ICT")).when(kind.isin("jpeg_lossless", "jpeg_xl", "rle"), "YBR_FULL")
    photometric = F.when(channels == "grayscale", "MONOCHROME2").when(channels == "rgb", "RGB").when(channels == "ybr", ybr)
    return F.when(syntax.isNotNull() & photometric.isNotNull(), F.struct(syntax.alias("syntax"), photometric.alias("photometric")))


def support_matrix(spark) -> DataFrame:
    """(syntax, samples, bits, decodes, encodes) of what this package reads and writes."""
    written = {IMPLICIT, EXPLICIT, BIG_ENDIAN, RLE, JPEG_BASELINE, JPEG_EXTENDED, JPEG_LOSSLESS, JPEG_LOSSLESS_FIRST, JPEG_LS, JPEG_LS_NEAR}
    every = [*NATIVE, RLE, JPEG_BASELINE, JPEG_EXTENDED, JPEG_LOSSLESS, JPEG_LOSSLESS_FIRST, JPEG_LS, JPEG_LS_NEAR, JPEG_2000_LOSSLESS, JPEG_2000, HT_LOSSLESS, HT_LOSSLESS_RPCL, HT, JPEG_XL_LOSSLESS, JPEG_XL]
    rows = [(s, n, b, decoder(s, n, b) is not None, s in written and decoder(s, n, b) is not None) for s in every for n in (1, 3) for b in (8, 12, 16)]
    return spark.createDataFrame(rows, "syntax string, samples int, bits int, decodes boolean, encodes boolean")
