"""Numbers, look-up tables and profile descriptions in binary elements."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf

# Little-endian kinds of numbers, and the operations of segmented look-up tables.
KINDS = {"double": "<f8", "float": "<f4", "long": "<i4"}
DISCRETE, LINEAR, INDIRECT = 0, 1, 2


def _lists(sizes: np.ndarray, there: pa.Array, values: np.ndarray) -> pa.Array:
    """Lists of so many of the values each, null where they aren't there."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.float64()), mask=pc.invert(there))


def numbers(column: Column, kind: str) -> Column:
    """The numbers of a binary column as doubles; null where bytes are left over."""
    dtype = np.dtype(KINDS[kind])

    @arrow_udf("array<double>")
    def read(raw: pa.Array) -> pa.Array:
        sizes = pc.binary_length(raw)
        whole = pc.fill_null(pc.equal(pc.multiply(pc.divide(sizes, dtype.itemsize), dtype.itemsize), sizes), False)
        kept = raw.filter(whole)
        values = np.frombuffer(b"".join(kept.to_pylist()), dtype).astype(float)
        return _lists(np.where(whole.to_numpy(zero_copy_only=False), sizes.fill_null(0).to_numpy(zero_copy_only=False) // dtype.itemsize, 0), whole, values)

    return read(column)


def number_bytes(column: Column, kind: str) -> Column:
    """The bytes of an array of doubles as numbers of a kind."""
    dtype = np.dtype(KINDS[kind])

    @arrow_udf("binary")
    def write(lists: pa.Array) -> pa.Array:
        raw = lists.flatten().to_numpy(zero_copy_only=False).astype(float).astype(dtype).tobytes()
        at = [0, *np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False) * dtype.itemsize).tolist()]
        return pa.array([raw[a:b] if there else None for a, b, there in zip(at[:-1], at[1:], lists.is_valid().to_pylist(), strict=True)], pa.binary())

    return write(column)


def expanded(words: list[int]) -> list[int] | None:
    """Values of a segmented table of 16-bit words: runs of values, or steps to a value; None for an operation that isn't supported or a table that ends early."""
    out: list[int] = []
    at = 0
    while at < len(words):
        if at + 2 > len(words):
            return None
        kind, n = words[at : at + 2]
        if kind == DISCRETE and at + 2 + n <= len(words):
            out += words[at + 2 : at + 2 + n]
            at += 2 + n
        elif kind == LINEAR and out and at + 3 <= len(words):
            start, end = out[-1], words[at + 2]
            out += [start + (end - start) * i // n for i in range(1, n + 1)]
            at += 3
        else:
            return None
    return out


def segmented(values: list[int]) -> list[int]:
    """A segmented table of the values: steps where three or more lie on a line that `expanded` gives back, runs elsewhere."""
    out: list[int] = []
    run: list[int] = []
    i = 0
    while i < len(values):
        best = 0
        if i and (run or out):
            for n in range(3, len(values) - i + 1):
                end = values[i + n - 1]
                if [values[i - 1] + (end - values[i - 1]) * k // n for k in range(1, n + 1)] == values[i : i + n]:
                    best = n
                else:
                    break
        if best:
            if run:
                out += [DISCRETE, len(run), *run]
                run = []
            out += [LINEAR, best, values[i + best - 1]]
            i += best
        else:
            run.append(values[i])
            i += 1
    return out + ([DISCRETE, len(run), *run] if run else [])


def lut(column: Column) -> Column:
    """Expanded values of an array<int> of a segmented table, null where it can't be had."""

    @pandas_udf("array<int>")
    def expand(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda w: None if w is None else expanded([int(x) for x in w]))

    return expand(column)


def scaled(values: Column, bits: int, to: int) -> Column:
    """Table values of some bits as numbers of others."""
    return F.transform(values, lambda v: v / 2.0 ** (bits - to))


def same_length(*tables: Column, strict: bool = False) -> Column:
    """Length of the tables of the channels, which must have one; else null, or an error if strict."""
    equal = F.lit(True)
    for t in tables[1:]:
        equal = equal & (F.size(t) == F.size(tables[0]))
    error = F.raise_error(F.lit("channels of a look-up table differ in length")).cast("int") if strict else F.lit(None).cast("int")
    return F.when(equal, F.size(tables[0])).otherwise(error)


def description(profile: bytes | None) -> str | None:
    """Name of a colour space, from the description tag of its profile (text or multi-language text)."""
    if profile is None or len(profile) < 132:
        return None
    (n,) = struct.unpack(">I", profile[128:132])
    for k in range(min(n, 100)):
        entry = profile[132 + 12 * k : 144 + 12 * k]
        if len(entry) < 12 or entry[:4] != b"desc":
            continue
        at, size = struct.unpack(">II", entry[4:])
        raw = profile[at : at + size]
        if raw[:4] == b"desc" and len(raw) >= 12:
            (length,) = struct.unpack(">I", raw[8:12])
            return raw[12 : 12 + length].split(b"\0")[0].decode("ascii", "replace").strip() or None
        if raw[:4] == b"mluc" and len(raw) >= 28:
            length, start = struct.unpack(">II", raw[20:28])
            return raw[start : start + length].decode("utf-16-be", "replace").strip("\0 ") or None
    return None


def with_description(name: str, multi: bool = False, space: bytes = b"RGB ") -> bytes:
    """The smallest profile that has a description."""
    if multi:
        text = name.encode("utf-16-be")
        tag = b"mluc" + struct.pack(">IIIHHII", 0, 1, 12, 0x656E, 0x5553, len(text), 28) + text
    else:
        text = name.encode("ascii", "replace") + b"\0"
        tag = b"desc" + struct.pack(">II", 0, len(text)) + text
    head = struct.pack(">I", 144 + len(tag)) + b"\0" * 8 + b"scnr" + space + b"Lab " + b"\0" * 104
    return head + struct.pack(">I", 1) + b"desc" + struct.pack(">II", 144, len(tag)) + tag


def profile_name(column: Column) -> Column:
    """Name of the colour space of a binary profile."""

    @pandas_udf("string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(description)

    return read(column)
