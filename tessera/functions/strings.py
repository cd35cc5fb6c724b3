"""Text, date, code and binary helpers of slide metadata, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def code_string(text: Column, most: int | None = None) -> Column:
    """Upper case, other characters than A-Z, 0-9, space and underscore become underscores, trimmed."""
    out = F.trim(F.regexp_replace(F.upper(text), "[^A-Z0-9 _]", "_"))
    return F.left(out, F.lit(most)) if most else out


def issuer(text: Column) -> Column:
    """Parts of local^universal^type; empty parts are null, and an issuer without any is null."""
    part = lambda i: F.nullif(F.get(F.split(text, r"\^"), i), F.lit(""))
    out = F.struct(part(0).alias("local"), part(1).alias("universal"), part(2).alias("kind"))
    return F.when(part(0).isNotNull() | part(1).isNotNull(), out)


def issuer_text(parts: Column) -> Column:
    """The text of an issuer: the local part alone, or all three."""
    return F.when(parts["universal"].isNull(), parts["local"]).otherwise(F.concat_ws("^", F.coalesce(parts["local"], F.lit("")), parts["universal"], F.coalesce(parts["kind"], F.lit(""))))


def unit_name(code: Column) -> Column:
    return F.when(code == "1", "unary").when(code == "{ratio}", "ratio").otherwise(code)


def yes_no(flag: Column) -> Column:
    """YES or NO; null is NO."""
    return F.when(F.coalesce(flag, F.lit(False)), "YES").otherwise("NO")


def from_yes_no(text: Column) -> Column:
    return F.when(text == "YES", True).when(text == "NO", False)


def enum(text: Column, *allowed: str) -> Column:
    """The value if it is allowed, else null."""
    return F.when(text.isin(*allowed), text)


def date(text: Column) -> Column:
    """yyyyMMdd; null if it isn't one."""
    return F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd"))


def date_time(text: Column) -> Column:
    """yyyy[MM[dd[HH[mm[ss[.ffffff]]]]]]; missing parts are their first value, null if it isn't one."""
    digits = F.regexp_extract(text, r"^(\d{4}(?:\d\d){0,5})(?:\.\d{1,6})?$", 1)
    fraction = F.rpad(F.regexp_extract(text, r"\.(\d{1,6})$", 1), 6, "0")
    # what is missing after the year: month and day are 01, the time is 0
    full = F.concat(digits, F.substring(F.lit("00000101000000"), F.length(digits) + 1, F.lit(14)), F.lit("."), fraction)
    return F.when(digits != "", F.try_to_timestamp(full, F.lit("yyyyMMddHHmmss.SSSSSS")))


def time_micros(text: Column) -> Column:
    """HH[mm[ss[.ffffff]]] as microseconds of the day, null if it isn't one."""
    ok = text.rlike(r"^([01]\d|2[0-3])([0-5]\d([0-5]\d(\.\d{1,6})?)?)?$")
    digits = F.rpad(F.regexp_extract(text, r"^(\d+)", 1), 6, "0")
    part = lambda i: F.substring(digits, i, 2).cast("bigint")
    fraction = F.rpad(F.regexp_extract(text, r"\.(\d{1,6})$", 1), 6, "0").cast("bigint")
    return F.when(ok, ((part(1) * 60 + part(3)) * 60 + part(5)) * 1_000_000 + fraction)


def icc_class(profile: Column) -> tuple[Column, Column, Column]:
    """Device class, colour space and connection space of an ICC profile's header."""
    return tuple(F.decode(F.substring(profile, at, 4), "US-ASCII") for at in (13, 17, 21))


def expand_segments(segments: Column) -> Column:
    """Values of look-up table segments (kind, start, end, length): constant, or linear to the end value."""

    def expand(s: Column) -> Column:
        steps = F.sequence(F.lit(1), s["length"])
        linear = F.transform(steps, lambda i: F.floor(s["start"] + (s["end"] - s["start"]) * i / s["length"]).cast("int"))
        return F.when(s["kind"] == "constant", F.array_repeat(s["start"], s["length"])).otherwise(linear)

    return F.flatten(F.transform(segments, expand))


def uid_of(text: Column) -> Column:
    """A stable identifier under the root for derived ones, from any text."""
    return F.concat(F.lit("2.25."), F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10))
