"""Slide metadata as nested records: from and to the header's flat values, and as JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import strings as S

#: Modules and their fields, by the header's column names; the value is the type the field has in the record.
MODULES: dict[str, dict[str, str]] = {
    "study": {"study_uid": "string", "study_id": "string", "study_date": "date", "study_time": "bigint", "accession_number": "string", "referring_physician": "person"},
    "series": {"series_uid": "string", "series_number": "int"},
    "patient": {"patient_name": "person", "patient_id": "string", "birth_date": "date", "sex": "string", "identity_removed": "boolean"},
    "equipment": {"manufacturer": "string", "model": "string", "serial": "string", "software": "list"},
    "image": {"acquired": "timestamp", "image_type": "string", "focus_method": "string", "spacing_x": "double", "lossy": "boolean"},
    "optical_path": {"path_id": "string", "path_description": "string", "illumination": "code"},
}
_PERSON = "struct<family:string,given:string,middle:string,prefix:string,suffix:string>"
_CODE = "struct<value:string,scheme:string,meaning:string>"
TYPES = {"person": _PERSON, "code": _CODE, "list": "array<string>"}
SCHEMA = ", ".join(f"{m} struct<{', '.join(f'{k}:{TYPES.get(t, t)}' for k, t in fields.items())}>" for m, fields in MODULES.items())


def person(text: Column) -> Column:
    """Parts of family^given^middle^prefix^suffix; missing ones are null, and so is a name without any."""
    part = lambda i: F.nullif(F.trim(F.get(F.split(text, r"\^"), i)), F.lit(""))
    out = F.struct(*[part(i).alias(n) for i, n in enumerate(("family", "given", "middle", "prefix", "suffix"))])
    return F.when(F.coalesce(*[part(i) for i in range(5)]).isNotNull(), out)


def person_text(name: Column) -> Column:
    """The text of a person's name, without empty parts at the end."""
    whole = F.concat_ws("^", *[F.coalesce(name[n], F.lit("")) for n in ("family", "given", "middle", "prefix", "suffix")])
    return F.when(name.isNotNull(), F.regexp_replace(whole, r"\^+$", ""))


def code(text: Column) -> Column:
    """A code of value^scheme^meaning."""
    part = lambda i: F.nullif(F.get(F.split(text, r"\^"), i), F.lit(""))
    return F.when(part(0).isNotNull(), F.struct(part(0).alias("value"), part(1).alias("scheme"), part(2).alias("meaning")))


def _read(kind: str, c: Column) -> Column:
    if kind == "date":
        return S.date(c)
    if kind == "bigint":
        return S.time_micros(c)
    if kind == "timestamp":
        return S.date_time(c)
    if kind == "person":
        return person(c)
    if kind == "code":
        return code(c)
    if kind == "boolean":
        return F.when(c.isin("YES", "01"), True).when(c.isin("NO", "00"), False)
    if kind == "list":
        return F.when(c.isNotNull(), F.split(c, r"\\"))
    return c.cast(kind)


def _written(kind: str, c: Column) -> Column:
    if kind == "date":
        return F.date_format(c, "yyyyMMdd")
    if kind == "bigint":
        two = lambda x: F.lpad(x.cast("string"), 2, "0")
        s = F.floor(c / 1_000_000)
        fraction = F.when(c % 1_000_000 > 0, F.concat(F.lit("."), F.lpad((c % 1_000_000).cast("string"), 6, "0"))).otherwise("")
        return F.concat(two(F.floor(s / 3600)), two(F.floor(s / 60) % 60), two(s % 60), fraction)
    if kind == "timestamp":
        return F.date_format(c, "yyyyMMddHHmmss.SSSSSS")
    if kind == "person":
        return person_text(c)
    if kind == "code":
        return F.when(c.isNotNull(), F.concat_ws("^", c["value"], c["scheme"], c["meaning"]))
    if kind == "list":
        return F.array_join(c, "\\")
    return c


def from_header() -> list[Column]:
    """The modules of flat header values (text as the file has it)."""
    return [F.struct(*[_read(t, F.col(k)).alias(k) for k, t in fields.items()]).alias(m) for m, fields in MODULES.items()]


def to_header(flags: dict[str, tuple[str, str]] | None = None) -> list[Column]:
    """Flat header values of the modules. flags: texts for yes and no of a field, YES and NO unless given."""
    out = []
    for m, fields in MODULES.items():
        for k, t in fields.items():
            c = F.col(f"{m}.{k}")
            if t == "boolean":
                yes, no = (flags or {}).get(k, ("YES", "NO"))
                c = F.when(c, yes).when(~c, no)
            out.append(_written(t, c).alias(k))
    return out


def defaulted(value: Column, default: Column | None = None, required: bool = False, name: str = "") -> Column:
    """A field on its way to a file: its value, else its default; an error if it must have one."""
    out = F.coalesce(value, default) if default is not None else value
    return F.coalesce(out, F.raise_error(F.lit(f"{name} is required")).cast("string")) if required else out


def deidentified() -> list[Column]:
    """The modules without what tells who the patient is, and saying so."""
    kept = [F.col(m) for m in MODULES if m != "patient"]
    study = F.col("study").withField("accession_number", F.lit(None).cast("string")).withField("referring_physician", F.lit(None).cast(_PERSON))
    patient = F.struct(F.lit(None).cast(_PERSON).alias("patient_name"), F.lit(None).cast("string").alias("patient_id"), F.lit(None).cast("date").alias("birth_date"), F.col("patient.sex").alias("sex"), F.lit(True).alias("identity_removed"))
    return [study.alias("study"), *kept[1:], patient.alias("patient")]
