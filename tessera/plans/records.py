"""Queries over metadata records, codes, names, profiles and look-up tables."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.functions import binary as B
from tessera.functions import strings as S
from tessera.operators import headers as H
from tessera.operators import metadata as M
from tessera.plans.files import _folder
from tessera.plans.fixtures import fx
from tessera.plans.registry import query
from tessera.sources.sinks import prepare_folder

_FLAT = [k for fields in M.MODULES.values() for k in fields]


def _headers(spark, sf):
    return fx(spark, sf, "fx_record")


_SAME = ", ".join(_FLAT)


@query("md07_module_projection", f"SELECT file_id, {_SAME} FROM fx_record")
def module_projection(spark, sf):
    """Headers to the modules' records and back to headers: all of their values."""
    rows = _headers(spark, sf).select("file_id", *M.from_header())
    return rows.select("file_id", *M.to_header({"lossy": ("01", "00")}))


@query("jsn01_typed_json", f"SELECT file_id, {_SAME} FROM fx_record")
def typed_json(spark, sf):
    """The records through JSON text: dates, times, names, codes and lists keep their types."""
    options = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    text = _headers(spark, sf).select("file_id", *M.from_header()).select("file_id", F.to_json(F.struct(*M.MODULES), options).alias("j"))
    back = text.select("file_id", F.from_json("j", M.SCHEMA, options).alias("d")).select("file_id", "d.*")
    return back.select("file_id", *M.to_header({"lossy": ("01", "00")}))


@query("src26_metadata_json", "SELECT file_id, nullif(split_part(patient_name, '^', 1), '') AS family, study_uid, strftime(strptime(birth_date, '%Y%m%d'), '%Y-%m-%d') AS birth_date, len(string_split(software, chr(92))) AS versions FROM fx_record")
def metadata_json(spark, sf):
    """Metadata files: JSON documents in a folder, read with the records' schema."""
    folder = _folder(spark)
    folder = folder if "://" in folder else f"file://{folder}"
    _headers(spark, sf).select("file_id", *M.from_header()).write.json(folder)
    rows = spark.read.schema(f"file_id bigint, {M.SCHEMA}").json(folder)
    return rows.select("file_id", F.col("patient.patient_name.family").alias("family"), "study.study_uid", F.col("patient.birth_date").cast("string").alias("birth_date"), F.size("equipment.software").cast("bigint").alias("versions"))


@query("snk24_json_dump", """SELECT file_id, '{"series":{"series_uid":"' || series_uid || '","series_number":' || CAST(series_number AS VARCHAR) || '},"image":{"image_type":"' || image_type || '"' || CASE WHEN focus_method IS NULL THEN '' ELSE ',"focus_method":"' || focus_method || '"' END || '}}' AS j FROM fx_record""")
def json_dump(spark, sf):
    """Metadata as JSON text; what isn't known isn't there."""
    rows = _headers(spark, sf).select("file_id", *M.from_header())
    image = F.struct(F.col("image.image_type").alias("image_type"), F.col("image.focus_method").alias("focus_method"))
    return rows.select("file_id", F.to_json(F.struct("series", image.alias("image"))).alias("j"))


@query("prj09_deidentify", f"SELECT file_id, {', '.join('CAST(NULL AS VARCHAR) AS ' + k if k in ('patient_name', 'patient_id', 'birth_date', 'accession_number', 'referring_physician') else chr(39) + 'YES' + chr(39) + ' AS identity_removed' if k == 'identity_removed' else k for k in _FLAT)} FROM fx_record")
def deidentify(spark, sf):
    """Headers without the patient's name, identifier and birth date, the accession number and the physician."""
    rows = _headers(spark, sf).select("file_id", *M.from_header()).select("file_id", *M.deidentified())
    return rows.select("file_id", *M.to_header({"lossy": ("01", "00")}))


@query("md03_defaults", "SELECT file_id, coalesce(focus_method, 'AUTO') AS by_value, CAST(NULL AS VARCHAR) AS by_none, coalesce(path_id, '0') AS by_tag, coalesce(software, 'unknown') AS by_list FROM fx_record")
def defaults(spark, sf):
    """Fields that aren't there: a value, nothing, the value of another element, a list of one."""
    listed = M.defaulted(F.split("software", r"\\"), F.array(F.lit("unknown")))
    return _headers(spark, sf).select("file_id", M.defaulted(F.col("focus_method"), F.lit("AUTO")).alias("by_value"), F.lit(None).cast("string").alias("by_none"), M.defaulted(F.col("path_id"), F.lit("0")).alias("by_tag"), F.array_join(listed, "\\").alias("by_list"))


@query("md05_required", "SELECT file_id, study_uid, focus_method IS NULL AS missing FROM fx_record")
def required(spark, sf):
    """Fields that a file must have raise where they are null; what is asked for here is always there, what isn't is told."""
    return _headers(spark, sf).select("file_id", M.defaulted(F.col("study_uid"), required=True, name="study_uid").alias("study_uid"), F.col("focus_method").isNull().alias("missing"))


_KINDS = "SELECT slide_id, min(CASE WHEN image_type = 'LABEL' THEN uid END) AS label, min(CASE WHEN image_type = 'OVERVIEW' THEN uid END) AS overview FROM fx_file WHERE image_type IN ('LABEL', 'OVERVIEW') GROUP BY slide_id"


@query("md01_slide_metadata", f"WITH v AS (SELECT slide_id, count(*) AS levels, max(total_columns) AS width, min(spacing) AS spacing FROM fx_file WHERE image_type = 'VOLUME' GROUP BY slide_id), k AS ({_KINDS}) SELECT v.slide_id, levels, width, spacing, label, overview FROM v LEFT JOIN k ON k.slide_id = v.slide_id")
def slide_metadata(spark, sf):
    """A slide's record from its pyramid, its label and its overview, where it has them: one pass over the headers."""
    of = lambda kind, c: F.when(F.col("image_type") == kind, F.col(c))
    pyramid = F.struct(F.count(of("VOLUME", "file_id")).alias("levels"), F.max(of("VOLUME", "total_columns")).alias("width"), F.min(of("VOLUME", "spacing")).alias("spacing"))
    rows = fx(spark, sf, "fx_file").groupBy("slide_id").agg(pyramid.alias("pyramid"), F.min(of("LABEL", "uid")).alias("label"), F.min(of("OVERVIEW", "uid")).alias("overview"))
    return rows.where("pyramid.levels > 0").select("slide_id", "pyramid.*", "label", "overview")


@query("md02_dump_by_kind", """SELECT file_id, 'ISO_IR 192' AS charset, CASE image_type WHEN 'VOLUME' THEN coalesce(organization, 'TILED_FULL') WHEN 'LABEL' THEN 'TILED_FULL' ELSE coalesce(organization, 'TILED_SPARSE') END AS organization,
  CASE WHEN image_type = 'LABEL' THEN coalesce(origin_x, 0.0E0) WHEN image_type = 'OVERVIEW' THEN coalesce(origin_x, 0.0E0) ELSE coalesce(origin_x, 0.0E0) END AS x, CASE WHEN image_type = 'LABEL' THEN coalesce(origin_y, 50.0E0) ELSE coalesce(origin_y, 0.0E0) END AS y, samples = 3 AS profile, CASE WHEN image_type = 'LABEL' THEN 'YES' ELSE 'NO' END AS label_in_image FROM fx_file WHERE image_type IN ('VOLUME', 'LABEL', 'OVERVIEW', 'THUMBNAIL')""")
def dump_by_kind(spark, sf):
    """What a file of each kind says where the metadata doesn't: place on the slide, colour profile, characters."""
    kind = F.col("image_type")
    rows = fx(spark, sf, "fx_file").where(kind.isin(*H.IMAGE_TYPES))
    organization = F.when(kind == "VOLUME", F.coalesce("organization", F.lit("TILED_FULL"))).when(kind == "LABEL", "TILED_FULL").otherwise(F.coalesce("organization", F.lit("TILED_SPARSE")))
    y = F.coalesce("origin_y", F.when(kind == "LABEL", 50.0).otherwise(0.0))  # the label lies behind the 50 mm of the slide without it
    return rows.select("file_id", F.lit("ISO_IR 192").alias("charset"), organization.alias("organization"), F.coalesce("origin_x", F.lit(0.0)).alias("x"), y.alias("y"), (F.col("samples") == 3).alias("profile"), F.when(kind == "LABEL", "YES").otherwise("NO").alias("label_in_image"))


# Codes and meanings of common stains.
STAINS = {"12710003": "hematoxylin stain", "36879007": "water soluble eosin stain", "371868005": "Papanicolaou stain", "104210008": "Hematoxylin and eosin stain method", "24851008": "acid fast stain", "23259004": "Giemsa stain"}


@query("strf03_code_lookup", "SELECT c_custkey, CASE c_custkey % 8 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(STAINS)) + " END AS code FROM customer")
def code_lookup(spark, sf):
    """Codes by their meanings in any case; what isn't among them has none."""
    meanings = F.array(*[F.lit(m) for m in STAINS.values()])
    asked = F.coalesce(F.get(meanings, (F.col("c_custkey") % 8).cast("int")), F.lit("some other stain"))
    rows = fx(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.upper(asked)).otherwise(F.initcap(asked)).alias("meaning"))
    table = spark.createDataFrame(list(STAINS.items()), "code string, own string").select("code", F.lower("own").alias("own"))
    return rows.join(F.broadcast(table), F.lower("meaning") == F.col("own"), "left").select("c_custkey", "code")  # six rows


@query("strf07_person_name", "SELECT file_id, nullif(split_part(patient_name, '^', 1), '') AS family, nullif(split_part(patient_name, '^', 2), '') AS given, nullif(split_part(patient_name, '^', 3), '') AS middle, nullif(split_part(patient_name, '^', 5), '') AS suffix, patient_name AS again FROM fx_record")
def person_name(spark, sf):
    rows = _headers(spark, sf).select("file_id", M.person(F.col("patient_name")).alias("p"))
    return rows.select("file_id", "p.family", "p.given", "p.middle", "p.suffix", M.person_text(F.col("p")).alias("again"))


@query("strf08_option_names", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'basic' WHEN 1 THEN 'extended' WHEN 2 THEN 'empty' WHEN 3 THEN 'none' WHEN 4 THEN NULL ELSE 'basic' END AS name FROM events")
def option_names(spark, sf):
    """Names of options in any case and with spaces; others aren't options."""
    texts = F.array(*[F.lit(t) for t in (" Basic", "EXTENDED ", "empty", "None", "bot", "BASIC")])
    name = F.lower(F.trim(F.get(texts, (F.col("event_id") % 6).cast("int"))))
    return fx(spark, sf, "events").select("event_id", S.enum(name, "basic", "extended", "empty", "none").alias("name"))


@query("strf09_printed", "SELECT slide_id, 'slide ' || CAST(slide_id AS VARCHAR) || chr(10) || string_agg('  level ' || CAST(level AS VARCHAR) || ': ' || CAST(width AS VARCHAR) || ' x ' || CAST(height AS VARCHAR) || ', ' || CAST(n_planes AS VARCHAR) || ' planes', chr(10) ORDER BY level) AS text FROM fx_level GROUP BY slide_id")
def printed(spark, sf):
    """A slide and its levels, a line each, indented by depth."""
    line = F.format_string("  level %d: %d x %d, %d planes", "level", "width", "height", "n_planes")
    rows = fx(spark, sf, "fx_level").groupBy("slide_id").agg(F.sort_array(F.collect_list(F.struct("level", line.alias("line")))).alias("l"))
    return rows.select("slide_id", F.concat(F.lit("slide "), F.col("slide_id").cast("string"), F.lit("\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("text"))


@query("bin01_number_bytes", "SELECT vec_id, k AS kind, len(embedding) * CASE k WHEN 'double' THEN 8 ELSE 4 END AS bytes, round(CASE k WHEN 'long' THEN list_sum(list_transform(embedding, lambda x: CAST(trunc(CAST(x AS DOUBLE) * 1000) AS DOUBLE))) ELSE list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) END, 6) AS total FROM embeddings, (SELECT unnest(['double', 'float', 'long']) AS k)")
def number_bytes(spark, sf):
    """Numbers to bytes and back: doubles, floats and 32-bit integers, little end first. All kinds, and both ways, go through one worker."""
    rows = fx(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.transform("embedding", lambda x: x.cast("double") * 1000).alias("thousandths"))
    raw = {kind: B.number_bytes(F.col("thousandths" if kind == "long" else "v"), kind) for kind in B.KINDS}
    both = rows.select("vec_id", *[c for kind, r in raw.items() for c in (r.alias(f"{kind}_raw"), B.numbers(r, kind).alias(kind))])
    total = lambda kind: F.round(F.aggregate(kind, F.lit(0.0), lambda a, x: a + x), 6)
    each = [F.struct(F.lit(kind).alias("kind"), F.length(f"{kind}_raw").cast("bigint").alias("bytes"), total(kind).alias("total")) for kind in raw]
    return both.select("vec_id", F.explode(F.array(*each)).alias("k")).select("vec_id", "k.*")


def _profiles(spark, sf):
    """A profile a supplier: text, multi-language text, or none."""

    def run(batches):
        for batch in batches:
            made = [None if k % 5 == 4 else b"not a profile" if k % 5 == 3 else B.with_description(n, multi=k % 2 == 1) for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["s_suppkey", "profile"])

    return fx(spark, sf, "supplier").select("s_suppkey", "s_name").mapInArrow(run, "s_suppkey long, profile binary")


@query("bin03_profile_name", "SELECT s_suppkey, CASE WHEN s_suppkey % 5 < 3 THEN s_name END AS name FROM supplier")
def profile_name(spark, sf):
    """Names of colour spaces from their profiles; what can't be read has none."""
    return _profiles(spark, sf).select("s_suppkey", B.profile_name(F.col("profile")).alias("name"))


@query("src27_profile_files", "SELECT s_suppkey, CASE WHEN s_suppkey % 5 < 3 THEN s_name END AS name, s_suppkey % 3 = 0 AS by_path FROM supplier WHERE s_suppkey % 5 < 4")
def profile_files(spark, sf):
    """Profiles of JSON documents, given as bytes or by the path of a file: a join with the files that are there."""
    folder = prepare_folder(_folder(spark))

    def write(batches):
        for batch in batches:
            for k, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if p is not None and k % 3 == 0:
                    with open(f"{folder}/{k}.icc", "wb") as f:
                        f.write(p)
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], names=["n"])

    _profiles(spark, sf).mapInArrow(write, "n long").count()
    path = F.concat(F.lit(f"{folder}/"), F.col("s_suppkey").cast("string"), F.lit(".icc"))
    given = F.when(F.col("s_suppkey") % 3 == 0, path).otherwise(F.base64("profile"))
    text = _profiles(spark, sf).where("profile is not null").select(F.to_json(F.struct("s_suppkey", given.alias("icc"), (F.col("s_suppkey") % 3 == 0).alias("by_path"))).alias("j"))
    docs = text.select(F.from_json("j", "s_suppkey bigint, icc string, by_path boolean").alias("d")).select("d.*")
    files = spark.read.format("binaryFile").load(folder).select(F.regexp_replace("path", "^file:/*", "/").alias("icc"), "content")
    raw = F.coalesce("content", F.when(~F.col("by_path"), F.unbase64("icc")))
    return docs.join(files, "icc", "left").select("s_suppkey", B.profile_name(raw).alias("name"), "by_path")


_WORDS = "CASE s_suppkey % 4 WHEN 0 THEN [0, 3, 10, 20, s_suppkey, 1, 4, 200] WHEN 1 THEN [0, 1, s_suppkey, 1, 8, s_suppkey, 1, 5, 0] WHEN 2 THEN [0, 2, 5, 6, 2, 3, 0, 0] ELSE [0, 9, 1] END"


@query("bin04_lut_segments", """SELECT s_suppkey, CASE WHEN s_suppkey % 4 < 2 THEN CASE s_suppkey % 4 WHEN 0 THEN 7 ELSE 14 END END AS n, CAST(CASE s_suppkey % 4 WHEN 0 THEN 30 + s_suppkey + s1 WHEN 1 THEN 9 * s_suppkey + s2 END AS BIGINT) AS total, CASE WHEN s_suppkey % 4 < 2 THEN CASE s_suppkey % 4 WHEN 0 THEN 200 ELSE 0 END / 256.0E0 END AS last_scaled
FROM (SELECT s_suppkey, sum(s_suppkey + floor((200 - s_suppkey) * i / 4.0)) FILTER (WHERE i <= 4) AS s1, sum(s_suppkey + floor((0 - s_suppkey) * i / 5.0)) AS s2 FROM supplier, (SELECT unnest([1, 2, 3, 4, 5]) AS i) GROUP BY s_suppkey)""")
def lut_segments(spark, sf):
    """Segmented tables: runs, steps to a value, constants; operations that aren't supported and tables that end early have no values."""
    k = F.col("s_suppkey").cast("int")
    words = lambda *v: F.array(*[x if not isinstance(x, int) else F.lit(x) for x in v])
    table = F.when(k % 4 == 0, words(0, 3, 10, 20, k, 1, 4, 200)).when(k % 4 == 1, words(0, 1, k, 1, 8, k, 1, 5, 0)).when(k % 4 == 2, words(0, 2, 5, 6, 2, 3, 0, 0)).otherwise(words(0, 9, 1))
    rows = fx(spark, sf, "supplier").select("s_suppkey", B.lut(table).alias("v"))
    scaled = B.scaled(F.col("v"), 16, 8)
    return rows.select("s_suppkey", F.when(F.col("v").isNotNull(), F.size("v")).alias("n"), F.aggregate("v", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), F.element_at(scaled, -1).alias("last_scaled"))


@query("agg16_lut_lengths", "SELECT l_orderkey, CASE WHEN a = b AND b = c THEN CAST(a AS INT) END AS length FROM (SELECT l_orderkey, count(*) FILTER (WHERE l_linenumber <= 3) AS a, count(*) FILTER (WHERE l_linenumber <= 4) AS b, count(DISTINCT l_suppkey) FILTER (WHERE l_linenumber <= 3) AS c FROM lineitem GROUP BY l_orderkey)")
def lut_lengths(spark, sf):
    """Length of a table's three channels, where they have one."""
    few = F.col("l_linenumber") <= 3
    rows = fx(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.when(few, F.col("l_suppkey"))).alias("a"), F.collect_list(F.when(F.col("l_linenumber") <= 4, F.col("l_suppkey"))).alias("b"), F.collect_set(F.when(few, F.col("l_suppkey"))).alias("c"))
    return rows.select("l_orderkey", B.same_length(F.col("a"), F.col("b"), F.col("c")).alias("length"))
