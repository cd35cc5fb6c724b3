"""Queries over metadata, codes, text, dates and binary headers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import strings as S
from tessera.plans.fixtures import fx
from tessera.plans.registry import query


@query("strf01_code_string", "SELECT p_partkey, left(trim(regexp_replace(upper(p_name || '-' || p_type), '[^A-Z0-9 _]', '_', 'g')), 16) AS code FROM part")
def code_string(spark, sf):
    return fx(spark, sf, "part").select("p_partkey", S.code_string(F.concat_ws("-", "p_name", "p_type"), 16).alias("code"))


@query("strf02_issuer", "SELECT s_suppkey, nullif(split_part(issuer, '^', 1), '') AS local, nullif(split_part(issuer, '^', 2), '') AS universal, nullif(split_part(issuer, '^', 3), '') AS kind FROM fx_identifier")
def issuer(spark, sf):
    return fx(spark, sf, "fx_identifier").select("s_suppkey", S.issuer(F.col("issuer")).alias("i")).select("s_suppkey", "i.local", "i.universal", "i.kind")


@query("strf02_issuer_round_trip", "SELECT s_suppkey, nullif(issuer, '') AS issuer FROM fx_identifier")
def issuer_round_trip(spark, sf):
    return fx(spark, sf, "fx_identifier").select("s_suppkey", S.issuer_text(S.issuer(F.col("issuer"))).alias("issuer"))


@query("strf04_unit_code", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'unary' WHEN 1 THEN 'ratio' ELSE 'um' END AS unit FROM events")
def unit_code(spark, sf):
    code = F.element_at(F.array(F.lit("1"), F.lit("{ratio}"), F.lit("um")), (F.col("event_id") % 3 + 1).cast("int"))
    return fx(spark, sf, "events").select("event_id", S.unit_name(code).alias("unit"))


@query("strf05_yes_no", "SELECT file_id, CASE WHEN spacing > 0.0005 THEN 'YES' ELSE 'NO' END AS flag FROM fx_header")
def yes_no(spark, sf):
    return fx(spark, sf, "fx_header").select("file_id", S.yes_no(F.when(F.col("spacing") > 0, F.col("spacing") > 0.0005)).alias("flag"))


@query("strf06_enum", "SELECT file_id, CASE WHEN image_type IN ('VOLUME', 'LABEL') THEN image_type END AS kind FROM fx_header")
def enum(spark, sf):
    return fx(spark, sf, "fx_header").select("file_id", S.enum(F.col("image_type"), "VOLUME", "LABEL").alias("kind"))


@query("dt01_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders")
def dates(spark, sf):
    return fx(spark, sf, "orders").select("o_orderkey", S.date(F.date_format("o_orderdate", "yyyyMMdd")).cast("string").alias("d"))


@query("dt01_invalid_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders")
def invalid_dates(spark, sf):
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.lit("20219999"))
    return fx(spark, sf, "orders").select("o_orderkey", S.date(text).cast("string").alias("d"))


@query("dt01_date_times", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('minute', ts) ELSE CAST(date_trunc('month', ts) AS TIMESTAMP) END AS t FROM events")
def date_times(spark, sf):
    form = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyyMMddHHmmss")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyyMMddHHmm")).otherwise(F.date_format("ts", "yyyyMM"))
    return fx(spark, sf, "events").select("event_id", S.date_time(form).alias("t"))


@query("dt01_times", "SELECT event_id, CAST((hour(ts) * 3600 + minute(ts) * 60 + CASE WHEN event_id % 2 = 0 THEN second(ts) ELSE 0 END) * 1000000 AS BIGINT) AS micros FROM events")
def times(spark, sf):
    text = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "HHmmss")).otherwise(F.date_format("ts", "HHmm"))
    return fx(spark, sf, "events").select("event_id", S.time_micros(text).alias("micros"))


@query("arr02_single_to_list", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0 ELSE 1 END AS n FROM events")
def single_to_list(spark, sf):
    value = F.when(F.col("event_id") % 4 != 0, F.col("event_type"))
    return fx(spark, sf, "events").select("event_id", F.size(F.array_compact(F.array(value))).alias("n"))


@query("bin02_icc_header", "SELECT s_suppkey, 'scnr' AS device, CASE WHEN s_suppkey % 2 = 0 THEN 'RGB ' ELSE 'GRAY' END AS space, 'Lab ' AS connection FROM supplier")
def icc_header(spark, sf):
    profile = F.concat(F.repeat(F.lit("\0"), F.lit(12)), F.lit("scnr"), F.when(F.col("s_suppkey") % 2 == 0, "RGB ").otherwise("GRAY"), F.lit("Lab ")).cast("binary")
    device, space, connection = S.icc_class(profile)
    return fx(spark, sf, "supplier").select("s_suppkey", device.alias("device"), space.alias("space"), connection.alias("connection"))


@query("md04_flatten", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def flatten(spark, sf):
    nested = fx(spark, sf, "customer").select("c_custkey", F.struct("c_name", F.struct("c_nationkey").alias("place")).alias("person"))
    return nested.select("c_custkey", "person.c_name", "person.place.c_nationkey")


@query("md06_uid_generation", "SELECT s_suppkey, '2.25.' || CAST(CAST('0x' || substring(sha256(s_name), 1, 15) AS BIGINT) AS VARCHAR) AS uid FROM supplier")
def uid_generation(spark, sf):
    return fx(spark, sf, "supplier").select("s_suppkey", S.uid_of(F.col("s_name")).alias("uid"))
