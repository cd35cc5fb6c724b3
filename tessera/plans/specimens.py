"""Queries over specimen graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import specimens as S
from tessera.plans.fixtures import fx
from tessera.plans.registry import query

_STEPS = """SELECT event_id % 500 AS specimen, event_id AS ordinal, CASE WHEN event_id % 13 = 0 THEN 'sampling' WHEN event_id % 17 = 0 THEN 'collection' ELSE 'processing' END AS kind FROM events"""
_UP = "r AS (SELECT child, parent AS ancestor, 1 AS distance FROM fx_specimen_edge UNION ALL SELECT r.child, e.parent, r.distance + 1 FROM r JOIN fx_specimen_edge e ON e.child = r.ancestor)"


def _steps(spark, sf):
    kind = F.when(F.col("event_id") % 13 == 0, "sampling").when(F.col("event_id") % 17 == 0, "collection").otherwise("processing")
    return fx(spark, sf, "events").select((F.col("event_id") % 500).alias("specimen"), F.col("event_id").alias("ordinal"), kind.alias("kind"))


@query("spm01_ordered_steps", f"SELECT specimen, string_agg(kind, ',' ORDER BY ordinal) AS steps FROM ({_STEPS}) GROUP BY specimen")
def ordered_steps(spark, sf):
    rows = _steps(spark, sf).groupBy("specimen").agg(F.sort_array(F.collect_list(F.struct("ordinal", "kind"))).alias("s"))
    return rows.select("specimen", F.array_join(F.transform("s", lambda x: x["kind"]), ",").alias("steps"))


@query("spm02_ancestry", f"WITH RECURSIVE {_UP} SELECT child, ancestor, distance FROM r")
def ancestry(spark, sf):
    return S.ancestors(fx(spark, sf, "fx_specimen_edge"))


@query("spm03_expanded_steps", """SELECT event_id % 500 AS specimen, event_id AS ordinal, row_number() OVER (PARTITION BY event_id ORDER BY o) - 1 AS nth, kind FROM (
SELECT event_id, 0 AS o, 'main' AS kind FROM events UNION ALL SELECT event_id, 1, 'fixation' FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 2, 'embedding' FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, 3, 'processing' FROM events WHERE event_id % 5 = 0)""")
def expanded_steps(spark, sf):
    given = lambda k: F.when(F.col("event_id") % k == 0, "x")
    rows = fx(spark, sf, "events").select((F.col("event_id") % 500).alias("specimen"), F.col("event_id").alias("ordinal"), F.lit("x").alias("main"), given(2).alias("fixation"), given(3).alias("embedding"), given(5).alias("processing"))
    return S.expanded_steps(rows).select("specimen", "ordinal", F.col("nth").cast("bigint").alias("nth"), "kind")


@query("spm06_invalid_steps", f"""SELECT specimen, ordinal, kind FROM (SELECT *, coalesce(max(CASE WHEN kind = 'sampling' THEN 1 ELSE 0 END) OVER (PARTITION BY specimen ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS after,
row_number() OVER (PARTITION BY specimen ORDER BY ordinal) AS nth FROM ({_STEPS})) WHERE (after = 1 AND kind <> 'sampling') OR (kind = 'collection' AND nth > 1)""")
def invalid_steps(spark, sf):
    return S.invalid_steps(_steps(spark, sf))


@query("jn13_leaves", "SELECT DISTINCT child FROM fx_specimen_edge WHERE child NOT IN (SELECT parent FROM fx_specimen_edge)")
def leaves(spark, sf):
    return S.leaves(fx(spark, sf, "fx_specimen_edge"))


@query("set05_unsampled", "SELECT child FROM fx_specimen_edge EXCEPT SELECT parent FROM fx_specimen_edge")
def unsampled(spark, sf):
    edges = fx(spark, sf, "fx_specimen_edge")
    return edges.select("child").subtract(edges.select("parent"))
