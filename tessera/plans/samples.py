"""Queries over samplings with several parents and constraints: sections of blocks of specimens."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera import tables
from tessera.operators import specimens as S
from tessera.plans.fixtures import fx
from tessera.plans.registry import query

_STARTS = "SELECT DISTINCT child AS start FROM fx_sampling WHERE child LIKE 'S%'"
_STEPS = "SELECT * FROM (VALUES ('P', 0, 'collection'), ('P', 1, 'fixation'), ('B', 0, 'embedding'), ('C', 0, 'sectioning'), ('C', 1, 'staining')) v(kind, ordinal, step)"


def _samplings(spark, sf):
    return fx(spark, sf, "fx_sampling")


def _starts(spark, sf):
    return _samplings(spark, sf).where(F.col("child").startswith("S")).select(F.col("child").alias("start")).distinct()


def _own_steps(spark, sf):
    names = _samplings(spark, sf).select(F.explode(F.array("child", "parent")).alias("specimen")).distinct()
    return names.join(F.broadcast(spark.sql(_STEPS)), F.substring("specimen", 1, 1) == F.col("kind")).select("specimen", "ordinal", "step")  # five rows


_UP = "u AS (SELECT child, child AS a FROM (SELECT child FROM fx_sampling UNION SELECT parent FROM fx_sampling) UNION SELECT u.child, e.parent FROM u JOIN fx_sampling e ON e.child = u.a)"


@query("spm07_constraint_reachable", f"WITH RECURSIVE {_UP} SELECT s.sampling, EXISTS (SELECT 1 FROM u WHERE u.child = s.parent AND u.a = s.constraint_source) AS reachable FROM fx_sampling s WHERE s.constraint_source IS NOT NULL")
def constraint_reachable(spark, sf):
    """Whether the specimen that a sampling is limited to is the sampled one or among its ancestors."""
    rows = _samplings(spark, sf).where("constraint_source is not null").select("sampling", "parent", "constraint_source")
    edges = _samplings(spark, sf).select("child", "parent")
    inner = tables.table(S.inner(edges), "edges")  # only what something was taken from is asked for
    up = S.ancestors(inner).select(F.col("child").alias("parent"), F.col("ancestor").alias("constraint_source"), F.lit(True).alias("above")).distinct()
    found = rows.join(up, ["parent", "constraint_source"], "left")
    return found.select("sampling", (F.coalesce("above", F.lit(False)) | (F.col("parent") == F.col("constraint_source"))).alias("reachable"))


@query("spm08_unambiguous", f"""WITH RECURSIVE e AS (SELECT child, list({{'p': parent, 'c': constraint_source}}) AS ups FROM fx_sampling GROUP BY child),
r AS (SELECT start, start AS node, CAST(['B3', 'B10', 'P5'] AS VARCHAR[]) AS cs, CAST(NULL AS BOOLEAN) AS ok FROM ({_STARTS})
UNION ALL SELECT start, CASE WHEN len(way) = 1 THEN way[1].p ELSE node END AS node, CASE WHEN len(way) = 1 AND way[1].c IS NOT NULL THEN list_append(cs, way[1].c) ELSE cs END AS cs, CASE WHEN ups IS NULL THEN true WHEN len(way) <> 1 THEN false END AS ok
FROM (SELECT r.start, r.node, r.cs, e.ups, CASE WHEN len(e.ups) = 1 THEN e.ups ELSE list_filter(e.ups, lambda x: list_contains(r.cs, x.p)) END AS way FROM r LEFT JOIN e ON e.child = r.node WHERE r.ok IS NULL))
SELECT start, ok AS unambiguous FROM r WHERE ok IS NOT NULL""")
def unambiguous(spark, sf):
    edges = _samplings(spark, sf).select("child", "parent", F.col("constraint_source").alias("constraint"))
    return S.unambiguous(edges, _starts(spark, sf).withColumn("constraints", F.array(F.lit("B3"), F.lit("B10"), F.lit("P5"))))


@query("spm09_graph_to_steps", f"""WITH RECURSIVE r AS (SELECT start, start AS node, CAST([] AS BIGINT[]) AS way, CAST(NULL AS VARCHAR) AS follows, false AS counts FROM ({_STARTS})
UNION ALL SELECT r.start, e.parent, list_append(r.way, e.ordinal), e.follows, true FROM r JOIN fx_sampling e ON e.child = r.node WHERE r.follows IS NULL OR e.sampling = r.follows),
s AS ({_STEPS}), t AS (SELECT r.start, r.node AS specimen, s.step, list_concat(r.way, [1073741824, s.ordinal]) AS k FROM r JOIN s ON s.kind = r.node[1] WHERE r.counts
UNION ALL SELECT start, node, 'sampling', list_concat(way, [1073741824, 1073741824]) FROM r WHERE counts)
SELECT start, row_number() OVER (PARTITION BY start ORDER BY k) - 1 AS nth, specimen, step FROM t""")
def graph_to_steps(spark, sf):
    """Steps of all slide samples, of several branches unless a sampling is limited to one."""
    edges = _samplings(spark, sf).select("sampling", "child", "parent", "ordinal", "follows")
    return S.ordered_steps(edges, _own_steps(spark, sf), _starts(spark, sf))


@query("spm10_graph_json", "SELECT sampling, child, parent, CAST(row_number() OVER (PARTITION BY parent ORDER BY child, sampling) - 1 AS BIGINT) AS step_index FROM fx_sampling")
def graph_json(spark, sf):
    """Specimens as JSON documents, samplings as (identifier, index of the parent's step), read again and resolved."""
    at = Window.partitionBy("parent").orderBy("child", "sampling")
    edges = _samplings(spark, sf).withColumn("step_index", (F.row_number().over(at) - 1).cast("bigint"))
    taken = edges.groupBy(F.col("child").alias("identifier")).agg(F.sort_array(F.collect_list(F.struct(F.col("parent").alias("identifier"), F.col("step_index").alias("sampling_step_index")))).alias("sampled_from"))
    given = edges.groupBy(F.col("parent").alias("identifier")).agg(F.sort_array(F.collect_list(F.struct("step_index", F.col("sampling").alias("id")))).alias("steps"))
    text = taken.join(given, "identifier", "full_outer").select(F.to_json(F.struct("identifier", "sampled_from", "steps")).alias("j"))
    back = text.select(F.from_json("j", "identifier string, sampled_from array<struct<identifier: string, sampling_step_index: bigint>>, steps array<struct<step_index: bigint, id: string>>").alias("d")).select("d.*")
    child = back.select(F.col("identifier").alias("child"), F.explode("sampled_from").alias("f")).select("child", F.col("f.identifier").alias("parent"), F.col("f.sampling_step_index").alias("step_index"))
    step = back.select(F.col("identifier").alias("parent"), F.explode("steps").alias("s")).select("parent", "s.step_index", F.col("s.id").alias("sampling"))
    return child.join(step, ["parent", "step_index"]).select("sampling", "child", "parent", "step_index")


@query("spm11_new_samples", "SELECT 'N' || parent AS child, parent, count(*) AS before, count(*) AS step_index FROM fx_sampling WHERE parent LIKE 'C%' GROUP BY parent")
def new_samples(spark, sf):
    """A further sample of every section: the sampling is the parent's next step."""
    had = _samplings(spark, sf).where(F.col("parent").startswith("C")).groupBy("parent").agg(F.count("*").alias("before"))
    return had.select(F.concat(F.lit("N"), "parent").alias("child"), "parent", "before", F.col("before").alias("step_index"))


_CODES = {"433465004": "sampling", "17636008": "collection", "9265001": "processing", "127790008": "staining", "433469005": "embedding", "430864009": "fixation", "434466009": "receiving"}


@query("spm12_step_kinds", "SELECT kind, count(*) AS n FROM (SELECT CASE l_linenumber " + " ".join(f"WHEN {i + 1} THEN '{k}'" for i, k in enumerate(_CODES.values())) + " ELSE 'unknown' END AS kind FROM lineitem) GROUP BY kind")
def step_kinds(spark, sf):
    """Kinds of steps by the codes of their processing type; codes that aren't known stay apart."""
    codes = F.array(*[F.lit(c) for c in _CODES])
    kinds = F.create_map(*[F.lit(x) for kv in _CODES.items() for x in kv])
    rows = fx(spark, sf, "lineitem").select(F.get(codes, F.col("l_linenumber") - 1).alias("code"))
    return rows.groupBy(F.coalesce(F.try_element_at(kinds, F.coalesce("code", F.lit(""))), F.lit("unknown")).alias("kind")).agg(F.count("*").alias("n"))


@query("spm04_unknown_parent", """WITH f AS (SELECT l_orderkey AS slide, l_suppkey % 5 AS specimen, min(l_linenumber) AS place FROM lineitem GROUP BY 1, 2), p AS (SELECT *, lag(specimen) OVER (PARTITION BY slide ORDER BY place, specimen) AS previous FROM f)
SELECT slide, specimen, CASE WHEN specimen % 2 = 1 THEN specimen - 1 ELSE previous END AS parent, specimen % 2 = 0 AND previous IS NOT NULL AS unknown FROM p""")
def unknown_parent(spark, sf):
    """Where a specimen doesn't say what it was taken from, it was taken in an unknown way from the one before it on the slide."""
    first = fx(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("slide"), (F.col("l_suppkey") % 5).alias("specimen")).agg(F.min("l_linenumber").alias("at"))
    said = F.when(F.col("specimen") % 2 == 1, F.col("specimen") - 1)
    before = F.lag("specimen").over(Window.partitionBy("slide").orderBy("at", "specimen"))
    return first.select("slide", "specimen", F.coalesce(said, before).alias("parent"), (said.isNull() & before.isNotNull()).alias("unknown"))


@query("spm05_uniform_staining", "SELECT slide, count(DISTINCT stains) = 1 AS uniform FROM (SELECT l_orderkey AS slide, l_suppkey % 2 AS sample, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS stains FROM lineitem GROUP BY 1, 2) GROUP BY slide")
def uniform_staining(spark, sf):
    """Whether all samples of a slide had the same stainings."""
    stains = fx(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("slide"), (F.col("l_suppkey") % 2).alias("sample")).agg(F.array_sort(F.collect_set("l_returnflag")).alias("stains"))
    return stains.groupBy("slide").agg(F.min("stains").eqNullSafe(F.max("stains")).alias("uniform"))


@query("jn11_step_specimen", """WITH sp AS (SELECT s_suppkey AS specimen, 'ID' || CAST(s_suppkey % 40 AS VARCHAR) AS identifier, CASE WHEN s_suppkey % 3 > 0 THEN 'lab' || CAST(s_suppkey % 2 AS VARCHAR) END AS issuer FROM supplier),
st AS (SELECT c_custkey AS step, 'ID' || CAST(c_custkey % 50 AS VARCHAR) AS identifier, CASE WHEN c_custkey % 4 > 0 THEN 'lab' || CAST(c_custkey % 3 AS VARCHAR) END AS step_issuer FROM customer)
SELECT step, arg_min(specimen, (CASE WHEN step_issuer IS NOT DISTINCT FROM issuer THEN 0 ELSE 1 END) * 1000000 + specimen) AS specimen FROM st JOIN sp ON st.identifier = sp.identifier AND (step_issuer IS NULL OR issuer IS NULL OR step_issuer = issuer) GROUP BY step""")
def step_specimen(spark, sf):
    """Steps and specimens by identifiers, whose issuers one of them may not know."""
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    specimens = fx(spark, sf, "supplier").select(k.alias("specimen"), k.alias("nth"), text("ID", k % 40).alias("identifier"), F.when(k % 3 > 0, text("lab", k % 2)).alias("issuer"))
    steps = fx(spark, sf, "customer").select(c.alias("step"), text("ID", c % 50).alias("identifier"), F.when(c % 4 > 0, text("lab", c % 3)).alias("step_issuer"))
    return S.matched_steps(steps, specimens)


@query("jn12_parent_specimen", """SELECT child, parent, parent % 3 = 0 AS created, parent % 3 = 0 OR parent % 5 < 4 AS matches FROM (SELECT DISTINCT l_orderkey AS child, l_suppkey AS parent FROM lineitem)""")
def parent_specimen(spark, sf):
    """Parents that samplings name: known ones with what was done to them, the others created."""
    named = fx(spark, sf, "lineitem").select(F.col("l_orderkey").alias("child"), F.col("l_suppkey").alias("parent")).distinct().withColumn("steps", F.array(F.lit("fixation"), F.lit("embedding")))
    done = F.when(F.col("specimen") % 5 < 4, F.array(F.lit("fixation"), F.lit("embedding"))).otherwise(F.array(F.lit("fixation")))
    known = fx(spark, sf, "lineitem").select(F.col("l_suppkey").alias("specimen")).distinct().where("specimen % 3 > 0").withColumn("steps", done)
    return S.with_parents(named, known)
