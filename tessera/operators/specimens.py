"""Specimen graphs: which sample was taken from which, and the preparation steps on the way."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import tables


def ancestors(edges: DataFrame, most: int = 32) -> DataFrame:
    """(child, ancestor, distance) for all ancestors; edges: child, parent, without cycles.

    A preparation chain is a few steps long: each round adds one, until nothing is new.
    """
    reach = edges.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("distance"))
    front = reach
    for n in range(2, most):
        step = edges.select(F.col("child").alias("ancestor"), F.col("parent"))
        front = front.join(step, "ancestor").select("child", F.col("parent").alias("ancestor"), F.lit(n).alias("distance"))
        if front.isEmpty():
            return reach
        reach = reach.unionByName(front)
    raise ValueError(f"no end after {most} steps: the specimen graph has a cycle")


def inner(edges: DataFrame) -> DataFrame:
    """Distinct (child, parent) of specimens that something was taken from: the graph without its leaves, which are most of it."""
    return edges.join(edges.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").distinct()


def leaves(edges: DataFrame) -> DataFrame:
    """Specimens that nothing was taken from."""
    return edges.select("child").distinct().join(edges.select(F.col("parent").alias("child")), "child", "left_anti")


def roots(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("parent").alias("child")).distinct().join(edges.select("child"), "child", "left_anti")


def expanded_steps(rows: DataFrame) -> DataFrame:
    """One preparation row to its steps in order: the main one, then fixation, embedding and processing where given."""
    kinds = F.array(*[F.when(F.col(k).isNotNull(), F.struct(F.lit(k).alias("kind"), F.col(k).alias("what"))) for k in ("main", "fixation", "embedding", "processing")])
    return rows.select("specimen", "ordinal", F.posexplode(F.filter(kinds, lambda s: s.isNotNull())).alias("nth", "step")).select("specimen", "ordinal", "nth", "step.*")


def invalid_steps(steps: DataFrame) -> DataFrame:
    """Steps that come where they can't: after a sampling, or a collection that isn't the first."""
    w = Window.partitionBy("specimen").orderBy("ordinal")
    sampled = F.max((F.col("kind") == "sampling").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = steps.withColumn("after", F.coalesce(sampled, F.lit(0)) == 1).withColumn("nth", F.row_number().over(w))
    return rows.where((F.col("after") & (F.col("kind") != "sampling")) | ((F.col("kind") == "collection") & (F.col("nth") > 1))).select("specimen", "ordinal", "kind")


def unambiguous(edges: DataFrame, starts: DataFrame, most: int = 64) -> DataFrame:
    """(start, unambiguous): whether one way leads up from each start, under its constraints.

    edges: child, parent, constraint (the specimen that the sampling must come from, or null); starts:
    start, constraints (array). Where a specimen has several parents exactly one must be among the
    constraints; those of the sampling that is followed are added. A round goes one step up for all starts.
    """
    ups = edges.groupBy("child").agg(F.collect_list(F.struct("parent", "constraint")).alias("ups"))
    front = starts.select("start", F.col("start").alias("node"), "constraints")
    done = None
    for _ in range(most):
        here = tables.table(front.join(ups, F.col("node") == F.col("child"), "left").drop("child"), "front")
        allowed = F.when(F.size("ups") == 1, F.col("ups")).otherwise(F.filter("ups", lambda u: F.array_contains(F.col("constraints"), u["parent"])))
        here = here.withColumn("way", F.when(F.col("ups").isNotNull(), allowed))
        ended = here.where("ups is null or size(way) <> 1").select("start", F.col("ups").isNull().alias("unambiguous"))
        done = ended if done is None else done.unionByName(ended)
        more = here.where("size(way) = 1").select("start", F.col("way")[0]["parent"].alias("node"), F.array_union("constraints", F.array_compact(F.array(F.col("way")[0]["constraint"]))).alias("constraints"))
        if more.isEmpty():
            return done
        front = more
    raise ValueError(f"no end after {most} steps: the specimen graph has a cycle")


def ordered_steps(edges: DataFrame, steps: DataFrame, starts: DataFrame, most: int = 64) -> DataFrame:
    """(start, nth, specimen, step): the preparation of each start in order, its ancestors' steps first.

    edges: sampling, child, parent, ordinal, follows (the sampling of the parent that this one is limited
    to, or null); steps: specimen, ordinal, step. After what was done to a specimen comes the sampling from it, and what was done to the start itself in
    the end. The walk is in post-order: rows carry their way up as an array that sorts so.
    """
    last = F.lit(1 << 30)
    ups = edges.select("sampling", "child", "parent", "ordinal", "follows")
    front = starts.select("start", F.col("start").alias("node"), F.array().cast("array<int>").alias("way"), F.lit(None).cast("string").alias("follows"))
    reached = None
    for _ in range(most):
        u = ups.withColumnRenamed("follows", "next")
        here = front.join(u, F.col("node") == F.col("child")).where("follows is null or sampling = follows")
        here = tables.table(here.select("start", F.col("parent").alias("node"), F.array_append("way", F.col("ordinal").cast("int")).alias("way"), F.col("next").alias("follows"), "sampling"), "front")
        if here.isEmpty():
            break
        reached = here if reached is None else reached.unionByName(here)
        front = here.select("start", "node", "way", "follows")
    else:
        raise ValueError(f"no end after {most} steps: the specimen graph has a cycle")
    own = steps.select(F.col("specimen").alias("node"), F.col("ordinal").alias("o"), "step")
    last_own = starts.join(own, F.col("start") == F.col("node")).select("start", F.array(last, F.col("o").cast("int")).alias("key"), F.col("node").alias("specimen"), "step")
    nth = F.row_number().over(Window.partitionBy("start").orderBy("key")) - 1
    if reached is None:
        return last_own.select("start", nth.cast("bigint").alias("nth"), "specimen", "step")
    done = reached.join(own, "node").select("start", F.concat("way", F.array(last, F.col("o").cast("int"))).alias("key"), F.col("node").alias("specimen"), "step")
    taken = reached.select("start", F.concat("way", F.array(last, last)).alias("key"), F.col("node").alias("specimen"), F.lit("sampling").alias("step"))
    return done.unionByName(taken).unionByName(last_own).select("start", nth.cast("bigint").alias("nth"), "specimen", "step")


def with_parents(samplings: DataFrame, known: DataFrame) -> DataFrame:
    """(child, parent, created, matches) of samplings (child, parent, steps): parents that nobody knows are created; known ones must have had the same steps done."""
    rows = samplings.join(known.select(F.col("specimen").alias("parent"), F.col("steps").alias("had")), "parent", "left")
    return rows.select("child", "parent", F.col("had").isNull().alias("created"), F.coalesce(F.col("had") == F.col("steps"), F.lit(True)).alias("matches"))


def matched_steps(steps: DataFrame, specimens: DataFrame) -> DataFrame:
    """(step, specimen) by identifier; issuers must be equal where both are there, equal ones first, then in order.

    Steps look up the first specimen of their identifier and issuer, of their identifier without an issuer, and of
    any issuer, each of which is one row at most: what is joined doesn't grow with the specimens that share an identifier.
    """
    own = specimens.groupBy("identifier", "issuer").agg(F.min(F.struct("nth", "specimen")).alias("at"))
    rows = steps.join(own.where("issuer is not null").select("identifier", F.col("issuer").alias("step_issuer"), F.col("at").alias("same")), ["identifier", "step_issuer"], "left")
    rows = rows.join(own.where("issuer is null").select("identifier", F.col("at").alias("unknown")), "identifier", "left")
    rows = rows.join(own.groupBy("identifier").agg(F.min("at").alias("any")), "identifier", "left")
    best = F.when(F.col("step_issuer").isNull(), F.coalesce("unknown", "any")).otherwise(F.coalesce("same", "unknown"))
    relaxed = F.when(F.col("step_issuer").isNull(), F.col("unknown").isNull()).otherwise(F.col("same").isNull())
    found = rows.select("step", F.struct(relaxed.alias("relaxed"), best.alias("at")).alias("best")).where("best.at is not null")
    return found.groupBy("step").agg(F.min("best")["at"]["specimen"].alias("specimen"))
