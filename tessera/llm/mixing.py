"""Mixing sources to target weights by capped water-filling.

Sources share the total size by weight. A source that would have to repeat more than `max_epochs`
times is clamped there and its excess goes to the others by weight, until none is above its cap. In
order of cap over weight the clamped sources come first, so running sums give the result without
iterating. Sources are taken to be few: the weights go over one row a source, in one task.

A source then takes each document floor(target / size) times whole, and the fraction that is left by
one more copy of some documents: those first in a seeded order of hashes, up to the words still
wanted; what a too large document leaves open is filled by later, smaller ones, in `rounds` rounds.
Each round is a cut: a hash up to which, and a size up to which, documents get the extra copy. To find
it the hashes are summed in 4096 ranges a source and only the range that holds the cut is sorted, so a
source with most of the rows doesn't come together in one task.

DataFrame operations only. Decisions depend on (seed, doc_id, text), so reruns agree.

Defined results: a null or empty text has size 0 and is never taken; null is a source of its own, the
last; a source of size 0 has target 0; rows that repeat identifier and text are taken alike; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import shared

WORD = "[^\\x20\\x09-\\x0D]+"
_RANGE = 3  # hex digits of the hash: 4096 ranges
_LAST = "g"  # after every hex digit


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, row: bool = False) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.md5(text)))
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if row else []
    return docs.select(*whole, F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), key.alias("key"))


def targets(sizes: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """(source, source_size, target, whole, budget) of (source, source_size).

    budget: words of extra copies beyond `whole` copies of everything.
    """
    big = "decimal(38,0)"
    order = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), (nth % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    rows = (
        rows.withColumn("total", F.sum("source_size").over(every))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("among", F.sum("weight").over(onward))
        .withColumn("clamped", F.col("cap").cast(big) * F.col("among").cast(big) < F.col("weight").cast(big) * F.col("left").cast(big))
    )
    free = rows.withColumn("rest", F.col("total") - F.sum(F.when(F.col("clamped"), F.col("cap")).otherwise(0)).over(every)).withColumn("among", F.sum(F.when(F.col("clamped"), 0).otherwise(F.col("weight"))).over(every))
    target = F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise((F.col("weight") * F.col("rest")).cast("double") / F.col("among").cast("double"))
    out = free.withColumn("target", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(target))
    whole = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs)))
    out = out.withColumn("whole", whole.cast("long"))
    return out.select("source", "source_size", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"))


def _extra(cuts: Column) -> Column:
    """Whether one of the cuts [(key, size)] takes a document."""
    return F.exists(cuts, lambda c: (F.col("key") <= c["key"]) & (F.col("size") <= c["most"]))


def _round(base: DataFrame, plan: DataFrame) -> DataFrame:
    """plan with one more cut a source and the budget that is left."""
    # decided: everything up to the last cut that is no larger than the budget has been taken already
    open_rows = (
        base.join(plan.select(F.col("source").alias("s"), "budget", "last"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        .where((F.col("size") > 0) & (F.col("size") <= F.col("budget")) & (F.col("key") > F.col("last")))
        .withColumn("part", F.substring("key", 1, _RANGE))
    )
    parts = open_rows.groupBy("source", "part", "budget").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("part"))
    parts = parts.withColumn("upto", upto)
    over = parts.where("upto > budget").groupBy("source").agg(F.min(F.struct("part", (F.col("upto") - F.col("words")).alias("before"))).alias("edge")).select("source", "edge.*")
    every = parts.groupBy("source").agg(F.sum("words").alias("all_words"))
    edge = open_rows.alias("o").join(over.alias("e"), F.col("o.source").eqNullSafe(F.col("e.source")) & (F.col("o.part") == F.col("e.part"))).select("o.source", "o.key", "o.size", "o.budget", "e.before")
    run = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    fits = edge.withColumn("run", run).where("run <= budget").groupBy("source").agg(F.max("key").alias("fit_key"), F.max("run").alias("fit_words"))
    same = lambda name: F.col("p.source").eqNullSafe(F.col(f"{name}.source"))
    joined = plan.alias("p").join(every.alias("a"), same("a"), "left").join(over.alias("e"), same("e"), "left").join(fits.alias("f"), same("f"), "left")
    taken = F.when(F.col("a.all_words").isNull(), 0).when(F.col("e.part").isNull(), F.col("a.all_words")).otherwise(F.coalesce("f.fit_words", "e.before"))
    key = F.when(F.col("a.all_words").isNull() | F.col("e.part").isNull(), F.lit(_LAST)).otherwise(F.coalesce("f.fit_key", "e.part"))
    cut = F.struct(key.alias("key"), F.floor(F.col("p.budget")).cast("long").alias("most"))
    return joined.select("p.source", "p.source_size", "p.target", "p.whole", (F.col("p.budget") - taken).alias("budget"), key.alias("last"), F.array_append("p.cuts", cut).alias("cuts"))


def _planned(base: DataFrame, weights: Sequence[int], max_epochs: int, rounds: int) -> DataFrame:
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, weights, max_epochs).withColumn("last", F.lit("")).withColumn("cuts", F.array().cast("array<struct<key:string,most:bigint>>"))
    plan = shared.table(plan, "targets")
    for _ in range(rounds):
        plan = shared.table(_round(base, plan), "cuts")
    return plan


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    sized = rows.join(plan.select(F.col("source").alias("s"), "source_size", "target", "whole", "cuts"), F.col("source").eqNullSafe(F.col("s")))
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("whole") + _extra(F.col("cuts")).cast("long"))
    return sized.withColumn("copies", copies.cast("long"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, seed: int = 17, rounds: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, copies, taken (size times copies).

    weights: of the sources in code point order, null last, repeating. max_epochs: most copies of a
    document, and of a source in all.
    """
    base = shared.table(_measured(docs, id_col, text_col, source_col, seed), "sizes")
    out = _with_plan(base, _planned(base, weights, max_epochs, rounds))
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, seed: int = 17, rounds: int = 3) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; see `mix_plan`. The texts aren't shuffled."""
    base = shared.table(_measured(docs, id_col, text_col, source_col, seed), "sizes")
    rows = _with_plan(_measured(docs, id_col, text_col, source_col, seed, row=True), _planned(base, weights, max_epochs, rounds))
    return rows.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("row.*")
