"""Connected components of links held in a DataFrame, by alternating stars.

Every round rewires each node's larger neighbours, then its smaller ones, to the smallest node it
knows; the links end as stars around each component's smallest node after O(log) rounds. Before that
each task shrinks its own links to a forest, which takes most of the work out of the rounds. Links and
labels stay on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm import shared

_FOREST_ROWS = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each task's links as (node, smallest node that it can reach here), in bounded batches."""
    root: dict = {}

    def find(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    def out() -> pa.RecordBatch:
        pairs = [(x, find(x)) for x in list(root)]
        pairs = [(x, y) for x, y in pairs if x != y]
        return pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in pairs], kind), "b": pa.array([y for _, y in pairs], kind)})

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
        if len(root) > _FOREST_ROWS:
            yield out()
            root.clear()
    if root:
        yield out()


def _settled(links: DataFrame) -> bool:
    """Whether the links (larger a, smaller b) are stars already: each a once, and no b is an a."""
    ends = links.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(links.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up > 1 or (up = 1 and root = 1)").isEmpty()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of links (a, b) that isn't its component's smallest.

    a and b have one type, not null, any that has an order.
    """
    kind = links.schema["a"].dataType.simpleString()
    own = links.select("a", "b").where("a <> b").mapInArrow(K.lean(_forest), f"a {kind}, b {kind}")
    now = shared.table(own.distinct(), "links")
    for _ in range(most_rounds):
        if _settled(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = shared.table(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = shared.table(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
