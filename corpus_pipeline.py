"""From raw documents to a mixed training corpus, in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir), works on everything its
predecessor kept, and returns the columns of docs. Results are written as Parquet between stages.

Quality selection, decontamination and mixing decide where a row is, without moving texts. Exact and
near deduplication decide by a key of the row and drop what is rejected by an anti-join; the rejected
keys are stored first, so that their measured size decides whether they are broadcast. The key is the
identifier where identifiers are unique, else a number that follows the identifiers' order.

Defined results, for every stage: input columns travel in a struct, so they may have any names and
come back as they were; an empty table gives no rows. A text that is null, empty or has no word goes
in the quality stage if labels teach it, and is a text like others for exact dedup (null counts as
empty, one stays); it is linked with nothing in near-dedup, has no hit in decontamination, and is never
taken by the mix. Null or repeated identifiers are judged row by row: of equal or near texts exactly one
row stays, whatever their identifiers, and rows of other texts are untouched. Of ties the smallest
identifier stays, null last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import shared
from tessera.llm.decontaminate import contamination
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.minhash import near_dedup
from tessera.llm.mixing import mix
from tessera.llm.quality import select_quality

#: Words in a row of a test item that make a document a leak, however long it is.
WINDOW = 13
_LEFT: list[str] = []


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return select_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _kept(docs: DataFrame, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of docs that judge, a function of (key, body) rows to (doc_id, kept), doesn't reject."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("key"), F.col("text").alias("body"))
    if not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        ordered = rows.orderBy(F.col("key").asc_nulls_last(), F.xxhash64("body"))
        rows = shared.table(ordered.select("row", F.monotonically_increasing_id().alias("key"), "body"), "numbered")
    gone = shared.table(judge(rows.select("key", "body")).where("not kept").select(F.col("doc_id").alias("gone")), "gone")
    return rows.join(gone, F.col("key") == F.col("gone"), "left_anti").select("row.*")


def _exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _kept(docs, lambda rows: exact_dedup(rows, "key", "body"))


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _kept(docs, lambda rows: near_dedup(rows, "key", "body", shingle=5, percent=80))


def _clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold a whole window of a test item, or of which a twentieth is of test items shorter than that."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=WINDOW, carry=True)
    steps = F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2))
    whole = F.when(F.size("spans") > 0, F.exists(steps, lambda i: F.get("spans", i + 1) - F.get("spans", i) >= WINDOW)).otherwise(False)
    return found.where(~whole & ~((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))).select("row.*")


def _mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def _stage(function: Callable) -> Callable:
    """The stage; the tables that the stage before it worked with go first, as its result is stored by then."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        shared.release(spark, _LEFT)
        shared.rest(spark)
        shared.small_batches(spark)
        before = set(shared.opened())
        out = function(spark, docs, sf_dir)
        _LEFT[:] = [p for p in shared.opened() if p not in before]
        return out

    return run


STAGES = [
    ("quality classifier", _stage(_quality)),
    ("exact dedup", _stage(_exact)),
    ("MinHash near-dedup", _stage(_near)),
    ("benchmark decontamination", _stage(_clean)),
    ("mixing sources to target weights", _stage(_mixed)),
]

#: The quality model, sketches and cuts have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the mixed corpus."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stored = None
    for name, function in STAGES:
        out = function(spark, docs, sf_dir)
        docs = shared.table(out, "stage")
        if stored:
            shared.release(spark, [stored])
        stored = shared.opened()[-1]
    shared.release(spark, _LEFT)
    return docs
