"""Bounded samples of labelled documents, to fit models on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GRAIN = 1_000_000


def remainder(id_col: str, mod: int) -> Column:
    """crc32 of the identifier as text, modulo mod; null identifiers have none."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % mod


def thinned(rows: DataFrame, label: str, key: Column, most: int, seed: int = 5) -> DataFrame:
    """About `most` rows of each label (all, where there are fewer), chosen by a hash of the key."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    share = F.broadcast(counts.select(F.col(label).alias("_label"), F.least(F.lit(_GRAIN), F.floor(F.lit(float(most) * _GRAIN) / F.col("n"))).alias("_share")))  # a row for each label
    return rows.join(share, F.col(label) == F.col("_label")).where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(_GRAIN)) < F.col("_share")).drop("_label", "_share")


def sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, allowed: Column, most: int) -> DataFrame:
    """(body, label) of about `most` labelled documents for each label, of the allowed ids.

    Equal texts count once, with the label that half of them or more have, of ties the larger.
    """
    rows = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("long").alias("label")).where(allowed)
    chosen = thinned(rows, "label", F.col("doc_id"), most).groupBy("doc_id").agg(F.max("label").alias("label"))  # bounded by the parameter
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("body").agg((F.avg("label") >= 0.5).cast("long").alias("label"))
