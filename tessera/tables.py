"""Tables in the folder that the driver and all executors share.

An operator that reads an intermediate result more than once writes it here as Parquet and reads it
back. That cuts the lineage (a lost executor costs a re-read, not a recomputation) and fixes the
contents, so two reads can't disagree.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OPEN: list[str] = []
_ROW_GROUP = 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a local folder only where that is unset (tests, local mode)."""
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if set_to:
        return set_to
    own = spark.sparkContext.getCheckpointDir()
    if not own:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(own)
    return own


def table(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df written to the shared folder, in parts by the columns `by`, and read back."""
    path = f"{shared_folder(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("parquet.block.size", _ROW_GROUP)  # a task holds a row group of each file that it writes
    (writer.partitionBy(*by) if by else writer).parquet(path)
    _OPEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def together(df: DataFrame, keys: list[str], *order: str | Column, parts: int | None = None) -> DataFrame:
    """Rows of equal keys in one partition, one after the other, in order. parts: number of partitions, which Spark then leaves as it is.

    A repartition by the columns that a join or an aggregate has dealt by already is left out by Spark, which may then split
    that one (skewed joins) or read it where it was written (broadcast joins). By a hash of them it stays.
    """
    by = F.xxhash64(*keys)
    return (df.repartition(max(1, parts), by) if parts is not None else df.repartition(by)).sortWithinPartitions(*keys, *order)


def spread(df: DataFrame, keys: list[str], rows: int = 5000) -> DataFrame:
    """df over one partition for so many rows: for rows of few bytes, which files hold in one or two splits, that become many."""
    return df.repartition(max(1, -(-df.count() // rows)), *keys)


def opened() -> list[str]:
    """Paths of the tables that are still there, in order."""
    return list(_OPEN)


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Deletes tables (all, if none are named); call it once the results that read them are stored."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in list(_OPEN) if paths is None else paths:
        if name in _OPEN:
            _OPEN.remove(name)
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)
