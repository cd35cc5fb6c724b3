"""Tables in the shared folder, and memory between the phases of an operator."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.tables import opened, release, shared_folder, table

__all__ = ["opened", "release", "rest", "rows_hint", "shared_folder", "small_batches", "table"]


def rest(spark: SparkSession) -> None:
    """Collects garbage in the driver and in the executors' JVMs, between phases that need memory for other things.

    A heap that has grown to its limit in one phase shrinks only then, and leaves its room to the Python
    workers of the next; in the driver, shuffles whose DataFrames are gone are cleaned up.
    """
    local = (spark.sparkContext.master + "[").startswith("local[")  # the driver is the executor, and collects its own garbage
    n = 1 if local else spark.sparkContext.defaultParallelism
    done = F.lit("") if local else F.expr("java_method('java.lang.System', 'gc')")
    spark.range(0, n, 1, n).select(done.alias("done")).write.format("noop").mode("overwrite").save()
    # the driver comes last: it keeps the shuffles of the query before until another one has run
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Lets Spark hand texts to Python in batches of a few MB, unless the session says otherwise already.

    At the default of 10,000 rows long texts fill the workers.
    """
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "2000"), ("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))):
        if key not in spark.conf.getAll:
            spark.conf.set(key, value)


def rows_hint(df: DataFrame) -> int:
    """Shuffle partitions the session asks for."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
