"""From file headers to instances, levels and pyramids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def identifier() -> Column:
    """Files of one instance share it."""
    return F.coalesce("concat_uid", "uid")


def instances(files: DataFrame) -> DataFrame:
    """Files to instances: an identifier, its files and frames, and whether its files agree."""
    same = (F.count_distinct("total_columns", "total_rows", F.coalesce("organization", F.lit(""))) == 1).alias("consistent")
    return files.groupBy(identifier().alias("identifier")).agg(F.count("*").alias("files"), F.sum("n_frames").alias("frames"), F.max_by("file_id", F.struct(F.col("total_columns"), -F.col("file_id"))).alias("base_file"), same)


def levels(instances: DataFrame) -> DataFrame:
    """Instances of a slide by size, the widest first."""
    sizes = instances.groupBy("slide_id", "width", "height").agg(F.count("*").alias("n_instances"), F.min("spacing_x").alias("spacing_x"))
    return sizes.withColumn("rank", F.row_number().over(Window.partitionBy("slide_id").orderBy(F.desc("width"), F.desc("height"))))


def duplicates(files: DataFrame, key: str) -> DataFrame:
    return files.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")



def best_instance(instances: DataFrame, keys: list[str], order: str = "ordinal") -> DataFrame:
    """The instance with the fewest planes for each key; of equals the first."""
    return instances.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy("n_planes", order))).where("rn = 1").drop("rn")
