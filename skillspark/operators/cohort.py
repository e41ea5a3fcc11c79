"""Folds and population statistics over players."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def group_folds(df: DataFrame, group: str, k: int, seed: int) -> DataFrame:
    """A fold for each group, by rank of its md5: first by prefixes of the hash, so that no one task orders all groups."""
    groups = df.select(group).distinct().withColumn("h", F.md5(F.concat(F.col(group).cast("string"), F.lit(f"-{seed}")).cast("binary")))
    groups = groups.withColumn("prefix", F.substring("h", 1, 2))
    sizes = groups.groupBy("prefix").agg(F.count("*").alias("n"))
    before = Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("prefix", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("prefix").orderBy("h", group)) - 1
    return groups.withColumn("rank", rank).join(F.broadcast(sizes), "prefix").select(group, ((F.col("rank") + F.col("before")) % k).cast("int").alias("fold"))
