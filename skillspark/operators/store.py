"""Tables that cut a lineage: written to the folder that all machines share, and removed once their successor is there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of this machine if the session runs on it alone."""
    place = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        place = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


#: With this set, a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows of a partition of a table of short rows.
ROWS = 50_000


class Store:
    """Parquet tables of one computation, by path, until `discard`. What is shuffled for a table goes once it is written."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.place = spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
        self.count = 0

    def put(self, df: DataFrame) -> tuple[DataFrame, str]:
        """df as it is read back, and its path."""
        self.count += 1
        path = f"{self.place}/{self.count}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path), path

    def few(self, df: DataFrame) -> tuple[DataFrame, str, int]:
        """As put, for a table that may be small, with its rows counted: read in no more partitions than they need, so that a table of one partition is joined and summed without a shuffle."""
        out, path = self.put(df)
        rows = out.count()
        return out.coalesce(rows // ROWS + 1), path, rows

    def discard(self, path: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
