"""Writers of tables and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def folder_name(label):
    return F.regexp_replace(label, "[ -]", "_")


def split_by(df: DataFrame, labels: str, path: str, mode: str = "overwrite") -> None:
    """One Parquet folder for each label; a row with several labels (an array) is in several."""
    column = F.explode(labels) if df.schema[labels].dataType.typeName() == "array" else F.col(labels)
    df.withColumn("part", column).withColumn("part", folder_name("part")).write.mode(mode).partitionBy("part").parquet(path)


def processed(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The enriched table as one Parquet dataset."""
    df.write.mode(mode).parquet(path)


def report_with_rows(summary: DataFrame, rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A report as JSON lines: the summary's one row first, under `summary`, and then a line for each item, under `item`."""
    safe = lambda df: F.struct(*[F.when(~F.isnan(c) & ~F.col(c).isin(float("inf"), float("-inf")), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
    report(summary.select(safe(summary).alias("summary")), f"{path}/summary", mode)
    report(rows.select(safe(rows).alias("item")), f"{path}/items", mode)


def report(summary: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows as JSON lines; what JSON can't hold is null."""
    safe = [F.when(~F.isnan(c) & ~F.col(c).isin(float("inf"), float("-inf")), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in summary.dtypes]
    summary.select(*safe).write.mode(mode).json(path)


def append_attempts(attempts: DataFrame, path: str, checkpoint: str):
    """A stream's attempts, without those skipped, appended as Parquet."""
    return attempts.where("not coalesce(skipped, false)").writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def apply_edits(stored: DataFrame, edits: DataFrame) -> DataFrame:
    """Stored puzzles after an edit log (player_id, puzzle_id, seq, action, feedback): the latest edit of each puzzle counts.

    `delete` removes the puzzle, `feedback` sets it (null clears it); deleting `*` removes all that was there before.
    """
    everything = edits.where("action = 'delete' and puzzle_id = '*'").groupBy("player_id").agg(F.max("seq").alias("cleared"))
    last = edits.where("puzzle_id <> '*'").groupBy("player_id", "puzzle_id").agg(F.max_by(F.struct("action", "feedback", "seq"), "seq").alias("e"))
    out = stored.join(last, ["player_id", "puzzle_id"], "left").join(everything, "player_id", "left")
    kept = F.col("cleared").isNull() & (F.col("e.action").isNull() | (F.col("e.action") != "delete"))
    return out.where(kept).withColumn("feedback", F.when(F.col("e.action") == "feedback", F.col("e.feedback")).otherwise(F.col("feedback"))).drop("e", "cleared")


def edit_errors(stored: DataFrame, edits: DataFrame) -> DataFrame:
    """(player_id, puzzle_id, seq, action, error) of the edits that meet no puzzle: it was never stored, or an earlier edit has deleted it or all of the player's."""
    one = edits.where("puzzle_id <> '*'").select("player_id", "puzzle_id", "seq", "action")
    gone = edits.where("action = 'delete' and puzzle_id <> '*'").groupBy("player_id", "puzzle_id").agg(F.min("seq").alias("gone"))
    cleared = edits.where("action = 'delete' and puzzle_id = '*'").groupBy("player_id").agg(F.min("seq").alias("cleared"))
    rows = one.join(stored.select("player_id", "puzzle_id", F.lit(True).alias("known")).distinct(), ["player_id", "puzzle_id"], "left").join(gone, ["player_id", "puzzle_id"], "left").join(cleared, "player_id", "left")
    bad = F.col("known").isNull() | F.coalesce(F.col("seq") > F.col("gone"), F.lit(False)) | F.coalesce(F.col("seq") > F.col("cleared"), F.lit(False))
    return rows.where(bad).select("player_id", "puzzle_id", "seq", "action", F.lit("unknown puzzle").alias("error"))
