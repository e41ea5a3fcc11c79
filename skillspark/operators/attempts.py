"""Attempt logs: joins with their context, streaks, histories, and Beta posteriors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..taxonomy import ARMS

ORDER = ("ts", "attempt_id")


def valid(attempts: DataFrame) -> DataFrame:
    """Attempts that count: a result, a rating other than 0, and not skipped."""
    return attempts.where("solved is not null and coalesce(rating, 0) <> 0 and not coalesce(skipped, false)")


def with_context(attempts: DataFrame, players: DataFrame, default: float = 1500.0) -> DataFrame:
    """Attempts with the player's rating, or the default."""
    known = players.select("player_id", F.col("rating").cast("double").alias("player_rating"))
    return attempts.join(known, "player_id", "left").withColumn("player_rating", F.coalesce("player_rating", F.lit(default)))


def streaks(attempts: DataFrame) -> DataFrame:
    """Current and best run of solves of each player, over known categories."""
    known = attempts.where(F.col("category").isin(*ARMS))
    w = Window.partitionBy("player_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    known = known.withColumn("island", F.sum(F.when(F.col("solved"), 0).otherwise(1)).over(w))
    runs = known.groupBy("player_id", "island").agg(F.count_if("solved").alias("run"))
    return runs.groupBy("player_id").agg(F.max_by("run", "island").alias("current"), F.max("run").alias("best"))


def running_base_rate(attempts: DataFrame, bucket: str = "day") -> DataFrame:
    """(1 + earlier solves) / (2 + earlier attempts) over all players in time order.

    Sums of each time bucket come first; only those, a row a bucket, pass through one ordered window, and the rows of a bucket
    are ordered among themselves.
    """
    df = attempts.withColumn("bucket", F.date_trunc(bucket, "ts"))
    sums = df.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("solved").alias("k"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("k0"))
    inside = Window.partitionBy("bucket").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({"n1": F.count("*").over(inside), "k1": F.coalesce(F.sum(F.col("solved").cast("int")).over(inside), F.lit(0))})
    df = df.join(sums, "bucket")
    return df.withColumn("base_rate", (1 + F.col("k0") + F.col("k1")) / (2 + F.col("n0") + F.col("n1"))).drop("bucket", "n0", "k0", "n1", "k1")


def beta_posterior(attempts: DataFrame, arms: DataFrame, gamma: float = 1.0, prior: float = 1.0) -> DataFrame:
    """alpha, beta and mean of each player and arm.

    With gamma below 1 every attempt of a player on a known category decays all arms towards the prior; an attempt that is
    followed by r others then weighs gamma^r.
    """
    known = attempts.where(F.col("category").isin(*ARMS))
    if gamma < 1:
        last = Window.partitionBy("player_id").orderBy(*[F.desc(c) for c in ORDER])
        known = known.withColumn("weight", F.pow(F.lit(gamma), F.row_number().over(last) - 1))
    else:
        known = known.withColumn("weight", F.lit(1.0))
    sums = known.groupBy("player_id", "category").agg(F.sum(F.when(F.col("solved"), F.col("weight")).otherwise(0.0)).alias("a"), F.sum(F.when(F.col("solved"), 0.0).otherwise(F.col("weight"))).alias("b"), F.count("*").alias("n"))
    grid = known.select("player_id").distinct().crossJoin(F.broadcast(arms.where(F.col("category").isin(*ARMS))))
    out = grid.join(sums, ["player_id", "category"], "left").withColumns({"alpha": prior + F.coalesce("a", F.lit(0.0)), "beta": prior + F.coalesce("b", F.lit(0.0)), "n": F.coalesce("n", F.lit(0).cast("long"))})
    return out.withColumn("rate", F.col("alpha") / (F.col("alpha") + F.col("beta"))).drop("a", "b")


def seen_history(attempts: DataFrame, cap: int = 5000) -> DataFrame:
    """Puzzles of each player in the order of their first attempt; the last `cap` of them."""
    first = attempts.groupBy("player_id", "puzzle_id").agg(F.min(F.struct(*ORDER)).alias("first"))
    w = Window.partitionBy("player_id").orderBy(F.desc("first"), "puzzle_id")
    return first.withColumn("place", F.row_number().over(w)).where(F.col("place") <= cap).select("player_id", "puzzle_id", "place")


def unseen(candidates: DataFrame, attempts: DataFrame) -> DataFrame:
    """Candidates (player_id, puzzle_id) that the player hasn't attempted."""
    return candidates.join(attempts.select("player_id", "puzzle_id").distinct(), ["player_id", "puzzle_id"], "left_anti")


def latest(attempts: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("player_id").orderBy(*[F.desc(c) for c in ORDER])
    return attempts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def attempt_stats(attempts: DataFrame, least: int = 3, recent: int = 20) -> DataFrame:
    """A row for each player: attempts, accuracy, accuracy of the last few, and how many categories have enough attempts."""
    total = attempts.groupBy("player_id").agg(F.count("*").alias("n"), (100.0 * F.count_if("solved") / F.count("*")).alias("accuracy"))
    last = latest(attempts, recent).groupBy("player_id").agg((100.0 * F.count_if("solved") / F.count("*")).alias("recent"))
    by = attempts.groupBy("player_id", "category").agg(F.count("*").alias("k")).where(F.col("k") >= least).groupBy("player_id").agg(F.count("*").alias("categories"))
    return total.join(last, "player_id").join(by, "player_id", "left").na.fill({"categories": 0})


def served_to_result(served: DataFrame, results: DataFrame) -> DataFrame:
    """Each result with the latest serving of its puzzle to the player at or before it; null where there is none. A serving is used by its first result only."""
    both = served.select("player_id", "puzzle_id", "ts", F.lit(0).alias("is_result"), F.col("serve_id"), F.lit(None).cast("long").alias("attempt_id")).unionByName(
        results.select("player_id", "puzzle_id", "ts", F.lit(1).alias("is_result"), F.lit(None).cast("long").alias("serve_id"), "attempt_id")
    )
    w = Window.partitionBy("player_id", "puzzle_id").orderBy("ts", "is_result", F.coalesce("serve_id", "attempt_id"))
    before = F.lag("is_result").over(w), F.lag("serve_id").over(w)
    return both.withColumns({"was_result": before[0], "served_by": before[1]}).where("is_result = 1").select("player_id", "puzzle_id", "attempt_id", F.when(F.col("was_result") == 0, F.col("served_by")).alias("serve_id"))
