"""Cleaning, classifying, filtering and summarising a puzzle table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.puzzles import categories_of, difficulty_tier, move_length, primary_category, strings, tokens
from ..taxonomy import GENERAL, TIERS, UNSERVED


def enrich(df: DataFrame, themes: str = "themes", moves: str = "moves", rating: str = "rating") -> DataFrame:
    """Adds theme_list, categories, primary_category, difficulty_tier and move_length; one projection, no shuffle."""
    df = df.withColumn("theme_list", tokens(F.col(themes)))
    return df.withColumns({"categories": categories_of(F.col("theme_list")), "primary_category": primary_category(F.col("theme_list")), "difficulty_tier": difficulty_tier(F.col(rating)), "move_length": move_length(F.col(moves))})


def first_by_key(df: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def clean(df: DataFrame, key: str = "puzzle_id", order: str = "seq") -> DataFrame:
    """Rows with position, moves and rating; the first of each key; then by deviation, plays, popularity and non-blank moves, in that order."""
    df = df.where("fen is not null and moves is not null and rating is not null")
    df = first_by_key(df, key, order)
    return df.where("rating_deviation <= 150 and nb_plays > 0 and popularity >= 0").where(F.trim("moves") != "")


def select_puzzles(df: DataFrame, low: int | None = None, high: int | None = None, popularity: int | None = None, plays: int | None = None, tiers: tuple[str, ...] = (), categories: tuple[str, ...] = ()) -> DataFrame:
    """Enriched rows within all limits that are given; rating limits are included."""
    if low is not None:
        df = df.where(F.col("rating") >= low)
    if high is not None:
        df = df.where(F.col("rating") <= high)
    if popularity is not None:
        df = df.where(F.col("popularity") >= popularity)
    if plays is not None:
        df = df.where(F.col("nb_plays") >= plays)
    if tiers:
        df = df.where(F.col("difficulty_tier").isin(*tiers))
    return df.where(F.arrays_overlap("categories", strings(categories))) if categories else df


def quality_gate(df: DataFrame, popularity: int = 85, plays: int = 250, deviation: int = 90, half_moves: int = 3, low: int = 600, high: int = 2400) -> DataFrame:
    """Puzzles good enough to be served; a missing number counts as 0."""
    df = df.where(F.col("rating").between(low, high) & (F.coalesce("popularity", F.lit(0)) >= popularity) & (F.coalesce("nb_plays", F.lit(0)) >= plays) & (F.coalesce("rating_deviation", F.lit(0)) <= deviation))
    tags = tokens(F.col("themes"))
    df = df.where((F.size(tokens(F.col("moves"))) >= half_moves) & ~F.arrays_overlap(tags, strings(UNSERVED)))
    return df.withColumn("primary_category", primary_category(tags)).where(F.col("primary_category") != GENERAL)


def pool_for_player(df: DataFrame, rating: int, window: int, targets: tuple[str, ...], each: int = 50, order: str = "seq") -> DataFrame:
    """Per target the first `each` puzzles in input order within the window; each puzzle once, the most popular first."""
    wanted = df.sparkSession.createDataFrame([(i, t) for i, t in enumerate(targets)], "target_rank int, target string")
    near = df.where(F.col("rating").between(rating - window, rating + window)).withColumn("target", F.explode("categories"))
    near = near.join(F.broadcast(wanted), "target")
    w = Window.partitionBy("target").orderBy(order)
    near = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= each)
    return first_by_key(near, "puzzle_id", "target_rank", "rank").drop("rank", "target", "target_rank")


def counts_on(df: DataFrame, values: tuple[str, ...], column: str, name: str = "n") -> DataFrame:
    """Rows of each of the given values, also of those without any."""
    dim = df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(values)], f"place int, {column} string")
    n = df.groupBy(column).agg(F.count("*").alias(name))
    return F.broadcast(dim).join(n, column, "left").select("place", column, F.coalesce(name, F.lit(0).cast("long")).alias(name))


def tier_report(df: DataFrame) -> DataFrame:
    """Rows and per cent of each tier in order, with those that are empty."""
    out = counts_on(df, tuple(t for t, _, _ in TIERS), "difficulty_tier")
    return out.withColumn("pct", 100.0 * F.col("n") / F.greatest(F.sum("n").over(Window.partitionBy()), F.lit(1)))


def category_counts(df: DataFrame, column: str = "primary_category") -> DataFrame:
    n = df.groupBy(column).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def describe(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """A row for each numeric column: count, mean, sd, least, 5 %, median, 95 %, greatest; exact."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("s")).select("s.*")
    q = lambda p: F.percentile("x", F.lit(p))
    return long.groupBy("column").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.min("x").alias("min"), q(0.05).alias("p05"), q(0.5).alias("p50"), q(0.95).alias("p95"), F.max("x").alias("max"))


def merge_new(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """stored and those rows of new whose key it lacks."""
    return stored.unionByName(new.join(stored.select(key), key, "left_anti"))
