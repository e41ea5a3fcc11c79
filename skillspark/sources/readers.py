"""Readers of raw inputs as flat tables; schemas are given, nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..operators import puzzles


def puzzles_csv(spark: SparkSession, path: str, sample: int | None = None, seed: int = 0, **filters) -> DataFrame:
    """Enriched puzzles of CSV files, cleaned by `filters` (as in operators.puzzles.select_puzzles), and of these a sample of n rows by a hash of their ids."""
    raw = spark.read.schema(schemas.PUZZLES_CSV).option("header", True).csv(path)
    names = ("puzzle_id", "fen", "moves", "rating", "rating_deviation", "popularity", "nb_plays", "themes", "game_url", "opening_tags")
    rows = puzzles.enrich(raw.toDF(*names))
    if filters:
        rows = puzzles.select_puzzles(rows, **filters)
    return rows if sample is None else rows.orderBy(F.xxhash64("puzzle_id", F.lit(seed)), "puzzle_id").limit(sample)


def puzzles_parquet(spark: SparkSession, path: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """The enriched table, or those of its columns only, which then are all that is read."""
    rows = spark.read.parquet(path)
    return rows.select(*columns) if columns else rows


def mined_puzzles(spark: SparkSession, path: str) -> DataFrame:
    """One row for each puzzle of the users' files (an array each), and whether its file lies in a folder `retired`; the user is the file's name."""
    docs = spark.read.schema(schemas.MINED).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    file = F.col("_metadata.file_path")
    return docs.select(F.regexp_extract("_metadata.file_name", r"^(.*?)(\.json)?$", 1).alias("username"), file.rlike("/retired/[^/]*$").alias("retired"), "*").where("PuzzleId is not null")


def attempts(spark: SparkSession, path: str) -> DataFrame:
    """One row for each entry of the sessions' histories; a file that isn't JSON gives none.

    The user is the file's name where the document has none. Entries without a valid time, a puzzle, a rating other than 0 or a result are left out.
    """
    docs = spark.read.schema(schemas.SESSION).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    stem = F.regexp_extract("_metadata.file_name", r"^(.*?)(\.json)?$", 1)
    rows = docs.select(F.coalesce("username", stem).alias("username"), F.col("_metadata.file_name").alias("file"), F.posexplode("history").alias("place", "h"))
    rows = rows.select("username", "file", "place", F.try_to_timestamp(F.col("h.ts")).alias("ts"), F.col("h.puzzleId").alias("puzzle_id"), F.col("h.category").alias("category"), F.col("h.rating").alias("rating"), F.col("h.solved").alias("solved"), F.col("h.policy").alias("policy"), F.col("h.propensity").alias("propensity"))
    return rows.where("ts is not null and coalesce(puzzle_id, '') <> '' and coalesce(rating, 0) <> 0 and solved is not null")


def player_seeds(spark: SparkSession, path: str) -> DataFrame:
    """(username, rating, rd) of sessions with an estimate."""
    docs = spark.read.schema(schemas.SESSION).option("multiLine", True).json(path)
    return docs.where(F.col("estimatedElo").isNotNull()).select(F.coalesce("username", F.regexp_extract("_metadata.file_name", r"^(.*?)(\.json)?$", 1)).alias("username"), F.col("estimatedElo").alias("rating"), F.lit(200.0).alias("rd"))


def game_archives(spark: SparkSession, path: str, user: str) -> DataFrame:
    """Games with a PGN; the accuracy is that of White if its name contains the user's, else Black's."""
    games = spark.read.schema(schemas.ARCHIVE).option("multiLine", True).json(path).select(F.explode("games").alias("g")).where("coalesce(g.pgn, '') <> ''")
    white = F.lower("g.white.username").contains(user.lower())
    return games.select("g.pgn", "g.rated", "g.rules", "g.time_class", "g.time_control", "g.end_time", F.when(white, F.col("g.accuracies.white")).otherwise(F.col("g.accuracies.black")).alias("accuracy"))


def cohort(spark: SparkSession, path: str) -> DataFrame:
    """One row for each opportunity of each game of each player."""
    players = spark.read.schema(schemas.COHORT).option("multiLine", True).json(path)
    games = players.select("id", "band", "rating", F.posexplode("games").alias("game", "g"))
    return games.select("id", "band", "rating", "game", F.col("g.end_time").alias("end_time"), F.posexplode("g.opportunities").alias("place", "o")).select("id", "band", "rating", "game", "end_time", "place", "o.*")


def cohort_errors(spark: SparkSession, path: str) -> DataFrame:
    """One row for each error of each game of each player of the same files."""
    players = spark.read.schema(schemas.COHORT).option("multiLine", True).json(path)
    games = players.select("id", "band", "rating", F.posexplode("games").alias("game", "g"))
    return games.select("id", "band", "rating", "game", F.col("g.end_time").alias("end_time"), F.posexplode("g.errors").alias("place", "e")).select("id", "band", "rating", "game", "end_time", "place", "e.*")


def json_lines(spark: SparkSession, path: str, schema: str, keys: tuple[str, ...]) -> DataFrame:
    """Lines that parse; a line that is cut short goes, and of equal keys the first in the file stays."""
    rows = spark.read.text(path).select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("x"), F.monotonically_increasing_id().alias("_place"), F.col("_metadata.file_name").alias("_file"))
    rows = rows.select("x.*", "_file", "_place").where(" and ".join(f"{k} is not null" for k in keys))
    w = Window.partitionBy(*keys).orderBy("_file", "_place")
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", "_file", "_place")


def norms(spark: SparkSession, path: str) -> DataFrame:
    """(category, offset, shrink_strength) of a norms file, the strength null where it has none; no rows where it can't be read."""
    docs = spark.read.schema("offsets map<string, double>, shrink_strength double").option("multiLine", True).json(path)
    return docs.where("offsets is not null").select(F.explode("offsets").alias("category", "offset"), "shrink_strength")
