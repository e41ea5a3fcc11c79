"""Queries that write files from the tables in the formats of the raw inputs, and read them back with the library's readers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import profile as PR
from ..operators import puzzles as P
from ..operators.store import shared_folder
from ..sources import readers, writers
from .profile_queries import GRADED
from .puzzle_queries import E as ENRICHED
from .registry import query

PZ = ("puzzles",)


def _place(df: DataFrame) -> str:
    return f"{shared_folder(df.sparkSession)}/files-{uuid.uuid4().hex}"


#: Entries (attempts, games, moves) of a file of documents, which its reader holds as one array.
ENTRIES = 20_000


def _documents(rows: DataFrame, key: str, *columns: Column, entries: int) -> str:
    """Writes the rows as documents, an array of them in each of as many files as so many entries need; the folder."""
    place, files = _place(rows), max(16, entries // ENTRIES)
    text = rows.select(F.pmod(F.xxhash64(key), F.lit(files)).alias("bucket"), F.to_json(F.struct(*columns)).alias("doc")).groupBy("bucket").agg(F.concat(F.lit("["), F.array_join(F.collect_list("doc"), ","), F.lit("]")).alias("value"))
    text.write.partitionBy("bucket").text(place)
    return place


@query(f"WITH {ENRICHED} SELECT puzzle_id, rating, primary_category FROM e WHERE rating >= 1200", PZ)
def s1_read_puzzles_csv(v):
    p = v("puzzles")
    place = _place(p)
    names = (("puzzle_id", "PuzzleId"), ("fen", "FEN"), ("moves", "Moves"), ("rating", "Rating"), ("rating_deviation", "RatingDeviation"), ("popularity", "Popularity"), ("nb_plays", "NbPlays"), ("themes", "Themes"))
    p.select(*[F.col(a).alias(b) for a, b in names], F.lit("").alias("GameUrl"), F.lit("").alias("OpeningTags")).write.option("header", True).csv(place)
    return readers.puzzles_csv(p.sparkSession, place, low=1200).select("puzzle_id", "rating", "primary_category")


@query(f"WITH {ENRICHED} SELECT puzzle_id, rating, primary_category FROM e", PZ)
def s2_k1_processed_table(v):
    p = v("puzzles")
    place = _place(p)
    writers.processed(P.enrich(p), place)
    return readers.puzzles_parquet(p.sparkSession, place, ("puzzle_id", "rating", "primary_category"))


def _sessions(v) -> tuple[DataFrame, str]:
    a = v("attempts")
    entry = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), F.col("puzzle_id").alias("puzzleId"), "category", F.col("rating").cast("double").alias("rating"), "solved")
    docs = a.groupBy("player_id").agg(F.collect_list(entry).alias("history")).join(v("players").select("player_id", F.col("rating").cast("double").alias("estimatedElo")), "player_id", "left")
    return a, _documents(docs, "player_id", F.concat(F.lit("u"), F.col("player_id").cast("string")).alias("username"), F.when(F.col("player_id") % 3 > 0, F.col("estimatedElo")).alias("estimatedElo"), F.col("history"), entries=a.count())


@query("SELECT 'u' || player_id AS username, puzzle_id, category, rating::DOUBLE AS rating, solved FROM attempts WHERE rating <> 0 AND solved IS NOT NULL", ("attempts",))
def s5_read_attempts(v):
    a, place = _sessions(v)
    return readers.attempts(a.sparkSession, place).select("username", "puzzle_id", "category", "rating", "solved")


@query("SELECT 'u' || player_id AS username, rating::DOUBLE AS rating, 200.0::DOUBLE AS rd FROM players WHERE player_id % 3 > 0 AND player_id IN (SELECT player_id FROM attempts)", ("attempts", "players"))
def s6_read_player_seeds(v):
    a, place = _sessions(v)
    return readers.player_seeds(a.sparkSession, place)


@query("SELECT 'g' || game_id AS pgn, time_class, (CASE WHEN color = 'white' THEN num_moves ELSE 100 - num_moves END)::DOUBLE AS accuracy FROM games WHERE game_id % 10 <> 0", ("games",))
def s7_read_game_archives(v):
    g = v("games")
    game = F.struct(
        F.when(F.col("game_id") % 10 != 0, F.concat(F.lit("g"), F.col("game_id").cast("string"))).otherwise("").alias("pgn"), F.lit(True).alias("rated"), "time_class",
        F.struct(F.col("num_moves").cast("double").alias("white"), (100 - F.col("num_moves")).cast("double").alias("black")).alias("accuracies"), F.struct(F.when(F.col("color") == "white", "The Hero").otherwise("Another").alias("username")).alias("white"),
    )
    place = _documents(g.groupBy("player_id").agg(F.collect_list(game).alias("games")), "player_id", F.col("games"), entries=g.count())
    return readers.game_archives(g.sparkSession, place, "hero").select("pgn", "time_class", "accuracy")


def _cohort(v) -> tuple[DataFrame, str]:
    p = PR.graded(v("moves"))
    seen = F.struct("category", "hit", F.round("wp_loss", 6).alias("wp_loss"), "phase", F.col("ply_no").alias("ply"))
    error = F.struct("category", "severity", "phase", F.round("wp_loss", 6).alias("wp_loss"))
    by = p.groupBy("game_id").agg(F.collect_list(F.when(F.col("critical"), seen)).alias("opportunities"), F.collect_list(F.when(F.col("severity").isNotNull(), error)).alias("errors"))
    games = v("games").select("game_id", "player_id").join(by, "game_id").groupBy("player_id").agg(F.collect_list(F.struct(F.col("game_id").alias("end_time"), "opportunities", "errors")).alias("games"))
    return p, _documents(games, "player_id", F.col("player_id").cast("string").alias("id"), F.lit(1).alias("band"), F.col("games"), entries=v("moves").count())


@query(f"WITH {GRADED} SELECT player_id::VARCHAR AS id, game_id AS end_time, category, count(*) AS n, count(*) FILTER (WHERE hit) AS hits FROM g WHERE critical GROUP BY 1, 2, 3", ("games", "positions"))
def s8_read_cohort(v):
    p, place = _cohort(v)
    return readers.cohort(p.sparkSession, place).groupBy("id", "end_time", "category").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))


@query(f"WITH {GRADED} SELECT player_id::VARCHAR AS id, game_id AS end_time, severity, phase, count(*) AS n FROM g WHERE severity IS NOT NULL GROUP BY 1, 2, 3, 4", ("games", "positions"))
def s8_read_cohort_errors(v):
    p, place = _cohort(v)
    return readers.cohort_errors(p.sparkSession, place).groupBy("id", "end_time", "severity", "phase").agg(F.count("*").alias("n"))


@query("SELECT attempt_id, puzzle_id FROM attempts WHERE attempt_id % 50 <> 0", ("attempts",))
def s10_read_json_lines(v):
    """Some lines are there twice, as after a restart, and some are cut short."""
    a = v("attempts").select("attempt_id", F.to_json(F.struct("attempt_id", "puzzle_id")).alias("value"))
    place = _place(a)
    lines = a.select(F.when(F.col("attempt_id") % 50 == 0, F.substring("value", 1, 12)).otherwise(F.col("value")).alias("value"))
    lines.unionByName(a.where("attempt_id % 7 = 0 and attempt_id % 50 <> 0").select("value")).write.text(place)
    return readers.json_lines(a.sparkSession, place, "attempt_id long, puzzle_id string", ("attempt_id",)).select("attempt_id", "puzzle_id")


@query("""SELECT category, round(arm_id / 10.0::DOUBLE - 1, 6) AS "offset", 256.0::DOUBLE AS shrink_strength FROM arms WHERE arm_id < 23""", ("arms",))
def s12_read_norms(v):
    arms = v("arms").where("arm_id < 23")
    place = _place(arms)
    offsets = F.map_from_entries(F.collect_list(F.struct("category", F.round(F.col("arm_id") / 10.0 - 1, 6).alias("offset"))))
    arms.agg(offsets.alias("offsets")).withColumn("shrink_strength", F.lit(256.0)).coalesce(1).write.json(place)
    return readers.norms(arms.sparkSession, place)


@query("SELECT category, count(*) AS n, CASE WHEN count(*) % 2 = 0 THEN round(avg(rating), 6)::DOUBLE END AS mean FROM attempts GROUP BY 1", ("attempts",))
def k5_write_report(v):
    """What JSON can't hold comes back as null."""
    by = v("attempts").groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg("rating"), 6).alias("mean"))
    place = _place(by)
    writers.report(by.withColumn("mean", F.when(F.col("n") % 2 == 0, F.col("mean")).otherwise(float("nan"))), place)
    return by.sparkSession.read.schema("category string, n long, mean double").json(place)


@query("SELECT attempt_id, player_id, solved FROM attempts WHERE NOT coalesce(skipped, false)", ("attempts",))
def k7_append_attempt_log(v):
    a = v("attempts").select("attempt_id", "player_id", "solved", "skipped")
    place = _place(a)
    a.write.parquet(f"{place}/in")
    stream = a.sparkSession.readStream.schema(a.schema).parquet(f"{place}/in")
    writers.append_attempts(stream, f"{place}/log", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    return a.sparkSession.read.parquet(f"{place}/log").select("attempt_id", "player_id", "solved")
