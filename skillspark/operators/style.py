"""Style of play from game and move facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Weights of the aggression score, and thresholds and names of the five styles.
def aggression(mate_share: Column, sacrifices: Column, resigned_share: Column) -> Column:
    raw = 55 * mate_share + F.least(70 * sacrifices, F.lit(35.0)) + 10 * (1 - resigned_share)
    return F.least(F.lit(100), raw.cast("int"))


def archetype(mate_share: Column, aggression_score: Column, pressure: Column, win_rate: Column, breadth: Column, sacrifices: Column) -> Column:
    return (
        F.when((mate_share >= 0.35) | (aggression_score >= 65), "Tactical Attacker")
        .when(pressure >= 0.15, "Time-Trouble Gambler")
        .when((win_rate >= 0.55) & (breadth >= 3), "Opening Theorist")
        .when((win_rate >= 0.5) & (sacrifices < 0.03), "Positional Grinder")
        .otherwise("Balanced Player")
    )


def style_profile(games: DataFrame, moves: DataFrame) -> DataFrame:
    """A row for each player from games (player_id, game_id, won, termination, eco) and moves (game_id, clock, attacker, captured).

    A move with under 30 seconds is one under pressure; a capture by a piece worth over 400 more than what it takes is a sacrifice. Moves are summed by game
    before they meet the games.
    """
    per_game = moves.groupBy("game_id").agg(F.count("*").alias("moves"), F.count_if(F.col("clock") < 30).alias("low"), F.count_if(F.col("attacker") > F.col("captured") + 400).alias("sacrifices"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    won, lost = F.col("won"), ~F.col("won")
    end = lambda c, t: F.count_if(c & (F.col("termination") == t))
    g = games.join(per_game, "game_id", "left").na.fill(0, ["moves", "low", "sacrifices"]).groupBy("player_id").agg(
        F.count("*").alias("games"), F.count_if(won).alias("wins"), F.count_if(lost).alias("losses"), end(won, "checkmate").alias("mates"), end(lost, "resignation").alias("resigned"),
        F.sum("moves").alias("moves"), F.sum("low").alias("low"), F.sum("sacrifices").alias("sacrifices"), F.countDistinct("eco").alias("breadth"),
    )
    g = g.select("player_id", "games", "breadth", share(F.col("wins"), F.col("games")).alias("win_rate"), share(F.col("mates"), F.col("wins")).alias("mate_share"), share(F.col("resigned"), F.col("losses")).alias("resigned_share"), share(F.col("low"), F.col("moves")).alias("pressure"), share(F.col("sacrifices"), F.col("games")).alias("sacrifice_rate"))
    g = g.withColumn("aggression", aggression(F.col("mate_share"), F.col("sacrifice_rate"), F.col("resigned_share")))
    return g.withColumn("archetype", archetype(F.col("mate_share"), F.col("aggression"), F.col("pressure"), F.col("win_rate"), F.col("breadth"), F.col("sacrifice_rate")))
