"""Puzzles from evaluated games: gates on the first move, forced continuations, and caps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.puzzles import mined_puzzle_id, mined_rating, mined_tier

DROP, MARGIN, FORCED, LEVEL = 150, 100, 80, 800
PLIES, PER_GAME = 6, 5


def candidate_gates(positions: DataFrame) -> DataFrame:
    """Positions where the best move wasn't played, the game was open, the best move was alone, and what was played lost enough.

    A missing second line means that there was one legal move.
    """
    clear = F.col("second_cp").isNull() | (F.col("best_cp") - F.col("second_cp") >= MARGIN)
    drop = F.col("best_cp") - F.col("after_cp")
    return positions.where((F.abs(F.col("best_cp")) <= LEVEL) & clear & (drop >= DROP)).withColumn("eval_drop", drop)


def forced_prefix(lines: DataFrame, key: str = "line_id", ply: str = "ply", most: int = PLIES) -> DataFrame:
    """(key, n_plies): how far each line is forced.

    lines has a row for each ply after the first move: even plies are the opponent's and hold if the gap of two scored lines is at least FORCED (or there is one
    line); odd plies are the player's and hold if the gap is at least MARGIN. A line ends at the first ply that doesn't hold; a failing ply of the player also takes the
    opponent's reply before it, so that a line never ends on a reply that was found only on the way.
    """
    player = F.col(ply) % 2 == 1
    holds = F.when(player, F.coalesce(F.col("gap") >= MARGIN, F.lit(True))).otherwise(F.coalesce(F.col("gap") >= FORCED, F.lit(True)))
    w = Window.partitionBy(key).orderBy(ply).rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.where(F.col(ply) < most).withColumn("whole", F.min(holds.cast("int")).over(w) == 1)
    out = rows.groupBy(key).agg(F.count_if("whole").alias("n"), F.min(F.when(~F.col("whole"), F.col(ply))).alias("broken"))
    back = F.when((F.col("broken") % 2 == 1) & (F.col("n") > 0), 1).otherwise(0)
    return out.select(key, (F.col("n") - back).alias("n_plies"))


def cut_ambiguous(moves: DataFrame, key: str = "puzzle_id", move: str = "move_no") -> DataFrame:
    """(key, n_moves, kept, status) on a second look at the player's moves (first_choice, gap): the prefix that still stands; `retired` if the first move falls."""
    good = F.col("first_choice") & F.coalesce(F.col("gap") >= MARGIN, F.lit(True))
    w = Window.partitionBy(key).orderBy(move).rowsBetween(Window.unboundedPreceding, 0)
    rows = moves.withColumn("whole", F.min(good.cast("int")).over(w))
    out = rows.groupBy(key).agg(F.count("*").alias("n_moves"), F.sum("whole").alias("kept"))
    return out.withColumn("status", F.when(F.col("kept") == 0, "retired").when(F.col("kept") < F.col("n_moves"), "cut").otherwise("unchanged"))


def caps(puzzles: DataFrame, total: int, per_game: int = PER_GAME, targets: tuple[str, ...] = ()) -> DataFrame:
    """At most per_game puzzles of a game, the first of each position, then `total` in all, those of target categories first."""
    w = Window.partitionBy("game_id").orderBy("seq")
    rows = puzzles.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= per_game).drop("_place")
    first = rows.groupBy("fen").agg(F.min("seq").alias("seq")).drop("fen")
    rows = rows.join(first, "seq", "left_semi")
    wanted = F.col("category").isin(*targets) if targets else F.lit(True)
    return rows.orderBy(~wanted, "seq").limit(total)


def quality_score(df: DataFrame, clarity: int = 150, depth: int = 3, fit: int = 300) -> DataFrame:
    """score, issues and passed of puzzles with engine_agrees, clarity_cp, solution_moves, trivial and rating_gap.

    A puzzle with under two moves in all (column n_moves, if there is one), or whose first move can't be played (first_legal), has score 0 and that issue alone.
    """
    c = F.col("clarity_cp")
    parts = {
        "engine disagrees": (F.col("engine_agrees"), 0.30), "too shallow": (F.col("solution_moves") >= depth, 0.20), "trivial": (~F.col("trivial"), 0.15), "off difficulty": (F.abs(F.col("rating_gap")) <= fit, 0.10),
    }
    score = F.when(c >= clarity, 0.25).when(c >= 80, 0.12).otherwise(0.0)
    for good, weight in parts.values():
        score = score + F.when(good, weight).otherwise(0.0)
    issues = F.array_compact(F.array(F.when(c < clarity, "unclear"), *[F.when(~good, name) for name, (good, _) in parts.items()]))
    guards = [(n, ~good) for n, c, good in (("fewer than 2 moves", "n_moves", F.coalesce(F.col("n_moves"), F.lit(0)) >= 2), ("illegal first move", "first_legal", F.coalesce(F.col("first_legal"), F.lit(False)))) if c in df.columns]
    for name, bad in guards[::-1]:
        score, issues = F.when(bad, 0.0).otherwise(score), F.when(bad, F.array(F.lit(name))).otherwise(issues)
    return df.withColumns({"score": score, "issues": issues, "passed": F.round(score, 9) >= 0.60})


def resolve_label(motifs: DataFrame, allowed: dict[int, tuple[str, ...]] | None = None, most: int = 4) -> DataFrame:
    """(line_id, label) from rows (line_id, move_no, motif, motif_rank, is_mate, is_key, endgame): mate overrides all, Quiet Move counts on the key move only, else the best rank, else the endgame's label, else General."""
    rows = motifs.where(F.col("move_no") < most).where((F.col("motif") != "Quiet Move") | F.col("is_key"))
    if allowed:
        keep = F.lit(True)
        for n, names in allowed.items():
            keep = F.when(F.col("move_no") == n, F.col("motif").isin(*names)).otherwise(keep)
        rows = rows.where(keep)
    best = rows.groupBy("line_id").agg(F.min(F.struct("motif_rank", "motif")).alias("best"))
    whole = motifs.groupBy("line_id").agg(F.max("is_mate").alias("mate"), F.max("endgame").alias("endgame"))
    out = whole.join(best, "line_id", "left")
    return out.select("line_id", F.when(F.col("mate"), "Mating Pattern").otherwise(F.coalesce("best.motif", "endgame", F.lit("General"))).alias("label"))


def mine(positions: DataFrame, lines: DataFrame, again: DataFrame, total: int, per_game: int = PER_GAME, targets: tuple[str, ...] = ()) -> DataFrame:
    """Puzzles from evaluated positions (line_id, seq, game_id, fen, ply_no, category, evaluations): gates, forced continuation, a second look at the first move, rating and tier, caps, target categories first.

    positions may have the moves of their line (moves), which give a puzzle its id. lines: (line_id, ply, gap) of the plies after the first move; again: (line_id, first_choice, gap) of the first move on the second look.
    """
    found = candidate_gates(positions)
    forced = forced_prefix(lines).withColumnRenamed("n_plies", "more")
    stands = again.where(F.col("first_choice") & F.coalesce(F.col("gap") >= MARGIN, F.lit(True))).select("line_id")
    rows = found.join(forced, "line_id", "left").join(stands, "line_id", "left_semi").withColumn("n_plies", 1 + F.coalesce("more", F.lit(0)))
    # The line ends with the player's move: a last reply of the opponent goes.
    rows = rows.withColumn("n_plies", F.col("n_plies") - F.when(F.col("n_plies") % 2 == 0, 1).otherwise(0))
    rating = mined_rating(F.col("eval_drop"), F.col("n_plies") + 1)
    known = [mined_puzzle_id(F.col("fen"), F.col("moves")).alias("puzzle_id")] if "moves" in rows.columns else []
    rows = rows.select(*known, "seq", "game_id", "fen", "category", "eval_drop", F.col("n_plies").cast("int").alias("n_plies"), rating.alias("rating"), mined_tier(rating).alias("tier"))
    return caps(rows, total, per_game, targets)
