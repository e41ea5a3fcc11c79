"""Summaries of mined puzzles, evaluations, labellers and predictors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.games import clamp_rating, logit
from ..functions.puzzles import difficulty_tier
from . import metrics as M

# Categories that count as tactical in the quality of mined puzzles.
TACTICAL = ("Fork", "Pin", "Skewer", "Discovered Attack", "Mating Pattern", "Sacrifice", "Promotion", "Hanging Piece", "X-Ray Attack", "King Safety")


def mark(score: Column) -> Column:
    return F.when(score >= 0.70, "GOOD").when(score >= 0.50, "FAIR").otherwise("POOR")


def mined_quality(puzzles: DataFrame, keys: tuple[str, ...] = ("player_id",)) -> DataFrame:
    """Shares of engine-made, clear, deep, tactical and longer puzzles of each group, their weighted sum and its mark, from (engine, clarity_cp, eval_drop, n_moves, solver_moves, category). Unknown clarity of all counts one half."""
    share = lambda c: F.count_if(c) / F.count("*")
    clear = F.when(F.count("clarity_cp") > 0, F.count_if(F.col("clarity_cp") >= 150) / F.count("*")).otherwise(0.5)
    out = puzzles.groupBy(*keys).agg(
        F.count("*").alias("n"), share(F.coalesce("engine", F.lit(False))).alias("engine"), clear.alias("clear"), share(F.col("n_moves") >= 3).alias("deep"), share(F.col("category").isin(*TACTICAL)).alias("tactical"),
        share(F.coalesce("solver_moves", F.lit(1)) >= 2).alias("multi"), F.avg("clarity_cp").alias("avg_clarity"), F.avg("eval_drop").alias("avg_drop"), F.avg("n_moves").alias("avg_depth"),
    )
    overall = F.round(0.30 * F.col("engine") + 0.25 * F.col("clear") + 0.20 * F.col("deep") + 0.15 * F.col("tactical") + 0.10 * F.col("multi"), 3)
    return out.withColumns({"overall": overall, "mark": mark(overall)})


def evaluation_summary(evaluated: DataFrame) -> DataFrame:
    """One row of totals over evaluated puzzles (engine_agrees, clarity_cp, solution_moves, dual, trivial, tactical, fits, score) and the mark of the mean score."""
    yes = lambda c: F.count_if(c)
    out = evaluated.agg(
        F.count("*").alias("total"), F.count("engine_agrees").alias("engine_run"), yes("engine_agrees").alias("engine_agrees"), yes(F.col("clarity_cp") >= 150).alias("clarity_ok"), yes(F.col("solution_moves") >= 3).alias("deep"),
        yes(~F.coalesce("dual", F.lit(False))).alias("no_dual"), yes("trivial").alias("trivial"), yes("tactical").alias("tactical"), yes("fits").alias("difficulty_fit"), F.round(F.avg("score"), 3).alias("avg_score"),
        F.round(F.avg("solution_moves"), 1).alias("avg_depth"), F.round(F.avg("clarity_cp")).cast("long").alias("avg_clarity_cp"),
    )
    return out.withColumn("mark", mark(F.col("avg_score")))


def evaluation_by_category(evaluated: DataFrame) -> DataFrame:
    return evaluated.groupBy("category").agg(F.count("*").alias("n"), F.min("rating").alias("low"), F.max("rating").alias("high"), F.avg("score").alias("avg_score")).withColumn("weak", F.col("avg_score") < 0.50)


def recommendations(summary: DataFrame) -> DataFrame:
    """(advice, n) from evaluation_summary: what a threshold calls for; `solid` if nothing does."""
    n = F.col("total")
    rows = F.array_compact(F.array(
        F.when((F.col("engine_run") > 0) & (F.col("engine_agrees") < 0.70 * n), F.struct(F.lit("unconfirmed").alias("advice"), (n - F.col("engine_agrees")).alias("n"))),
        F.when(F.col("trivial") > 0, F.struct(F.lit("trivial").alias("advice"), F.col("trivial").alias("n"))),
        F.when(F.col("deep") < 0.70 * n, F.struct(F.lit("shallow").alias("advice"), (n - F.col("deep")).alias("n"))),
        F.when(n - F.col("no_dual") > 0.10 * n, F.struct(F.lit("ambiguous").alias("advice"), (n - F.col("no_dual")).alias("n"))),
        F.when(F.col("engine_run") == 0, F.struct(F.lit("run the engine").alias("advice"), n.alias("n"))),
    ))
    solid = F.array(F.struct(F.lit("solid").alias("advice"), n.alias("n")))
    return summary.where("total > 0").select(F.explode(F.when(F.size(rows) > 0, rows).otherwise(solid)).alias("x")).select("x.*")


def mined_summary(puzzles: DataFrame, attempts: DataFrame) -> DataFrame:
    """(section, key, value): kept and retired puzzles (player_id, retired, n_moves, category, eval_drop, clarity_cp), the solver's moves and categories of those kept, median mistake and margin, and attempts and solves, mined ones apart."""
    kept = puzzles.where("not retired")
    row = lambda df, section, key, value: df.select(F.lit(section).alias("section"), key.cast("string").alias("key"), value.cast("double").alias("value"))
    totals = puzzles.agg(F.countDistinct("player_id").alias("users"), F.count_if(~F.col("retired")).alias("kept"), F.count_if("retired").alias("retired"))
    medians = kept.agg(F.median("eval_drop").alias("mistake_cp"), F.median("clarity_cp").alias("margin_cp"))
    mined = F.col("puzzle_id").startswith("gen_")
    tried = attempts.agg(F.countDistinct("player_id").alias("players"), F.count("*").alias("total"), F.count_if("solved").alias("solved"), F.count_if(mined).alias("mined_total"), F.count_if(mined & F.col("solved")).alias("mined_solved"))

    def long(df: DataFrame, section: str) -> DataFrame:
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("double").alias("v")) for c in df.columns])).alias("x")
        return df.select(pairs).select(F.lit(section).alias("section"), F.col("x.k").alias("key"), F.col("x.v").alias("value"))

    moves = kept.groupBy(F.floor(F.col("n_moves") / 2).alias("k")).agg(F.count("*").alias("n"))
    cats = kept.groupBy(F.coalesce("category", F.lit("General")).alias("k")).agg(F.count("*").alias("n"))
    return long(totals, "puzzles").unionByName(row(moves, "solver_moves", F.col("k"), F.col("n"))).unionByName(row(cats, "categories", F.col("k"), F.col("n"))).unionByName(long(medians, "median")).unionByName(long(tried, "attempts"))


def category_norms(counts: DataFrame, strengths: DataFrame | None = None, least: int = 50) -> DataFrame:
    """(category, n, offset, overall, strength) of categories (category, hits, n) with `least` positions: the log odds of its rate less those of all; the median of fitted strengths (s) rides along."""
    total = counts.agg((F.sum("hits") / F.sum("n")).alias("overall"))
    rows = counts.groupBy("category").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).where(F.col("n") >= least).crossJoin(F.broadcast(total))
    rows = rows.select("category", "n", (logit(F.col("hits") / F.col("n")) - logit(F.col("overall"))).alias("offset"), "overall")
    if strengths is None:
        return rows.withColumn("strength", F.lit(None).cast("double"))
    return rows.crossJoin(F.broadcast(strengths.agg(F.median("s").alias("strength"))))


def agreement_by(df: DataFrame, condition: str, true: str, pred: str) -> DataFrame:
    """(condition, n, accuracy, kappa) of each experimental condition, from the counts of its labels."""
    cells = df.groupBy(condition, true, pred).agg(F.count("*").alias("n"))
    side = lambda c, name: cells.groupBy(condition, F.col(c).alias("label")).agg(F.sum("n").alias(name))
    chance = side(true, "t").join(side(pred, "p"), [condition, "label"]).groupBy(condition).agg(F.sum(F.col("t").cast("double") * F.col("p")).alias("tp"))
    same = cells.groupBy(condition).agg(F.sum("n").alias("n"), F.sum(F.when(F.col(true) == F.col(pred), F.col("n")).otherwise(0)).alias("same"))
    po, pe = F.col("same") / F.col("n"), F.coalesce("tp", F.lit(0.0)) / (F.col("n").cast("double") * F.col("n"))
    return same.join(chance, condition, "left").select(condition, "n", po.alias("accuracy"), F.try_divide(po - pe, 1 - pe).alias("kappa"))


def player_card(profiles: DataFrame) -> DataFrame:
    """One flat row from nested profile and stats: ratings of four time classes (0 is none), the country's code from the end of its address, and defaults."""
    text = lambda c, default: F.coalesce(F.col(f"profile.{c}"), default).alias(c)
    rating = lambda k: F.nullif(F.col(f"stats.chess_{k}.last.rating"), F.lit(0)).alias(k)
    country = F.coalesce(F.element_at(F.split("profile.country", "/"), -1), F.lit("")).alias("country")
    return profiles.select(
        text("username", F.col("requested")), text("name", F.lit("")), text("title", F.lit("")), text("avatar", F.lit("")), country, text("followers", F.lit(0)), text("joined", F.lit(0)),
        *map(rating, ("rapid", "blitz", "bullet", "daily")),
    )


def rerate(puzzles: DataFrame, predictions: DataFrame, serve: bool = False, least_rd: float = 75.0) -> DataFrame:
    """Mined puzzles (puzzle_id, source, fen, moves, rating, rating_deviation, difficulty_tier, model_rating, model_rd) with the model's rating (puzzle_id, mean, sd) where they lack one.

    With serve it becomes the served rating and tier, and the old one is kept as heuristic_rating. Others don't change.
    """
    lacks = (F.col("source") == "generated") & F.col("model_rating").isNull() & (F.coalesce("fen", F.lit("")) != "") & (F.coalesce("moves", F.lit("")) != "")
    rows = puzzles.join(predictions.select("puzzle_id", "mean", "sd"), "puzzle_id", "left").withColumn("_new", lacks & F.col("mean").isNotNull())
    rated, rd = clamp_rating(F.col("mean")), F.bround(F.greatest(F.lit(least_rd), F.col("sd"))).cast("int")
    rows = rows.withColumns({"model_rating": F.when(F.col("_new"), rated).otherwise(F.col("model_rating")), "model_rd": F.when(F.col("_new"), rd).otherwise(F.col("model_rd")), "heuristic_rating": F.when(F.col("_new") & F.lit(serve), F.col("rating"))})
    if serve:
        rows = rows.withColumns({"rating": F.when(F.col("_new"), F.col("model_rating")).otherwise(F.col("rating")), "rating_deviation": F.when(F.col("_new"), F.col("model_rd")).otherwise(F.col("rating_deviation"))})
        rows = rows.withColumn("difficulty_tier", F.when(F.col("_new"), difficulty_tier(F.col("rating"))).otherwise(F.col("difficulty_tier")))
    return rows.drop("mean", "sd").withColumnRenamed("_new", "changed")


def prequential(models: dict[str, DataFrame], outcomes: DataFrame) -> DataFrame:
    """(attempt_id, model, y, p): predictions (attempt_id, p) made before the outcome (attempt_id, y), of all models one below the other."""
    rows = None
    for name, df in models.items():
        part = df.select("attempt_id", F.lit(name).alias("model"), "p")
        rows = part if rows is None else rows.unionByName(part)
    return rows.join(outcomes.select("attempt_id", "y"), "attempt_id")


def prequential_scores(table: DataFrame) -> DataFrame:
    """(model, n, log_loss, brier, auc) of a prequential table."""
    return M.proper_scores(table, ("model",)).drop("mean_p").join(M.roc_auc(table, ("model",)), "model")
