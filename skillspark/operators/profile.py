"""Player profiles from games and graded positions, for all players at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.games import accuracy_estimate, grade, logit, sigmoid, time_weight
from ..taxonomy import ARMS

HALF_LIFE, SHRINK, LEAST, BUDGET = 25, 4.0, 10, 10.0
MIDDLEGAME = ARMS[:15]
ENDGAMES = tuple(a for a in ARMS if "Endgame" in a)


def recency_weights(games: DataFrame, half_life: int = HALF_LIFE) -> DataFrame:
    """Adds rank (0: newest; unknown times last, ties by game_id) and weight of each game of a player."""
    w = Window.partitionBy("player_id").orderBy(F.col("end_time").desc_nulls_last(), "game_id")
    games = games.withColumn("rank", F.row_number().over(w) - 1)
    return games.withColumn("weight", F.pow(F.lit(0.5), F.col("rank") / half_life) * time_weight(F.col("time_class")))


def graded(positions: DataFrame, skip: int = 0) -> DataFrame:
    """Positions with their grades; only those that are critical or have a severity."""
    out = positions.where(F.col("ply_no") > skip).withColumns(grade(F.col("best_cp"), F.col("after_cp"), F.col("second_cp"), F.col("recapture")))
    return out.where("critical or severity is not null")


def opportunity_stats(games: DataFrame, positions: DataFrame, norms: DataFrame | None = None, shrink: float = SHRINK) -> DataFrame:
    """A row for each player and category of critical positions: weighted hits and n, raw n, the player's overall rate, expected and shrunk rate.

    Games are ranked before positions are joined. norms (category, offset) shifts the expected rate; the baseline leaves out categories that aren't arms.
    """
    weights = recency_weights(games).select("game_id", "player_id", "weight")
    hits = positions.where("critical").select("game_id", "category", F.col("hit").cast("double").alias("hit"))
    # One row a game and category before the join: what is shuffled doesn't grow with positions per game.
    hits = hits.groupBy("game_id", "category").agg(F.sum("hit").alias("hits"), F.count("*").alias("raw_n"))
    stats = hits.join(weights, "game_id").groupBy("player_id", "category").agg(F.sum(F.col("weight") * F.col("hits")).alias("hits"), F.sum(F.col("weight") * F.col("raw_n")).alias("n"), F.sum("raw_n").alias("raw_n"))
    mine = Window.partitionBy("player_id")
    arm = F.col("category").isin(*ARMS)
    stats = stats.withColumns({"overall": F.try_divide(F.sum("hits").over(mine), F.sum("n").over(mine)), "arm_rate": F.try_divide(F.sum(F.when(arm, F.col("hits"))).over(mine), F.sum(F.when(arm, F.col("n"))).over(mine))})
    baseline = F.coalesce("arm_rate", "overall")
    if norms is None:
        stats = stats.withColumn("expected", baseline)
    else:
        stats = stats.join(F.broadcast(norms.select("category", "offset")), "category", "left")
        stats = stats.withColumn("expected", F.when(F.col("offset").isNotNull() & (baseline > 0) & (baseline < 1), sigmoid(logit(baseline) + F.col("offset"))).otherwise(baseline)).drop("offset")
    return stats.withColumns({"rate": (F.col("hits") + shrink * F.col("expected")) / (F.col("n") + shrink), "personal": F.col("n") / (F.col("n") + shrink)}).drop("arm_rate")


def top_weaknesses(rates: DataFrame, arms: DataFrame, n: int = 3) -> DataFrame:
    """The n arms of each player with the lowest rates, ties in the arms' order."""
    w = Window.partitionBy("player_id").orderBy("rate", "arm_id")
    ranked = rates.join(F.broadcast(arms), "category").withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= n)


def rated_games(games: DataFrame, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Rated games (rated, pgn, time_control) with a text, whose time control begins with one of the prefixes, if any are given."""
    begins = F.lit(not prefixes)
    for p in prefixes:
        begins = begins | F.coalesce(F.col("time_control"), F.lit("")).startswith(p)
    return games.where(F.coalesce("rated", F.lit(False)) & (F.coalesce("pgn", F.lit("")) != "") & begins)


def cohort_games(games: DataFrame, classes: tuple[str, ...] = ("rapid", "blitz")) -> DataFrame:
    """Rated standard games (rules, rated, time_class, pgn) of the time classes, with a text."""
    return games.where((F.col("rules") == "chess") & F.coalesce("rated", F.lit(False)) & F.col("time_class").isin(*classes) & (F.coalesce("pgn", F.lit("")) != ""))


def primary_time_class(stats: DataFrame, now: str, least: int = 100, days: int = 365, classes: tuple[str, ...] = ("rapid", "blitz")) -> DataFrame:
    """(player_id, time_class, rating, games) of the class (player_id, time_class, rating, games, last) with most games, the first of `classes` among equals: rated, of `least` games and played in within so many days of now."""
    order = F.array_position(F.array(*map(F.lit, classes)), F.col("time_class"))
    live = stats.where(F.col("time_class").isin(*classes) & (F.col("rating") > 0) & (F.col("games") >= least) & (F.datediff(F.lit(now).cast("date"), F.to_date("last")) <= days))
    best = live.groupBy("player_id").agg(F.min(F.struct(F.negative("games").alias("k"), order.alias("o"), "time_class", "rating", "games")).alias("x"))
    return best.select("player_id", "x.time_class", "x.rating", "x.games")


def with_game(positions: DataFrame, games: DataFrame) -> DataFrame:
    """Positions with the game of the same player and end time, by its id `met` and time class; of games with one time the last. Positions without a game go."""
    last = games.groupBy("player_id", "end_time").agg(F.max_by(F.struct(F.col("game_id").alias("met"), "time_class"), "game_id").alias("g"))
    return positions.join(last, ["player_id", "end_time"]).select(positions["*"], "g.met", "g.time_class")


def counters(games: DataFrame, positions: DataFrame) -> DataFrame:
    """Games by result and time class, errors by severity, phase and category, and mean losses of each player; draws are null results.

    A game's loss is the mean over its graded positions; means are over games whose loss is above 0. Games with a true `failed`, if there is such a column, don't count.
    """
    if "failed" in games.columns:
        games = games.where(~F.coalesce("failed", F.lit(False)))
        positions = positions.join(games.select("game_id"), "game_id", "left_semi")
    classes = games.groupBy("player_id", F.coalesce("time_class", F.lit("unknown")).alias("k")).agg(F.count("*").alias("n"), F.count_if("won").alias("wins"), F.count_if(~F.col("won")).alias("losses"), F.count_if(F.col("won").isNull()).alias("draws"))
    as_map = lambda: F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n"))))
    g = classes.groupBy("player_id").agg(F.sum("n").alias("games"), *[F.sum(c).alias(c) for c in ("wins", "losses", "draws")], as_map().alias("games_by_time_class"))
    of = lambda c, v: F.sum(F.when(F.col(c) == v, F.col("n")).otherwise(0))
    # One row a player, severity, phase and category is what both counts and the map come from.
    cells = positions.where("severity is not null").groupBy("player_id", "severity", "phase", "category").agg(F.count("*").alias("n"))
    e = cells.groupBy("player_id").agg(F.sum("n").alias("errors"), *[of("severity", s).alias(f"{s}s") for s in ("blunder", "mistake", "inaccuracy")], *[of("phase", p).alias(f"{p}_errors") for p in ("opening", "middlegame", "endgame")])
    by = cells.groupBy("player_id", F.col("category").alias("k")).agg(F.sum("n").alias("n")).groupBy("player_id").agg(as_map().alias("errors_by_category"))
    loss = positions.groupBy("player_id", "game_id").agg(F.avg("cp_loss").alias("cp"), F.avg("wp_loss").alias("wp")).groupBy("player_id").agg(F.avg(F.when(F.col("cp") > 0, F.col("cp"))).alias("avg_cp_loss"), F.avg(F.when(F.col("wp") > 0, F.col("wp"))).alias("avg_wp_loss"))
    out = g.join(e, "player_id", "left").join(loss, "player_id", "left").join(by, "player_id", "left").na.fill(0)
    return out.withColumn("errors_by_category", F.coalesce("errors_by_category", F.create_map().cast("map<string,bigint>")))


def opening_repertoire(games: DataFrame, top: int = 10) -> DataFrame:
    """The most played families of each player and colour, with results and the code (eco) of the last game; ties by first appearance."""
    g = games.groupBy("player_id", "color", "opening_family").agg(
        F.count("*").alias("games"), F.count_if("won").alias("wins"), F.count_if(~F.col("won")).alias("losses"), F.count_if(F.col("won").isNull()).alias("draws"),
        F.min("game_id").alias("first_game"), F.max_by("eco", "game_id").alias("eco"),
    )
    w = Window.partitionBy("player_id", "color").orderBy(F.desc("games"), "first_game")
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


# Categories that a short loss, or a long one, speaks for.
SHARP = ("Fork", "Pin", "Hanging Piece", "Discovered Attack", "Skewer", "Deflection", "King Safety", "Mating Pattern")


def heuristic_profile(games: DataFrame) -> DataFrame:
    """(player_id, n, win_rate, elo, tactical, endgame) from results and lengths alone: short losses (under 25 moves) speak for tactics, long ones (over 40) for endgames. A missing length counts as 30."""
    moves, lost, won = F.coalesce("num_moves", F.lit(30)), F.coalesce(~F.col("won"), F.lit(False)), F.coalesce("won", F.lit(False))
    g = games.groupBy("player_id").agg(
        F.count("*").alias("n"), F.count_if(won).alias("wins"), F.count_if(lost).alias("lost"), F.count_if(lost & (moves < 25)).alias("short"), F.count_if(lost & (moves > 40)).alias("long"),
        F.avg(F.when(F.col("player_rating") > 0, F.col("player_rating"))).alias("elo"),
    )
    win, lost = F.col("wins") / F.col("n"), F.greatest(F.col("lost"), F.lit(1))
    clip = lambda x, low, high: F.greatest(F.lit(low), F.least(F.lit(high), x))
    tactical = clip(0.75 - win * 0.50 + F.col("short") / lost * 0.20, 0.30, 0.85)
    return g.select("player_id", "n", win.alias("win_rate"), F.coalesce(F.floor("elo").cast("int"), F.lit(1200)).alias("elo"), tactical.alias("tactical"), clip(0.60 - win * 0.30 + F.col("long") / lost * 0.30, 0.25, 0.80).alias("endgame"))


def heuristic_weaknesses(profile: DataFrame, arms: DataFrame) -> DataFrame:
    """(player_id, category, score) of every player and arm: the tactical or endgame score of heuristic_profile, 0.5 for other arms."""
    c = F.col("category")
    grid = profile.crossJoin(F.broadcast(arms.where(c.isin(*ARMS)).select("category")))
    return grid.select("player_id", "category", F.when(c.isin(*SHARP), F.col("tactical")).when(c.isin(*ENDGAMES), F.col("endgame")).otherwise(0.5).alias("score"))


# Groups of categories whose hit rates are features.
GROUPS = {
    "tactical": ("Fork", "Pin", "Skewer", "Discovered Attack", "Hanging Piece", "Deflection", "Sacrifice"),
    "mating": ("Mating Pattern", "King Safety"),
    "endgame": ("Endgame", "Rook Endgame", "Queen Endgame", "Pawn Endgame", "Bishop Endgame", "Knight Endgame", "Promotion"),
    "quiet": ("Quiet Move",),
}
PLAYER_FEATURES = (
    "mean_wp_loss", "median_wp_loss", "mean_cp_loss", "blunders_pg", "mistakes_pg", "inaccuracies_pg", "err_share_opening", "err_share_middlegame", "err_share_endgame", "opportunities_pg",
    "hit_rate_all", "hit_rate_tactical", "hit_rate_mating", "hit_rate_endgame", "hit_rate_quiet", "mean_moves", "win_rate", "share_blitz",
)


def player_features(games: DataFrame, positions: DataFrame, k: float = 5.0, cap: float = 300.0) -> DataFrame:
    """(player_id, 18 features) from games and graded positions, summed by game first; groups' hit rates are shrunk to the player's own by k positions."""
    has = lambda c, v: F.count_if(F.col("severity").isNotNull() & (F.col(c) == v))
    hit = F.col("critical") & F.col("hit")
    p = positions.groupBy("game_id").agg(
        F.avg("wp_loss").alias("wp"), F.avg("cp_loss").alias("cp"), *[has("severity", s).alias(s) for s in ("blunder", "mistake", "inaccuracy")], *[has("phase", x).alias(x) for x in ("opening", "middlegame", "endgame")], F.count("severity").alias("errors"),
        F.count_if("critical").alias("n_all"), F.count_if(hit).alias("h_all"), *[F.count_if(F.col("critical") & F.col("category").isin(*c)).alias(f"n_{g}") for g, c in GROUPS.items()], *[F.count_if(hit & F.col("category").isin(*c)).alias(f"h_{g}") for g, c in GROUPS.items()],
    )
    rows = games.join(p, "game_id", "left").na.fill(0, [c for c in p.columns if c not in ("game_id",)])
    per = lambda c: F.sum(c) / F.count("*")
    share = lambda c: F.sum(c) / F.greatest(F.sum("errors"), F.lit(1))
    overall = F.sum("h_all") / F.greatest(F.sum("n_all"), F.lit(1))
    rate = lambda g: (F.sum(f"h_{g}") + k * overall) / (F.sum(f"n_{g}") + k)
    values = (
        F.avg("wp"), F.median("wp"), F.avg(F.least("cp", F.lit(cap))), per("blunder"), per("mistake"), per("inaccuracy"), share("opening"), share("middlegame"), share("endgame"), per("n_all"), overall, rate("tactical"), rate("mating"), rate("endgame"), rate("quiet"),
        F.avg("num_moves"), F.avg(F.when(F.col("won"), 1.0).otherwise(0.0)), F.avg(F.when(F.col("time_class") == "blitz", 1.0).otherwise(0.0)),
    )
    return rows.groupBy("player_id").agg(*[v.alias(n) for n, v in zip(PLAYER_FEATURES, values)])


def slug(category: str) -> str:
    return category.lower().replace(" ", "_").replace("-", "_")


def weakness_features(counts: DataFrame) -> DataFrame:
    """(player_id, 7 coarse features, a share of errors for each arm) from counters()."""
    errors, games = F.greatest(F.col("opening_errors") + F.col("middlegame_errors") + F.col("endgame_errors"), F.lit(1)), F.greatest(F.col("games"), F.lit(1))
    return counts.select(
        "player_id", (F.col("middlegame_errors") / errors).alias("middlegame_rate"), (F.col("endgame_errors") / errors).alias("endgame_rate"), (F.col("blunders") / games).alias("blunders_pg"), (F.col("mistakes") / games).alias("mistakes_pg"),
        (F.col("inaccuracys") / games).alias("inaccuracies_pg"), (accuracy_estimate(F.col("avg_wp_loss"), F.col("avg_cp_loss")) / 100).alias("accuracy"), F.log1p("games").alias("games_log"),
        *[(F.coalesce(F.try_element_at("errors_by_category", F.lit(a)), F.lit(0)) / errors).alias(slug(a)) for a in ARMS],
    )


def weakness_rules(counts: DataFrame, arms: DataFrame) -> DataFrame:
    """Scores of each player and arm from 0.5 up, by the shares of errors; rules in sequence, each with its cap."""
    total = F.greatest(F.col("errors"), F.lit(1))
    middle, end, blunders = F.col("middlegame_errors") / total, F.col("endgame_errors") / total, F.col("blunders") / F.greatest(F.col("games"), F.lit(1))
    accuracy = accuracy_estimate(F.col("avg_wp_loss"), F.col("avg_cp_loss"))
    grid = counts.crossJoin(F.broadcast(arms.where(F.col("category").isin(*ARMS))))
    c, s = F.col("category"), F.lit(0.5)
    raised = lambda s, when, cap, by: F.when(when, F.least(F.lit(cap), s + by)).otherwise(s)
    s = raised(s, c.isin(*MIDDLEGAME) & (middle > 0.5), 0.9, F.least(F.lit(0.25), middle * 0.3))
    s = raised(s, c.isin(*ENDGAMES) & (end > 0.25), 0.9, F.least(F.lit(0.30), end * 0.4))
    s = F.when(blunders >= 2, raised(s, c.isin("Hanging Piece", "Fork", "Pin"), 0.92, 0.25)).when(blunders >= 1, raised(s, c.isin("Hanging Piece", "Fork"), 0.85, 0.15)).otherwise(s)
    return grid.withColumn("score", raised(s, c.isin(*ARMS[:4]) & (accuracy < 70), 0.90, 0.10))


def arm_grid(stats: DataFrame, arms: DataFrame) -> DataFrame:
    """Every player with every arm; rate is the player's overall rate (or 0.5) where the arm wasn't met."""
    players = stats.groupBy("player_id").agg(F.first("overall").alias("base"), F.sum("raw_n").alias("raw_total"))
    grid = players.crossJoin(F.broadcast(arms.where(F.col("category").isin(*ARMS))))
    out = grid.join(stats.drop("overall"), ["player_id", "category"], "left")
    base = F.when(F.col("base") > 0, F.col("base")).otherwise(0.5)
    return out.withColumns({"base": base, "seen": F.col("raw_n").isNotNull(), "rate": F.coalesce("rate", base), "n": F.coalesce("n", F.lit(0.0))})


def beta_priors(grid: DataFrame, least: int = LEAST, budget: float = BUDGET) -> DataFrame:
    """alpha and beta of each player with enough positions and each arm, with a strength that grows with the evidence."""
    strength = F.least(F.lit(budget), F.col("n") + 2.0)
    return grid.where(F.col("raw_total") >= least).select("player_id", "category", (1.0 + F.col("rate") * strength).alias("alpha"), (1.0 + (1.0 - F.col("rate")) * strength).alias("beta"))


def irt_priors(grid: DataFrame, least: int = LEAST, evidence: float = 0.5, sd: float = 0.6) -> DataFrame:
    """Mean and sd of each seen arm's offset."""
    mu = F.greatest(F.lit(-1.5), F.least(F.lit(1.5), logit(F.col("rate")) - logit(F.col("expected"))))
    info = evidence * F.col("personal") * F.col("n") * F.col("rate") * (1.0 - F.col("rate"))
    return grid.where((F.col("raw_total") >= least) & F.col("seen")).select("player_id", "category", mu.alias("mean"), (1.0 / F.sqrt(1.0 / sd**2 + info)).alias("sd"))
