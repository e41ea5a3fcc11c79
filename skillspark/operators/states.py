"""Stored states of players: the Gaussian skill with its whole covariance, and the arms of a Beta bandit with anchors, discount and streaks.

A state that is restored goes on as if it had never been stored, but for the decimals that are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.games import SCALE
from ..taxonomy import ARMS
from .attempts import ORDER
from .skill import DELTA_SD, SEEDED_SD, THETA_SD

VERSION = 1


def deviations(cov: Column, n: int = len(ARMS) + 1) -> Column:
    """The standard deviations of a packed covariance."""
    return F.array(*[F.sqrt(cov[i * n - i * (i - 1) // 2]) for i in range(n)])


def prior(players: DataFrame, offsets: DataFrame | None = None, categories: tuple[str, ...] = ARMS) -> DataFrame:
    """(player_id, mean, cov, n) before any attempt, from known ratings (player_id, rating), if any, and what is known of arms (offsets: player_id, category, mean, sd).

    Of offsets, those with a null mean or sd and those of other categories are left out; a deviation is at least 0.001.
    """
    rows = players.select("player_id", F.col("rating").cast("double").alias("seed"))
    if offsets is None:
        rows = rows.withColumn("known", F.create_map().cast("map<string,struct<mean:double,sd:double>>"))
    else:
        entry = F.struct("category", F.struct(F.col("mean").cast("double").alias("mean"), F.greatest(F.col("sd").cast("double"), F.lit(1e-3)).alias("sd")))
        of = offsets.where(F.col("category").isin(*categories) & F.col("mean").isNotNull() & F.col("sd").isNotNull()).dropDuplicates(["player_id", "category"])
        rows = rows.join(of.groupBy("player_id").agg(F.map_from_entries(F.collect_list(entry)).alias("known")), "player_id", "left")
    seeded, n = F.coalesce(F.col("seed") != 0, F.lit(False)), len(categories) + 1
    arm = lambda c, field, default: F.coalesce(F.try_element_at("known", F.lit(c))[field], F.lit(default))
    mean = F.array(F.when(seeded, (F.col("seed") - 1500) / SCALE).otherwise(0.0), *[arm(c, "mean", 0.0) for c in categories])
    sd = F.array(F.when(seeded, F.lit(SEEDED_SD)).otherwise(THETA_SD), *[arm(c, "sd", DELTA_SD) for c in categories])
    rows = rows.select("player_id", mean.alias("mean"), sd.alias("sd"))
    cov = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.concat(F.array(F.get("sd", i) * F.get("sd", i)), F.array_repeat(F.lit(0.0), F.lit(n - 1) - i))))
    return rows.select("player_id", "mean", cov.alias("cov"), F.lit(0).cast("long").alias("n"))


def snapshot(states: DataFrame, categories: tuple[str, ...] = ARMS) -> DataFrame:
    """Skill states (player_id, mean, cov, n) as they are stored: means to 6 decimals and covariances to 8, with the list of categories that they are of."""
    rounded = lambda c, d: F.transform(c, lambda x: F.round(x, d))
    return states.select("player_id", F.array(*map(F.lit, categories)).alias("categories"), F.lit(VERSION).alias("version"), rounded("mean", 6).alias("mean"), rounded("cov", 8).alias("cov"), "n")


def _fits(categories: tuple[str, ...]) -> Column:
    n = len(categories) + 1
    return F.coalesce((F.col("categories") == F.array(*map(F.lit, categories))) & (F.col("version") == VERSION) & (F.size("mean") == n) & (F.size("cov") == n * (n + 1) // 2), F.lit(False))


def restore(saved: DataFrame, players: DataFrame, offsets: DataFrame | None = None, categories: tuple[str, ...] = ARMS) -> DataFrame:
    """(player_id, mean, cov, n, fresh) of every player: the stored state, or the prior where there is none or it is of another list of categories or version."""
    stored = saved.where(_fits(categories)).select("player_id", *[F.col(c).alias(f"s_{c}") for c in ("mean", "cov", "n")])
    rows = prior(players, offsets, categories).join(stored, "player_id", "left")
    return rows.select("player_id", *[F.coalesce(f"s_{c}", c).alias(c) for c in ("mean", "cov", "n")], F.col("s_n").isNull().alias("fresh"))


def initial_states(saved: DataFrame, replayed: DataFrame, players: DataFrame, offsets: DataFrame | None = None) -> DataFrame:
    """(player_id, source, mean, cov, n): a player's state is the saved one, else that of the replayed history, else the prior. It can be gone on from (fit_skill's states)."""
    stored = restore(saved, players).where("not fresh")
    pick = lambda c: F.coalesce(F.col(f"s.{c}"), F.col(f"r.{c}"), F.col(f"p.{c}")).alias(c)
    rows = prior(players, offsets).alias("p").join(stored.alias("s"), "player_id", "left").join(replayed.alias("r"), "player_id", "left")
    source = F.when(F.col("s.n").isNotNull(), "saved").when(F.col("r.n").isNotNull(), "replayed").otherwise("prior")
    return rows.select("player_id", source.alias("source"), pick("mean"), pick("cov"), pick("n"))


_ARM = "map<string,struct<alpha:double,beta:double>>"


def bandit(attempts: DataFrame, saved: DataFrame | None = None, discount: float = 1.0, priors: DataFrame | None = None) -> DataFrame:
    """(player_id, arms, anchors, discount, streak, best, n): every player's arms after attempts, from a stored state or from priors (player_id, category, alpha, beta).

    An attempt on an arm decays all arms of the player towards their anchors, arm = anchor + discount * (arm - anchor), then adds itself; other categories change nothing. So after m
    attempts what an arm had above its anchor weighs discount^m, and an attempt that r others follow discount^r. Anchors are the priors, at least 1; of a stored state its own, 1 where it has none;
    discount is that of the stored state. The streak is the run of solves at the end, best the longest ever.
    """
    known = attempts.where(F.col("category").isin(*ARMS) & F.col("solved").isNotNull()).select("player_id", "category", "solved", *ORDER)
    empty = "player_id long, arms " + _ARM + ", anchors " + _ARM + ", discount double, streak int, best int, n long"
    held = saved if saved is not None else attempts.sparkSession.createDataFrame([], empty)
    held = held.select("player_id", F.struct("arms", "anchors", "discount", "streak", "best", "n").alias("held"))
    rate = F.coalesce(F.col("held.discount"), F.lit(discount))
    last = Window.partitionBy("player_id").orderBy(*[F.desc(c) for c in ORDER])
    rows = known.withColumn("after", F.row_number().over(last) - 1).join(held.select("player_id", F.col("held.discount").alias("own")), "player_id", "left")
    rows = rows.withColumn("weight", F.pow(F.coalesce("own", F.lit(discount)), F.col("after")))
    sums = rows.groupBy("player_id", "category").agg(F.sum(F.when(F.col("solved"), F.col("weight")).otherwise(0.0)).alias("alpha"), F.sum(F.when(F.col("solved"), 0.0).otherwise(F.col("weight"))).alias("beta"), F.count("*").alias("m"))
    sums = sums.groupBy("player_id").agg(F.map_from_entries(F.collect_list(F.struct("category", F.struct("alpha", "beta")))).alias("got"), F.sum("m").alias("m"))
    # Runs of solves between failures; `failed` counts the failures after an attempt, itself included.
    runs = rows.withColumn("failed", F.sum(F.when(F.col("solved"), 0).otherwise(1)).over(last.rowsBetween(Window.unboundedPreceding, 0))).groupBy("player_id", "failed").agg(F.count_if("solved").cast("int").alias("run"))
    runs = runs.groupBy("player_id").agg(F.max("run").alias("longest"), F.max("failed").alias("failures"), F.max_by("run", F.negative("failed")).alias("end"), F.max_by("run", "failed").alias("start"), F.min("failed").alias("least"))
    runs = runs.select("player_id", "longest", "failures", F.when(F.col("least") == 0, F.col("end")).otherwise(0).alias("end"), "start")
    both = sums.join(runs, "player_id").join(held, "player_id", "full")
    if priors is None:
        both = both.withColumn("prior", F.create_map().cast(_ARM))
    else:
        one = F.struct("category", F.struct(F.greatest(F.col("alpha"), F.lit(1.0)).alias("alpha"), F.greatest(F.col("beta"), F.lit(1.0)).alias("beta")))
        both = both.join(priors.where(F.col("category").isin(*ARMS)).groupBy("player_id").agg(F.map_from_entries(F.collect_list(one)).alias("prior")), "player_id", "left")
    stored, m = F.col("held").isNotNull(), F.coalesce("m", F.lit(0))

    def arm(c: str, side: str) -> tuple[Column, Column]:
        at = lambda source: F.try_element_at(F.col(source), F.lit(c))[side]
        anchor = F.coalesce(F.when(stored, at("held.anchors")).otherwise(at("prior")), F.lit(1.0))
        base = F.coalesce(F.when(stored, F.coalesce(at("held.arms"), anchor)), anchor)
        return anchor + F.pow(rate, m) * (base - anchor) + F.coalesce(at("got"), F.lit(0.0)), anchor

    arms, anchors = (F.map_from_arrays(F.array(*map(F.lit, ARMS)), F.array(*[F.struct(arm(c, "alpha")[i].alias("alpha"), arm(c, "beta")[i].alias("beta")) for c in ARMS])) for i in (0, 1))
    streak, longest = F.coalesce(F.col("held.streak"), F.lit(0)), F.coalesce("longest", F.lit(0))
    now = F.when(F.col("m").isNull(), streak).when(F.col("failures") == 0, streak + F.col("end")).otherwise(F.col("end"))
    joined = F.when(F.col("failures") > 0, streak + F.col("start")).otherwise(now)  # the stored streak with the solves before the first failure
    best = F.greatest(F.coalesce(F.col("held.best"), F.lit(0)), longest, F.coalesce(joined, F.lit(0)))
    return both.select("player_id", arms.alias("arms"), anchors.alias("anchors"), rate.alias("discount"), now.cast("int").alias("streak"), best.cast("int").alias("best"), (F.coalesce(F.col("held.n"), F.lit(0)) + m).alias("n"))


def snapshot_bandit(states: DataFrame) -> DataFrame:
    """Bandits as they are stored: arms and anchors to 4 decimals."""
    rounded = lambda c: F.transform_values(c, lambda _, x: F.struct(F.round(x["alpha"], 4).alias("alpha"), F.round(x["beta"], 4).alias("beta"))).alias(c)
    return states.select("player_id", rounded("arms"), rounded("anchors"), "discount", "streak", "best", "n")


def arm_rows(states: DataFrame) -> DataFrame:
    """(player_id, category, alpha, beta, anchor_alpha, anchor_beta) of every known arm of stored bandits: 1 and 1 where an arm or anchor wasn't stored; stored categories that aren't arms are left out."""
    one = lambda source, c, side: F.coalesce(F.try_element_at(F.col(source), F.lit(c))[side], F.lit(1.0))
    entries = [F.struct(F.lit(c).alias("category"), *[one(s, c, x).alias(f"{p}{x}") for s, p in (("arms", ""), ("anchors", "anchor_")) for x in ("alpha", "beta")]) for c in ARMS]
    return states.select("player_id", F.explode(F.array(*entries)).alias("x")).select("player_id", "x.*")


def snapshot_arms(posterior: DataFrame) -> DataFrame:
    """Arms of a player (category, alpha, beta) as they are stored: one row, a map with 4 decimals."""
    entry = F.struct("category", F.struct(F.round("alpha", 4).alias("alpha"), F.round("beta", 4).alias("beta")).alias("arm"))
    return posterior.groupBy("player_id").agg(F.map_from_entries(F.collect_list(entry)).alias("arms"))


def restore_arms(saved: DataFrame) -> DataFrame:
    """(player_id, category, alpha, beta) of every stored player and known arm, see arm_rows."""
    return arm_rows(saved.select("player_id", "arms", F.create_map().cast(_ARM).alias("anchors"))).select("player_id", "category", "alpha", "beta")
