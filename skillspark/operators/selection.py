"""Choosing a player's next arm: exact chances of being the lowest of independent Beta arms, repeatable draws, and draws from a Gaussian skill."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..taxonomy import ARMS
from .skill import symmetric

#: Points of the quadrature, and how many deviations from the means it reaches.
POINTS, REACH = 256, 10.0
BLOCK = 16


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function for x > 0, by Stirling's series eight above."""
    z = x + 8
    low = x
    for i in range(1, 8):
        low = low * (x + i)
    r = 1 / (z * z)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + (1 / z) * (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) - F.log(low)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is worked out once, however often body takes it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _allowed(posterior: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """The arms that may be chosen; all of a player's where none of them may."""
    if allowed is None:
        return posterior
    may = posterior.join(allowed.select(*[c for c in ("player_id", "category") if c in allowed.columns], F.lit(True).alias("_may")).distinct(), [c for c in ("player_id", "category") if c in allowed.columns], "left")
    of = may.groupBy("player_id").agg(F.coalesce(F.max("_may"), F.lit(False)).alias("_any"))
    return may.join(of, "player_id").where("_may or not _any").drop("_may", "_any")


def selection_probabilities(posterior: DataFrame, allowed: DataFrame | None = None, points: int = POINTS) -> DataFrame:
    """(player_id, category, probability): the chance that a sample of the arm is the lowest of samples of all of a player's arms (category, alpha, beta), which is that of Thompson's choice.

    It is the integral of the arm's density times the other arms' chances of being above, by the midpoint rule between what all arms exceed and what the lowest stays under. Each player is a row of arrays;
    nothing is drawn. allowed: categories, or (player_id, category), that may be chosen; where a player has none of them, all may.
    """
    arms = _allowed(posterior.select("player_id", "category", F.col("alpha").cast("double").alias("a"), F.col("beta").cast("double").alias("b")), allowed)
    mean, spread = F.col("a") / (F.col("a") + F.col("b")), F.sqrt(F.col("a") * F.col("b") / (F.col("a") + F.col("b") + 1)) / (F.col("a") + F.col("b"))
    arms = arms.withColumns({"low": mean - REACH * spread, "high": mean + REACH * spread, "scale": log_gamma(F.col("a") + F.col("b")) - log_gamma(F.col("a")) - log_gamma(F.col("b"))})
    rows = arms.groupBy("player_id").agg(F.array_sort(F.collect_list(F.struct("category", "a", "b", "scale"))).alias("arms"), F.greatest(F.lit(0.0), F.min("low")).alias("low"), F.least(F.lit(1.0), F.min("high")).alias("high"))
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "player_id")  # few and short rows with much work each
    step = (F.col("high") - F.col("low")) / points
    points_of = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("low") + (i + 0.5) * step)
    points_of = F.transform(points_of, lambda x: F.struct(F.log(x).alias("p"), F.log1p(-x).alias("q"), step.alias("step")))
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("above"))
    masses = lambda xs: F.transform("arms", lambda arm: F.transform(xs, lambda x: F.exp(arm["scale"] + (arm["a"] - 1) * x["p"] + (arm["b"] - 1) * x["q"]) * x["step"]))
    # The logarithms of an arm's chance to be above each point: running sums in blocks, so that no long array is copied at each point.
    passed = lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.concat(s["above"], F.array(F.log(F.greatest(F.lit(1e-300), 1 - s["sum"] - x / 2)))).alias("above"))
    block = lambda s, m: _let(F.aggregate(m, F.struct(s["sum"].alias("sum"), start["above"].alias("above")), passed), lambda x: F.struct(x["sum"].alias("sum"), F.concat(s["above"], x["above"]).alias("above")))
    above = lambda m: F.aggregate(F.transform(F.sequence(F.lit(0), F.lit((points - 1) // BLOCK)), lambda i: F.slice(m, i * BLOCK + 1, F.lit(BLOCK))), start, block)["above"]
    total = lambda above: F.aggregate(above, F.array_repeat(F.lit(0.0), points), lambda s, x: F.zip_with(s, x, lambda p, q: p + q))
    lowest = lambda m, g, every: F.aggregate(F.zip_with(m, F.zip_with(every, g, lambda p, q: p - q), lambda x, y: x * F.exp(y)), F.lit(0.0), lambda s, x: s + x)
    chance = _let(points_of, lambda xs: _let(masses(xs), lambda mass: _let(F.transform(mass, above), lambda up: _let(total(up), lambda every: F.zip_with(mass, up, lambda m, g: lowest(m, g, every))))))
    rows = rows.select("player_id", "arms", chance.alias("chance")).withColumn("total", F.aggregate("chance", F.lit(0.0), lambda s, x: s + x))
    out = rows.select("player_id", "total", F.explode(F.arrays_zip(F.transform("arms", lambda x: x["category"]).alias("category"), "chance")).alias("x"))
    return out.select("player_id", F.col("x.category").alias("category"), (F.col("x.chance") / F.col("total")).alias("probability"))


def uniform(*key: Column) -> Column:
    """A number in [0, 1) from the md5 of key, 52 bits of it."""
    digits = F.substring(F.md5(F.concat_ws(":", *[k.cast("string") for k in key])), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 52)


def thompson_draw(posterior: DataFrame, step: int = 0, seed: int = 0, allowed: DataFrame | None = None) -> DataFrame:
    """(player_id, category, propensity): a draw of Thompson's choice for each player, with its chance. The same player, step and seed draw the same."""
    by = selection_probabilities(posterior, allowed).groupBy("player_id").agg(F.array_sort(F.collect_list(F.struct("category", "probability"))).alias("arms"))
    u = uniform(F.col("player_id"), F.lit(step), F.lit(seed))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("struct<category:string,probability:double>").alias("arm"))

    def passed(s: Column, arm: Column) -> Column:
        found = F.when(s["arm"].isNotNull() & (s["sum"] > F.col("u")), s["arm"]).otherwise(F.when(arm["probability"] > 0, arm).otherwise(s["arm"]))
        return F.struct((s["sum"] + arm["probability"]).alias("sum"), found.alias("arm"))

    out = by.withColumn("u", u).withColumn("x", F.aggregate("arms", start, passed)["arm"])
    return out.select("player_id", F.col("x.category").alias("category"), F.col("x.probability").alias("propensity"))


def skill_draw(states: DataFrame, step: int = 0, seed: int = 0, allowed: tuple[str, ...] | None = None, draws: int = 1000) -> DataFrame:
    """(player_id, category, propensity): for each skill state (player_id, mean, cov) the category with the lowest of sampled offsets, of those allowed if there are any, and the share of `draws` further samples of all that choose it.

    The same player, step and seed draw the same, whatever the layout.
    """
    n = len(ARMS) + 1
    may = np.array([allowed is None or c in allowed for c in ARMS])
    may = may if may.any() else np.ones(len(ARMS), bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen, share = [], []
            for who, mean, cov in zip(*(batch.column(c).to_pylist() for c in ("player_id", "mean", "cov"))):
                cov = symmetric(cov, n)
                try:
                    root = np.linalg.cholesky(cov)
                except np.linalg.LinAlgError:
                    root = np.linalg.cholesky(cov + 1e-9 * np.eye(n))
                x = np.asarray(mean) + np.random.default_rng((seed, step, abs(who), int(who < 0))).standard_normal((draws + 1, n)) @ root.T
                low = int(np.where(may, x[0, 1:], np.inf).argmin())
                chosen.append(ARMS[low])
                share.append(float((x[1:, 1:].argmin(axis=1) == low).mean()) if draws else None)
            yield pa.RecordBatch.from_arrays([batch.column("player_id"), pa.array(chosen, pa.string()), pa.array(share, pa.float64())], names=["player_id", "category", "propensity"])

    return states.select("player_id", "mean", "cov").mapInArrow(run, "player_id long, category string, propensity double")
