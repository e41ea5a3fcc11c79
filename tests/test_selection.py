"""Choices of arms: chances by quadrature against samples and closed forms, and draws."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skillspark.operators import selection as SE
from skillspark.operators import states as ST
from skillspark.taxonomy import ARMS

SCHEMA = "player_id long, category string, alpha double, beta double"


def test_log_gamma(spark):
    xs = [1e-3, 0.5, 1.0, 1.5, 7.25, 100.0, 1e5]
    for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", SE.log_gamma(F.col("x")).alias("y")).collect():
        assert r.y == pytest.approx(math.lgamma(r.x), rel=1e-12, abs=1e-11)


def chances(spark, arms, **options):
    rows = SE.selection_probabilities(spark.createDataFrame([(1, c, float(a), float(b)) for c, (a, b) in arms.items()], SCHEMA), **options).collect()
    return {r.category: r.probability for r in rows}


def test_chances_of_the_lowest(spark):
    # Of a uniform arm and Beta(n, 1), the uniform one is lower with chance n / (n + 1).
    assert chances(spark, {"a": (1, 1), "b": (4, 1)}) == pytest.approx({"a": 0.8, "b": 0.2}, abs=1e-4)
    assert chances(spark, {c: (1, 1) for c in "abcde"}) == pytest.approx(dict.fromkeys("abcde", 0.2))
    assert chances(spark, {"a": (3, 7)}) == {"a": 1.0}
    arms = {"a": (2.5, 3), "b": (40, 60), "c": (1, 1), "d": (5000, 9000), "e": (30, 2)}
    got = chances(spark, arms)
    draws = np.random.default_rng(0).beta([x[0] for x in arms.values()], [x[1] for x in arms.values()], (400_000, 5)).argmin(axis=1)
    assert sum(got.values()) == pytest.approx(1) and list(got.values()) == pytest.approx((np.bincount(draws, minlength=5) / 400_000).tolist(), abs=0.004)
    assert got == pytest.approx(chances(spark, arms, points=2048), abs=1e-3)


def test_only_allowed_arms_are_drawn(spark):
    rows = [(p, c, a, b) for p in range(2000) for c, a, b in (("a", 2.0, 3.0), ("b", 3.0, 3.0), ("c", 1.0, 9.0))]
    posterior = spark.createDataFrame(rows, SCHEMA)
    allowed = spark.createDataFrame([("a",), ("b",), ("z",)], "category string")
    drawn = {r.player_id: r for r in SE.thompson_draw(posterior, 1, 2, allowed).collect()}
    want = chances(spark, {"a": (2, 3), "b": (3, 3)})
    n = collections.Counter(r.category for r in drawn.values())
    assert len(drawn) == 2000 and set(n) == {"a", "b"} and n["a"] / 2000 == pytest.approx(want["a"], abs=0.04)
    assert all(r.propensity == pytest.approx(want[r.category]) for r in drawn.values())
    again = {r.player_id: r.category for r in SE.thompson_draw(posterior.repartition(3), 1, 2, allowed).collect()}
    assert again == {k: r.category for k, r in drawn.items()}
    other = {r.player_id: r.category for r in SE.thompson_draw(posterior, 2, 2, allowed).collect()}
    assert sum(other[k] != again[k] for k in again) > 300
    nothing = SE.thompson_draw(posterior.where("player_id < 50"), 1, 2, spark.createDataFrame([("z",)], "category string")).collect()
    assert len({r.category for r in nothing}) > 1
    own = spark.createDataFrame([(0, "b"), (1, "c")], "player_id long, category string")
    assert {r.player_id: r.category for r in SE.thompson_draw(posterior.where("player_id < 2"), 1, 2, own).collect()} == {0: "b", 1: "c"}


def test_draws_from_skills(spark):
    players = spark.createDataFrame([(p, 1500) for p in range(300)], "player_id long, rating int")
    offsets = spark.createDataFrame([(p, "Fork", -2.0, 0.1) for p in range(300)], "player_id long, category string, mean double, sd double")
    states = ST.prior(players, offsets)
    rows = SE.skill_draw(states, 1, 2).collect()
    assert np.mean([r.category == "Fork" for r in rows]) > 0.9 and all(0 <= r.propensity <= 1 for r in rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, SE.skill_draw(states.repartition(5), 1, 2).collect()))
    assert {r.category for r in SE.skill_draw(states, 1, 2, ("Pin", ARMS[5])).collect()} == {"Pin", ARMS[5]}
    assert len({r.category for r in SE.skill_draw(states, 1, 2, ("none",)).collect()} - {"Fork"}) < 30
