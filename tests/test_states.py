"""Stored states: what is restored goes on as the whole log would."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from skillspark.operators import skill as S
from skillspark.operators import states as ST
from skillspark.plans.bindings import view
from skillspark.taxonomy import ARMS

N = len(ARMS) + 1


@pytest.fixture(scope="module")
def halves(spark, sf_dir):
    a = view(spark, sf_dir, "attempts").where("player_id % 2 = 0")
    middle = a.agg(F.percentile_approx("ts", 0.5)).first()[0]
    return a.where(F.col("ts") < middle).cache(), a.where(F.col("ts") >= middle).cache(), a.cache()


def by_player(rows):
    return {r.player_id: r for r in rows.collect()}


def test_a_fit_goes_on_from_its_stored_state(spark, sf_dir, halves):
    first, second, whole = halves
    players = whole.select("player_id").distinct().withColumn("rating", F.when(F.col("player_id") % 4 == 0, 1700))
    offsets = spark.createDataFrame([(p.player_id, c, m, s) for p in players.collect() for c, m, s in (("Fork", -0.5, 0.2), ("Pin", 0.4, 1e-9), ("No Arm", 1.0, 1.0), ("Skewer", None, 1.0))], "player_id long, category string, mean double, sd double")
    begun = ST.restore(ST.snapshot(S.fit_skill(first.limit(0), None, ST.prior(players, offsets))[1]), players)
    assert all(not r.fresh for r in begun.collect())
    stored = ST.snapshot(S.fit_skill(first, None, begun)[1])
    said, ends = S.fit_skill(second, None, ST.restore(stored, players))
    all_said, all_ends = S.fit_skill(whole, None, ST.prior(players, offsets))
    want = {r.attempt_id: r.predicted for r in all_said.collect()}
    assert all(want[r.attempt_id] == pytest.approx(r.predicted, abs=1e-6) for r in said.collect())
    found, wanted = by_player(ends), by_player(all_ends)
    assert found.keys() == wanted.keys()
    for k, r in found.items():
        assert r.n == wanted[k].n and r.mean == pytest.approx(wanted[k].mean, abs=2e-6) and r.cov == pytest.approx(wanted[k].cov, abs=1e-6)


def test_priors_are_those_of_the_model(spark):
    rows = by_player(ST.prior(spark.createDataFrame([(1, 1700), (2, None), (3, 0)], "player_id long, rating int"), spark.createDataFrame([(1, "Fork", 0.3, 0.1)], "player_id long, category string, mean double, sd double")))
    for k, seed in ((1, 1700), (2, None), (3, 0)):
        s = S.Skill(seed)
        if k == 1:
            i = 1 + ARMS.index("Fork")
            s.mean[i], s.cov[i, i] = 0.3, 0.01
        assert rows[k].mean == pytest.approx(s.mean.tolist()) and S.symmetric(rows[k]["cov"], N) == pytest.approx(s.cov)
    assert np.allclose(S.symmetric([1.0, 2.0, 3.0], 2), [[1, 2], [2, 3]])
    assert spark.range(1).select(ST.deviations(F.array(*[F.lit(float(i)) for i in range(6)]), 3).alias("x")).first().x == pytest.approx([0, 3**0.5, 5**0.5])


def test_states_of_another_list_or_version_start_afresh(spark, sf_dir, halves):
    players = spark.createDataFrame([(1, 1700), (2, None), (3, 1500), (4, 1500)], "player_id long, rating int")
    kept = S.fit_skill(halves[0])[1].limit(1).withColumn("player_id", F.lit(1).cast("long"))
    one = ST.snapshot(kept)
    saved = one.unionByName(one.withColumns({"player_id": F.lit(3).cast("long"), "categories": F.array(F.lit("x"))})).unionByName(one.withColumns({"player_id": F.lit(4).cast("long"), "version": F.lit(0)}))
    rows = by_player(ST.restore(saved, players))
    assert not rows[1].fresh and rows[1].mean == pytest.approx([round(x, 6) for x in kept.collect()[0].mean]) and rows[1].n > 0
    assert rows[2].fresh and rows[2].mean[0] == 0 and rows[2].n == 0
    assert rows[3].fresh and rows[4].fresh and rows[3]["cov"][0] == pytest.approx(S.SEEDED_SD**2)
    picked = by_player(ST.initial_states(saved, kept.withColumn("player_id", F.lit(2).cast("long")), players))
    assert {k: r.source for k, r in picked.items()} == {1: "saved", 2: "replayed", 3: "prior", 4: "prior"}


def plain_bandit(rows, discount, anchors=None, state=None):
    """Arms, streak and best of one player, attempt by attempt."""
    anchors = {c: tuple((anchors or {}).get(c, (1.0, 1.0))) for c in ARMS}
    arms, streak, best = {c: list(a) for c, a in anchors.items()}, 0, 0
    if state:
        arms, streak, best = state
    for c, solved in rows:
        if c in arms:
            for k in arms:
                arms[k] = [a0 + discount * (x - a0) for a0, x in zip(anchors[k], arms[k])]
            arms[c][0 if solved else 1] += 1
            streak = streak + 1 if solved else 0
            best = max(best, streak)
    return arms, streak, best


@pytest.mark.parametrize("discount", [1.0, 0.9])
def test_bandits_go_on_with_anchors_discount_and_streaks(spark, halves, discount):
    first, second, whole = halves
    log = collections.defaultdict(list)
    for r in whole.orderBy("ts", "attempt_id").collect():
        log[r.player_id].append((r.category, r.solved))
    ids = sorted(log)
    priors = {p: {"Fork": (0.2, 3.0), "Pin": (2.5, 1.5)} for p in ids[::2]}
    frame = spark.createDataFrame([(p, c, *x) for p, y in priors.items() for c, x in y.items()], "player_id long, category string, alpha double, beta double")
    held = ST.snapshot_bandit(ST.bandit(first, discount=discount, priors=frame))
    done = by_player(ST.bandit(second, held, discount=0.5))  # a stored discount counts
    for p in ids:
        anchors = {c: (max(1.0, a), max(1.0, b)) for c, (a, b) in priors.get(p, {}).items()}
        arms, streak, best = plain_bandit(log[p], discount, anchors)
        assert (done[p].streak, done[p].best, done[p].n) == (streak, best, sum(c in ARMS for c, _ in log[p]))
        assert done[p].discount == discount
        for c in ARMS:
            assert (done[p].arms[c].alpha, done[p].arms[c].beta) == pytest.approx(arms[c], abs=2e-4)
            assert (done[p].anchors[c].alpha, done[p].anchors[c].beta) == pytest.approx(anchors.get(c, (1, 1)))


def test_streaks_across_the_store(spark):
    """Solves before and after the store make one run; players without new attempts keep what they have."""
    row = lambda i, p, s: (i, p, i, "Fork", s)
    a = spark.createDataFrame([row(1, 1, False), row(2, 1, True), row(3, 1, True), row(4, 2, True), row(5, 3, True)], "attempt_id long, player_id long, ts long, category string, solved boolean")
    b = spark.createDataFrame([row(6, 1, True), row(7, 1, False), row(8, 1, True), row(9, 3, True), (10, 4, 10, "General", True)], a.schema)
    rows = by_player(ST.bandit(b, ST.bandit(a)))
    assert {k: (r.streak, r.best, r.n) for k, r in rows.items()} == {1: (1, 3, 6), 2: (1, 1, 1), 3: (2, 2, 2)}


def test_unknown_and_missing_arms(spark):
    stored = ST.snapshot_arms(spark.createDataFrame([(1, "Fork", 2.00004, 3.0), (1, "No Arm", 9.0, 9.0)], "player_id long, category string, alpha double, beta double"))
    back = {r.category: (r.alpha, r.beta) for r in ST.restore_arms(stored).collect()}
    assert len(back) == 23 and back["Fork"] == (2.0, 3.0) and back["Pin"] == (1.0, 1.0)
