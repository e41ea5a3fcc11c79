"""Published and limiting cases of the skill models, and the streams against their batch twins."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skillspark.operators import attempts as A
from skillspark.operators import ratings as RT
from skillspark.operators import recommend as RC
from skillspark.operators import skill as S
from skillspark.plans.bindings import view
from skillspark.streaming import attempts as X


def test_glicko2_published_example(spark):
    players = spark.createDataFrame([(1, 1500.0, 200.0, 0.06), (2, 1600.0, 50.0, 0.06)], "id long, rating double, rd double, volatility double")
    results = spark.createDataFrame([(1, 1400.0, 30.0, 1.0), (1, 1550.0, 100.0, 0.0), (1, 1700.0, 300.0, 0.0)], "id long, opponent_rating double, opponent_rd double, score double")
    rows = {r.id: r for r in RT.glicko2_period(players, results).collect()}
    assert rows[1].rating == pytest.approx(1464.06, abs=0.01) and rows[1].rd == pytest.approx(151.52, abs=0.01) and rows[1].volatility == pytest.approx(0.05999, abs=1e-5)
    assert rows[2].rating == 1600 and rows[2].rd > 50


def test_skill_moves_with_results():
    s = S.Skill(1500)
    before = s.mean[0]
    p = s.attempt("Fork", 1500, True)
    assert 0 < p < 1 and s.mean[0] > before and s.mean[1] > 0
    assert np.allclose(s.cov, s.cov.T) and (np.linalg.eigvalsh(s.cov) > 0).all()
    ability = s.mean[0]
    s.attempt("General", 1500, False)  # no arm: it moves the ability, and the arm that was met by way of their covariance
    assert s.mean[0] < ability and s.mean[2] == 0


def test_decay_in_closed_form_equals_updates(spark, sf_dir):
    attempts = view(spark, sf_dir, "attempts").where("player_id % 4 = 0")
    arms = view(spark, sf_dir, "arms")
    got = {(r.player_id, r.category): (r.alpha, r.beta) for r in A.beta_posterior(attempts, arms, 0.9).collect()}
    state = {}
    for r in attempts.orderBy("ts", "attempt_id").collect():
        if r.category == "General":
            continue
        mine = state.setdefault(r.player_id, {})
        for k in mine:
            mine[k] = [0.9 * x for x in mine[k]]
        mine.setdefault(r.category, [0.0, 0.0])[0 if r.solved else 1] += 1
    for player, mine in state.items():
        for category, (a, b) in mine.items():
            assert got[player, category] == pytest.approx((1 + a, 1 + b))


@pytest.fixture(scope="module")
def log(spark, sf_dir, tmp_path_factory):
    """Attempts in two files, the earlier ones first."""
    path = str(tmp_path_factory.mktemp("log") / "attempts")
    a = view(spark, sf_dir, "attempts").withColumn("ts", F.col("ts").cast("timestamp")).where("not skipped")
    middle = a.agg(F.percentile_approx("attempt_id", 0.5)).first()[0]
    a.where(F.col("attempt_id") <= middle).coalesce(1).write.parquet(path)
    a.where(F.col("attempt_id") > middle).coalesce(1).write.mode("append").parquet(path)
    return path, a


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name)


def test_stream_of_posteriors_equals_batch(spark, sf_dir, log):
    path, a = log
    got = {(r.player_id, r.category): (r.alpha, r.beta) for r in run(X.beta(X.read(spark, path)), "beta", "complete").collect()}
    want = {(r.player_id, r.category): (r.alpha, r.beta) for r in A.beta_posterior(a, view(spark, sf_dir, "arms")).where("n > 0").collect()}
    assert got == want


def test_stream_of_first_sights_is_distinct(spark, log):
    path, a = log
    rows = run(X.first_seen(X.read(spark, path)), "seen", "append")
    assert rows.count() == a.select("player_id", "puzzle_id").distinct().count()


def test_stream_of_skills_equals_batch(spark, log):
    pytest.importorskip("google.protobuf")
    path, a = log
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = {r.attempt_id: r for r in run(X.skill(X.read(spark, path, 10)), "skill", "append").collect()}
    want = {r.attempt_id: r.predicted for r in S.fit_skill(a)[0].collect()}
    assert {k: r.predicted for k, r in got.items()} == pytest.approx(want)
    best = {r.player_id: r.best for r in A.streaks(a).collect()}
    assert {r.player_id: r.best for r in got.values()} == best


def one_game(me, other, score):
    """A period of one game by the published formulas, with the volatility by bisection."""
    (mu, phi, sigma), (mu_j, phi_j, _) = me, other
    g = 1 / math.sqrt(1 + 3 * phi_j**2 / math.pi**2)
    e = 1 / (1 + math.exp(-g * (mu - mu_j)))
    v = 1 / (g * g * e * (1 - e))
    delta = v * g * (score - e)
    a = math.log(sigma**2)
    f = lambda x: math.exp(x) * (delta**2 - phi**2 - v - math.exp(x)) / (2 * (phi**2 + v + math.exp(x)) ** 2) - (x - a) / 0.25
    low, high = a - 60, a + 60
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) > 0 else (low, mid)
    sigma = math.exp(low / 2)
    phi = 1 / math.sqrt(1 / (phi**2 + sigma**2) + 1 / v)
    return mu + phi**2 * g * (score - e), phi, sigma


def test_replay_of_ratings_equals_a_plain_loop(spark, sf_dir):
    # Results as ratings would have them: far from these, single games move a rating without bound.
    attempts = view(spark, sf_dir, "attempts").withColumn("rating", F.expr("1300 + rating % 400")).withColumn("solved", F.expr("pmod(xxhash64(attempt_id), 100) / 100 < 1 / (1 + pow(10, (rating - 1500) / 400))"))
    players = spark.createDataFrame([(k, 1400 + 20 * k) for k in range(0, 15, 2)], "player_id long, rating int")
    seeds = {r.player_id: r.rating for r in players.collect()}
    me, own, want = {}, {}, {}
    for r in attempts.orderBy("ts", "attempt_id").collect():
        seed = seeds.get(r.player_id)
        mine = me.get(r.player_id) or ((0.0, 350 / 173.7178, 0.06) if seed is None else ((seed - 1500) / 173.7178, 200 / 173.7178, 0.06))
        mined = r.puzzle_id.startswith("gen_")
        other = own.get((r.player_id, r.puzzle_id)) or ((r.rating - 1500) / 173.7178, (300 if mined else 75) / 173.7178, 0.06)
        g = 1 / math.sqrt(1 + 3 * other[1] ** 2 / math.pi**2)
        want[r.attempt_id] = 1 / (1 + math.exp(-g * (mine[0] - other[0])))
        me[r.player_id] = one_game(mine, other, float(r.solved))
        if mined:
            own[r.player_id, r.puzzle_id] = one_game(other, mine, 1 - float(r.solved))
    got = {r.attempt_id: r.predicted for r in RT.glicko2_replay(attempts.repartition(5), players).collect()}
    assert got == pytest.approx(want, abs=1e-5)


def test_skill_fit_equals_a_plain_loop(spark, sf_dir):
    attempts = view(spark, sf_dir, "attempts").where("player_id % 3 = 0")
    skills, want = {}, {}
    for r in attempts.orderBy("ts", "attempt_id").collect():
        want[r.attempt_id] = skills.setdefault(r.player_id, S.Skill()).attempt(r.category, r.rating, r.solved)
    predictions, states = S.fit_skill(attempts.repartition(7))
    assert {r.attempt_id: r.predicted for r in predictions.collect()} == pytest.approx(want)
    found = {r.player_id: r for r in states.collect()}
    assert found.keys() == skills.keys()
    for k, s in skills.items():
        assert found[k].mean == pytest.approx(s.mean.tolist()) and found[k].sd == pytest.approx(np.sqrt(np.diag(s.cov)).tolist())
    assert S.fit_skill(attempts.limit(0))[0].collect() == [] and S.fit_skill(attempts.limit(0))[1].collect() == []


def test_recommendations_fall_to_later_rungs(spark):
    puzzles = spark.createDataFrame([("a", 1000, "Fork"), ("b", 1300, "Fork"), ("c", 1010, "Pin"), ("d", 2900, "Pin")], "puzzle_id string, rating int, primary_category string")
    choices = spark.createDataFrame([(k, "Fork") for k in range(6)], "player_id long, category string")
    targets = spark.createDataFrame([(k, 5000 if k == 5 else 1000) for k in range(6)], "player_id long, target int")
    seen = ((1, "a"), (2, "a"), (2, "b"), (3, "a"), (3, "b"), (3, "c"), (4, "a"), (4, "b"), (4, "c"), (4, "d"), (5, "a"), (5, "b"), (5, "c"), (5, "d"))
    attempts = spark.createDataFrame(seen, "player_id long, puzzle_id string")
    rows = {r.player_id: (r.puzzle_id, r.rung, r.exhausted) for r in RC.recommend(choices, targets, puzzles, attempts).collect()}
    assert rows[0] == ("a", 2, False) and rows[1] == ("b", 3, False) and rows[2] == ("c", 4, False) and rows[3] == ("d", 5, False)
    assert rows[4][1:] == (6, True) and rows[4][0] in "ac" and 5 not in rows
    own = spark.createDataFrame([(0, "gen_1", "Pin", 1010), (1, "gen_2", "Fork", 1100), (2, "gen_3", "Fork", 1900)], "player_id long, puzzle_id string, category string, rating int")
    rows = {r.player_id: (r.puzzle_id, r.rung) for r in RC.recommend(choices, targets, puzzles, attempts, own, own_share=100).collect()}
    assert rows[0] == ("gen_1", 1) and rows[1] == ("gen_2", 0) and rows[2] == ("c", 4)
