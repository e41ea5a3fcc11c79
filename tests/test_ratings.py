"""Symmetric replays of ratings against a plain loop, the volatility's root, and components of graphs."""

import math
import random

import pytest

from skillspark.operators import ratings as RT
from skillspark.operators.graph import components

SCHEMA = "attempt_id long, player_id long, ts timestamp, puzzle_id string, rating int, solved boolean"


def log(seed, players, puzzles, n, groups):
    """Attempts of players on puzzles of their own group only."""
    import datetime

    rng = random.Random(seed)
    rows = []
    for i in range(n):
        g = rng.randrange(groups)
        q = rng.randrange(puzzles)
        ts = datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=rng.randrange(n))
        rows.append((i, g * 1000 + rng.randrange(players), ts, f"q{g}-{q}", 1300 + q * 37 % 400, rng.random() < 0.5))
    return rows


def plain(rows, seeds):
    me, them, said = {}, {}, {}
    s = RT.GLICKO_SCALE
    for a, who, ts, q, rating, solved in sorted(rows, key=lambda r: (r[2], r[0])):
        x = me.get(who) or ((seeds[who] - 1500) / s if who in seeds else 0.0, (200 if who in seeds else 350) / s, 0.06)
        y = them.get(q) or ((rating - 1500) / s, 200 / s, 0.06)
        said[a] = 1 / (1 + math.exp(-(x[0] - y[0]) / math.sqrt(1 + 3 * y[1] ** 2 / math.pi**2)))
        me[who], them[q] = RT.one_game(*x, *y[:2], float(solved)), RT.one_game(*y, *x[:2], 1 - float(solved))
    states = {("player", str(k)): x for k, x in me.items()} | {("puzzle", k): x for k, x in them.items()}
    return said, {k: (1500 + s * x[0], s * x[1], x[2]) for k, x in states.items()}


@pytest.mark.parametrize("options", [{}, {"most": 40, "slice_events": 60}, {"most": 0, "slice_events": 10_000, "tolerance": 0.0}])
def test_symmetric_replay_equals_a_plain_loop(spark, options):
    """Many small components, small ones beside one large in slices, and all in one slice until it stands still."""
    rows = log(1, 3, 4, 90, 6) + [(1000 + a, 7000 + w, t, "big" + q, r, s) for a, w, t, q, r, s in log(2, 6, 5, 150, 1)]
    seeds = {w: 1400 + 10 * (w % 7) for w in {r[1] for r in rows} if w % 2}
    said, states = plain(rows, seeds)
    players = spark.createDataFrame([(k, x) for k, x in seeds.items()], "player_id long, rating int")
    got, ends = RT.glicko2_symmetric(spark.createDataFrame(rows, SCHEMA), players, **options)
    assert {r.attempt_id: r.predicted for r in got.collect()} == pytest.approx(said, abs=1e-6)
    found = {(r.side, r.id): (r.rating, r.rd, r.volatility) for r in ends.collect()}
    assert found.keys() == states.keys()
    for k, x in states.items():
        assert found[k] == pytest.approx(x, abs=1e-3)


def test_symmetric_replay_of_odd_tables(spark):
    assert [x.collect() for x in RT.glicko2_symmetric(spark.createDataFrame([], SCHEMA))] == [[], []]
    import datetime

    t = datetime.datetime(2024, 1, 1)
    rows = [(1, 1, t, "a", 1500, True), (2, 1, t, "a", None, True), (3, None, t, "a", 1500, True), (4, 1, t, None, 1500, True), (5, 1, t, "a", 1500, None), (6, 1, t, "a", 1500, False)]
    said, _ = plain([rows[0], rows[5]], {})
    assert {r.attempt_id: r.predicted for r in RT.glicko2_symmetric(spark.createDataFrame(rows, SCHEMA))[0].collect()} == pytest.approx(said)


def test_volatility_is_the_root():
    rng = random.Random(0)
    for _ in range(2000):
        square, phi, v, sigma = rng.expovariate(0.3) * 10 ** rng.uniform(-3, 1), rng.uniform(0.1, 2.5), 10 ** rng.uniform(-1, 2), 10 ** rng.uniform(-2, -0.5)
        x, d, a = 2 * math.log(RT.volatility(square, phi, v, sigma)), phi * phi + v, 2 * math.log(sigma)
        assert math.exp(x) * (square - d - math.exp(x)) / (2 * (d + math.exp(x)) ** 2) == pytest.approx((x - a) / RT.TAU**2, abs=1e-9)


def test_batch_and_single_games_agree(spark):
    rng = random.Random(1)
    rows = [(i, rng.uniform(1000, 2000), rng.uniform(40, 350), rng.uniform(0.02, 0.2), rng.uniform(1000, 2000), rng.uniform(30, 300), float(rng.random() < 0.5)) for i in range(50)]
    got = {r.id: r for r in RT.glicko2_period(spark.createDataFrame([r[:4] for r in rows], "id long, rating double, rd double, volatility double"), spark.createDataFrame([(r[0], *r[4:]) for r in rows], "id long, opponent_rating double, opponent_rd double, score double")).collect()}
    s = RT.GLICKO_SCALE
    for i, rating, rd, sigma, other, other_rd, score in rows:
        mu, phi, new = RT.one_game((rating - 1500) / s, rd / s, sigma, (other - 1500) / s, other_rd / s, score)
        assert (got[i].rating, got[i].rd, got[i].volatility) == pytest.approx((1500 + s * mu, s * phi, new), rel=1e-9)


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(5, 0), (7, 5), (2, 9), (9, 2), (9, 11), (3, 3), (-4, 3)], [(0, i) for i in range(1, 80)] + [(100, 101)]])
def test_components(spark, edges):
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
