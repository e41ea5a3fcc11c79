"""Sums in ranges against plain loops, on more values than there are ranges."""

import random

import pytest
from pyspark.sql import functions as F

from skillspark.operators import metrics as M


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    return [(k % 2, i, rng.choice([rng.random(), rng.randrange(10) / 10]), int(rng.random() < 0.4)) for i in range(3000) for k in [rng.randrange(4)]]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "g int, id int, p double, y int").repartition(3)


def test_area_and_precision(df, rows):
    auc = {r.g: r.auc for r in M.roc_auc(df, ("g",)).collect()}
    ap = {r.g: r.ap for r in M.average_precision(df, ("g",)).collect()}
    for g in (0, 1):
        mine = [(p, y) for k, _, p, y in rows if k == g]
        pos, neg = [p for p, y in mine if y], [p for p, y in mine if not y]
        assert auc[g] == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))
        assert ap[g] == pytest.approx(sum(sum(y for q, y in mine if q >= p) / sum(q >= p for q, _ in mine) for p in pos) / len(pos))


def test_ranks_and_step_down_values(df, rows):
    ranks = {(r.g, r.id): r.p_rank for r in M.average_rank(df, "p", ("g",)).collect()}
    small = df.withColumn("p", F.col("p") / 100)
    holm = {(r.g, r.id): r.adjusted for r in M.holm(small, "g", "p").collect()}
    for g in (0, 1):
        mine = sorted((p, i) for k, i, p, _ in rows if k == g)
        worst, m = 0.0, len(mine)
        for place, (p, i) in enumerate(mine):
            same = [j for j, (q, _) in enumerate(mine) if q == p]
            assert ranks[g, i] == pytest.approx(1 + sum(same) / len(same))
            worst = max(worst, min(1.0, (m - place) * p / 100))
            assert holm[g, i] == pytest.approx(worst)


def test_difference_of_predictors(spark):
    cells = spark.createDataFrame([(u, t, s, a, b, 4.0 * a, 1.0 * b) for u in range(30) for t, s, a, b in (("x", "x", 3, 4), ("x", "y", 1, 0), ("y", "y", 2, 2), ("y", "x", 2, 2))], "unit int, true string, label string, n_a long, n_b long, se_a double, se_b double")
    out = {r.metric: r for r in M.bootstrap_difference(cells, "unit", 50).collect()}
    assert out["accuracy"].difference == pytest.approx(1 / 8) and out["macro_recall"].difference == pytest.approx(1 / 8) and out["rmse"].difference == pytest.approx(-1)
    assert all(r.low - 1e-9 <= r.difference <= r.high + 1e-9 for r in out.values())


def test_selection_needs_a_head():
    with pytest.raises(ValueError):
        M.selection_score()
