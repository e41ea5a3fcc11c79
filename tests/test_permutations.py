"""The permutation test against a plain loop over the same permutations."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skillspark.operators import models as ML


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(0)
    out = []
    for i in range(150):
        y = rng.choice(["a", "b", "b", "c"])
        out.append((i, rng.gauss({"a": 0, "b": 1, "c": 2}[y], 1.0), rng.random(), y))
    out += [(200, None, 1.0, "a"), (201, float("nan"), 1.0, "a"), (202, 1.0, 1.0, None)]
    return out


def test_permutations_keep_the_labels(spark, rows):
    df = spark.createDataFrame(rows, "id long, x double, y double, label string")
    got = collections.defaultdict(list)
    for r in ML.permuted_labels(df, "id", "label", 20, part=16).collect():
        got[r.rep].append((r.id, r.label))
    want = collections.Counter(r[3] for r in rows if r[3])
    assert len(got) == 21 and all(collections.Counter(y for _, y in x) == want for x in got.values())
    assert dict(got[0]) == {r[0]: r[3] for r in rows if r[3]}
    assert len({tuple(sorted(x)) for x in got.values()}) == 21
    again = {(r.id, r.rep, r.label) for r in ML.permuted_labels(df.repartition(5), "id", "label", 20, part=16).collect()}
    assert again == {(i, k, y) for k, x in got.items() for i, y in x}
    assert ML.permuted_labels(df.limit(0), "id", "label", 5).collect() == []


def test_scores_equal_a_plain_loop(spark, rows):
    df = spark.createDataFrame(rows, "id long, x double, y double, label string")
    good = df.where("x is not null and not isnan(x)")
    fold = {r.id: r.f for r in good.select("id", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5)).alias("f")).collect()}
    z = {r[0]: np.array(r[1:3]) for r in rows if r[0] in fold}
    all_z = np.array(list(z.values()))
    mean, sd = all_z.mean(axis=0), all_z.std(axis=0)
    labels = collections.defaultdict(dict)
    for r in ML.permuted_labels(good, "id", "label", 30).collect():
        labels[r.rep][r.id] = r.label
    want = {}
    for rep, y in labels.items():
        hits = []
        for f in range(5):
            train = [i for i in y if fold[i] != f]
            means = {c: np.mean([(z[i] - mean) / sd for i in train if y[i] == c], axis=0) for c in {y[i] for i in train}}
            for i in y:
                if fold[i] == f:
                    hits.append(min((float((((z[i] - mean) / sd - m) ** 2).sum()), c) for c, m in means.items())[1] == y[i])
        want[rep] = np.mean(hits)
    got = {r.rep: r.score for r in ML.permutation_scores(df, "id", ("x", "y"), "label", 30).collect()}
    assert got == pytest.approx(want)
    row = ML.permutation_test(df, "id", ("x", "y"), "label", 30).first()
    null = [want[k] for k in want if k]
    assert row.score == pytest.approx(want[0]) and row.null_mean == pytest.approx(np.mean(null)) and row.p == pytest.approx((1 + sum(x >= want[0] - 1e-12 for x in null)) / 31)
    assert row.p < 0.05
