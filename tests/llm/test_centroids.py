"""Clustering with ns-bounds against plain Lloyd rounds over whole numbers."""

import collections
import hashlib
import math

import numpy as np
import pytest

from skillspark.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, id long, q string, cluster string, label int"


def lloyd(rows, k=8, rounds=10, scale=1024, seed=3):
    """(id, cluster, distance, inertia of the cluster, inertia, code) of each row (id, numbers)."""
    rows = [(i, [math.floor(scale * x) for x in v]) for i, v in rows]
    first = sorted(rows, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))[:k]
    middle = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(middle))
    for _ in range(rounds):
        members = collections.defaultdict(list)
        for _, v in rows:
            members[near(v)[1]].append(v)
        middle = [[sum(x) // len(members[j]) for x in zip(*members[j])] if members[j] else c for j, c in enumerate(middle)]
    out = [(i, *near(v)[::-1]) for i, v in rows]
    inertia = collections.Counter()
    for _, j, d in out:
        inertia[j] += d
    return sorted((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, middle[j])).encode()).hexdigest()) for i, j, d in out)


def clustered(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 1, "q", "c", 0) for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in centroids.cluster(df, **options).collect())


def vectors(seed, n, dims=64, groups=5):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(groups, dims))
    return [(i, [float(np.float32(x)) for x in base[i % groups] * 0.2 + rng.normal(size=dims) * 0.1]) for i in range(n)]


def test_equals_plain_rounds(spark):
    rows = vectors(0, 300)
    assert clustered(spark, rows) == lloyd(rows)


def test_ties_repeated_rows_and_few_vectors(spark):
    """Vectors on a small grid lie equally far from several centroids."""
    rng = np.random.default_rng(1)
    rows = [(i % 90, [float(x) for x in rng.integers(-1, 2, 4)]) for i in range(120)]
    assert clustered(spark, rows + rows[:20], dims=4) == lloyd(rows + rows[:20])
    same = [(7, [0.5] * 4)] * 10
    assert clustered(spark, same, dims=4) == lloyd(same)
    assert clustered(spark, rows[:3], dims=4) == lloyd(rows[:3])
    assert clustered(spark, rows, dims=4, k=3, rounds=0) == lloyd(rows, k=3, rounds=0)


def test_vectors_that_take_no_part(spark):
    good = vectors(2, 40)
    bad = [(100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 65), (104, [float("nan")] + [0.0] * 63), (105, [float("inf")] * 64), (106, [None] + [0.0] * 63), (None, [1.0] * 64)]
    assert clustered(spark, good + bad) == lloyd(good)
    assert clustered(spark, bad) == [] and clustered(spark, []) == []
    assert centroids.cluster(spark.createDataFrame([], SCHEMA)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_very_large_components_stop_at_the_limit(spark):
    rows = [(i, [float(10 ** (i % 30))] * 64) for i in range(20)]
    most = centroids.limit(64)
    assert clustered(spark, rows, rounds=2) == lloyd([(i, [min(1024 * x, most) / 1024 for x in v]) for i, v in rows], rounds=2)


def test_bounds_are_never_passed_and_save_distances():
    """After every round each stored distance, loosened by the whole displacement, bounds the true one; most distances are not worked out again."""
    rng = np.random.default_rng(3)
    q = np.concatenate([rng.integers(-50, 50, (200, 16)) + 400 * g for g in range(4)]).astype(np.int32)
    history = q[rng.choice(len(q), 6, replace=False)].astype(np.int64)[None]
    cluster = apart = seen = None
    asked = []
    for _ in range(12):
        cluster, apart, seen, n = centroids.reassigned(q, cluster, apart, seen, history)
        true = ((q[:, None].astype(np.int64) - history[-1][None]) ** 2).sum(axis=2)
        assert (cluster == true.argmin(axis=1)).all()
        moved = centroids.drifts(history)[seen, np.arange(6)]
        assert (np.abs(np.sqrt(apart) - np.sqrt(true)) <= moved + 1e-6).all()
        asked.append(n)
        now = np.array([q[cluster == j].sum(axis=0, dtype=np.int64) // max(1, (cluster == j).sum()) if (cluster == j).any() else history[-1][j] for j in range(6)])
        history = np.concatenate((history, now[None]))
    assert sum(asked[2:]) < 0.3 * len(q) * 6 * len(asked[2:])


def test_displacement_is_that_of_the_whole_way():
    """A centroid that comes back has no drift, however far it went."""
    history = np.zeros((3, 1, 2), np.int64)
    history[1, 0] = (300, 400)
    assert centroids.drifts(history)[:, 0].tolist() == [0, 500, 0]


@pytest.mark.parametrize("tasks", [1, 7])
def test_layout_does_not_matter(spark, tasks):
    rows = vectors(4, 150)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(tasks)
    assert sorted(tuple(r) for r in centroids.cluster(df).collect()) == lloyd(rows)
