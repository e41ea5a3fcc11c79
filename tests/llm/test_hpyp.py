"""The samplers against exact enumeration, and scores against other layouts of the table."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from skillspark.llm import hpyp

D, THETA = 0.5, 3.0


def exact_predictive(words, parent):
    """The expected probability of each token over all seatings of those before it, weighed by their chances."""
    states, out = {tuple([0] * len(parent)): 1.0}, []
    count = [0] * len(parent)
    for n, w in enumerate(words):
        mean, after = 0.0, defaultdict(float)
        for tables, chance in states.items():
            new, old = (THETA + D * sum(tables)) * parent[w], max(0.0, count[w] - D * tables[w])
            mean += chance * (new + old) / (THETA + n)
            more = tuple(t + (i == w) for i, t in enumerate(tables))
            after[more] += chance * new / (new + old)
            after[tables] += chance * old / (new + old)
        states = {k: v for k, v in after.items() if v}
        count[w] += 1
        out.append(mean)
    return out


def partitions(n):
    """All ways of n customers to share tables, as sizes of the tables (one for each way)."""
    def grow(i, sizes):
        if i == n:
            yield tuple(sizes)
            return
        for k in range(len(sizes)):
            yield from grow(i + 1, [s + (j == k) for j, s in enumerate(sizes)])
        yield from grow(i + 1, [*sizes, 1])

    yield from grow(0, [])


def rising(x, step, n):
    return math.prod(x + step * i for i in range(n))


def exact_tables(counts, parent):
    """The chances of all numbers of tables of the words, given how often each occurs."""
    weights = defaultdict(float)
    each = [Counter() for _ in counts]
    for w, c in enumerate(counts):
        for sizes in partitions(c):
            each[w][len(sizes)] += math.prod(rising(1 - D, 1, s - 1) for s in sizes)
    for tables in itertools.product(*(e.items() for e in each)):
        t = [k for k, _ in tables]
        weights[tuple(t)] += math.prod(x for _, x in tables) * math.prod(p**k for p, k in zip(parent, t)) * rising(THETA, D, sum(t))
    total = sum(weights.values())
    return {k: v / total for k, v in weights.items()}


def test_predictive_probabilities_equal_enumeration():
    words, parent = [0, 1, 0, 2, 0, 0, 1, 2, 2, 0], [0.5, 0.2, 0.3]
    got = hpyp.predictive(np.array(words), np.array(parent), D, THETA, [hpyp.seed(np.arange(2), k) for k in range(20_000)])
    assert list(got) == pytest.approx(exact_predictive(words, parent), rel=0.01)
    # Given one seating, the chances of all words sum to one.
    assert sum(hpyp.predictive(np.array([*words, w]), np.array(parent), D, THETA, [7])[-1] for w in range(3)) == pytest.approx(1)


def test_gibbs_sweeps_give_the_posterior_of_tables():
    words, parent = [0, 0, 1, 0, 1, 1, 0, 0, 2], [0.6, 0.3, 0.1]
    want = exact_tables([5, 3, 1], parent)
    rng, runs = random.Random(2), 20_000
    found = Counter(tuple(hpyp.gibbs_tables(np.array(words), np.array(parent), D, THETA, 3, rng).tolist()) for _ in range(runs))
    assert sum(abs(found[k] / runs - want.get(k, 0)) for k in {*found, *want}) < 0.05


def rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(None, "a null id"), (1, "a repeated id"), (1, "a repeated id"), (2, None), (3, "")], "doc_id long, text string")
    return docs.unionByName(extra)


def test_scores_dont_depend_on_the_layout_or_the_chunks(spark, sf_dir):
    docs = rows(spark, sf_dir)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.base_score, r.score)
    runs = [sorted(hpyp.scores(docs.repartition(n), chunk_bytes=size).collect(), key=key) for n, size in ((1, 24 << 20), (8, 24 << 20), (32, 30_000))]
    assert len(runs[0]) == docs.count()
    for other in runs[1:]:
        for a, b in zip(runs[0], other):
            assert (a.doc_id, a.n_tokens, a.n_known, a.train_tokens) == (b.doc_id, b.n_tokens, b.n_known, b.train_tokens)
            assert a.score == pytest.approx(b.score, rel=1e-9) and a.base_score == pytest.approx(b.base_score, rel=1e-9)


def test_held_out_scores_beat_the_base(spark, sf_dir):
    held = [r for r in hpyp.scores(rows(spark, sf_dir)).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_sparse_and_null_ids(spark):
    texts = [(None if i % 3 == 0 else i * 10**12, f"w{i % 7} w{i % 5} w{i}") for i in range(90)]
    out = hpyp.scores(spark.createDataFrame(texts, "doc_id long, text string"), chunk_bytes=100).collect()
    assert len(out) == 90 and all(r.score < 0 for r in out)
