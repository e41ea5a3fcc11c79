"""op8's tables by closed form against enumeration, and scores that follow the order of words."""

import random

import numpy as np
import pytest

from skillspark.llm import hpyp

from .test_hpyp import exact_tables


def test_drawn_tables_have_the_exact_distribution(monkeypatch):
    monkeypatch.setattr("tests.llm.test_hpyp.THETA", 3.0)
    u = (np.arange(40_000) + 0.5) / 40_000
    for c, h in ((2, 0.1), (5, 0.6), (6, 0.01), (7, 1.0)):
        want = exact_tables([c], [h])
        got = np.bincount(hpyp.drawn_tables(np.full(len(u), c), np.full(len(u), h), np.full(len(u), 3.0), u), minlength=c + 1) / len(u)
        assert all(got[t] == pytest.approx(want[(t,)], abs=1e-4) for t in range(1, c + 1))


def test_large_restaurants_draw_where_the_weight_is():
    for c, h, a in ((5_000, 1e-3, 100.0), (1_000_000, 1e-4, 5e4), (1_000_000, 1e-9, 20.0)):
        t = np.arange(1, c)
        steps = np.r_[0.0, np.cumsum(np.log(4 * h * (a + t / 2) * (c - t) / ((2.0 * c - t - 1) * t)))]
        w = np.exp(steps - steps.max())
        mean = float((w * np.arange(1, c + 1)).sum() / w.sum())
        u = (np.arange(500) + 0.5) / 500
        assert hpyp.drawn_tables(np.full(500, c), np.full(500, h), np.full(500, a), u).mean() == pytest.approx(mean, rel=2e-3, abs=2e-3)


def test_sweeps_give_the_posterior_of_tables():
    """Many equal restaurants of three words, against enumeration."""
    counts, parent, runs = [5, 3, 1], [0.6, 0.3, 0.1], 20_000
    key = hpyp.mix(np.arange(3 * runs, dtype=np.uint64))
    t = hpyp.seated(np.repeat(np.arange(runs), 3), np.tile(counts, runs), np.tile(parent, runs), key, np.ones(runs), 3.0, 6).reshape(runs, 3)
    want = exact_tables(counts, parent)
    for w in range(3):
        assert t[:, w].mean() == pytest.approx(sum(k[w] * x for k, x in want.items()), rel=0.02)


def test_corpus_sweeps_reseat_each_word_given_the_others():
    words = hpyp.mix(np.arange(3, dtype=np.uint64))
    got = hpyp.corpus_sweeps(words, np.array([1, 4, 900]), [3.0, 30.0, 30.0], 3, 100.0)
    assert len(got) == 3 and all(s[0] == 1 and 1 <= s[1] <= 4 and 1 <= s[2] <= 900 for s in got)


def test_shuffled_words_score_worse(spark):
    rng = random.Random(5)
    lines = ["the quick brown fox jumps over the lazy dog near a river", "one two three four five six seven eight nine ten eleven twelve"]
    texts = [" ".join(lines[i % 2].split()[i % 5 :]) for i in range(200)]
    mixed = [" ".join(rng.sample(t.split(), len(t.split()))) for t in texts]
    rows = [(i, t) for i, t in enumerate(texts)]
    held = {r.doc_id for r in hpyp.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.held_out}
    swapped = [(i, mixed[i] if i in held else t) for i, t in rows]
    score = lambda rows: sum(r.score for r in hpyp.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.held_out)
    assert score(rows) > 0.5 * score(swapped)  # both are negative


def test_scores_dont_depend_on_spread_contexts_being_cut(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    runs = [sorted((r.doc_id, r.score, r.base_score) for r in hpyp.scores(docs.repartition(n), chunk_bytes=size, part=5_000, heavy=200).collect()) for n, size in ((1, 24 << 20), (8, 30_000))]
    assert len(runs[0]) == docs.count()
    for a, b in zip(*runs):
        assert a == pytest.approx(b, rel=1e-9)
