"""op8's contexts are seated under each word's own probability, and again under the corpus restaurant: against a plain loop over all pairs."""

import zlib
from collections import Counter

import numpy as np
import pytest

from skillspark.llm import hpyp


def plain_scores(docs):
    """The scores of (id, text) with all pairs in one place."""
    texts = {i: hpyp.tokens_of((x or "").encode()).tolist() for i, x in docs}
    pairs, words = Counter(), Counter()
    for i, tokens in texts.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            words.update(tokens)
            pairs.update(zip([hpyp.END, *tokens], tokens))
    known, n, types = np.array(sorted(words), np.uint64), sum(words.values()), len(words)
    u, w = (np.array([x[k] for x in pairs], np.uint64) for k in (0, 1))
    c, key = np.array(list(pairs.values())), hpyp.mix(u) ^ w
    u, w = np.searchsorted(known, u), np.searchsorted(known, w)
    parent, t = np.array([words[int(x)] / n for x in known]), None
    for done in range(hpyp.ROUNDS):
        t = hpyp.seated(u, c, parent[w], key, np.ones(types), hpyp.CONTEXT, hpyp.GIBBS, 0.0, t, done * hpyp.GIBBS)
        customers, taken = np.bincount(w, weights=t, minlength=types).astype(np.int64), [float(types)]
        for _ in range(hpyp.SWEEPS):
            taken.append(float(hpyp.corpus_sweeps(known, customers, taken, types, hpyp.CORPUS)[-1].sum()))
        kept = np.mean(hpyp.corpus_sweeps(known, customers, taken[:-1], types, hpyp.CORPUS)[1:], axis=0)
        below = hpyp.CORPUS + customers.sum()
        left = (hpyp.CORPUS + hpyp.D * np.mean(taken[2:])) / below / (types + 1)
        parent = (customers - hpyp.D * kept) / below + left
    own = np.bincount(u, weights=t, minlength=types)
    seat = {x: c - hpyp.D * t for x, c, t in zip(zip(u.tolist(), w.tolist()), c.tolist(), t.tolist())}
    place = {x: k for k, x in enumerate(known.tolist())}

    def log(a, b):
        a, b = place.get(a, -1), place.get(b, -1)
        strength = hpyp.CONTEXT + (hpyp.D * own[a] if a >= 0 else 0)
        return np.log10((seat.get((a, b), 0) + strength * (parent[b] if b >= 0 else left)) / (hpyp.CONTEXT + (words[int(known[a])] if a >= 0 else 0)))

    return {i: sum(log(a, b) for a, b in zip([hpyp.END, *tokens], tokens)) for i, tokens in texts.items()}


def test_scores_equal_a_loop(spark, sf_dir, monkeypatch):
    """With three frequent words known to all, few or many parts: rare words have their own share, not the mean of the rare ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(80).cache()
    want = plain_scores([(r.doc_id, r.text) for r in docs.collect()])
    for top, part in ((3, 1_000_000), (1 << 16, 3_000)):
        monkeypatch.setattr(hpyp, "TOP", top)
        got = {r.doc_id: r.score for r in hpyp.scores(docs, chunk_bytes=50_000, part=part).collect()}
        assert got == pytest.approx(want, rel=1e-9)


def test_spread_contexts_meet_the_tables_of_other_parts():
    """In the second round a part sees as many tables of its context as there are, with those of pairs of one customer, not an estimate."""
    import pyarrow as pa

    values = {"words": [5, 9], "u": [0, 0], "w": [1, 0], "c": [400, 300], "single": [7, 0], "here": [707, 0], "t": [20, 10], "t_word": [10, 20], "own": [30, 0]}
    kinds = {"u": np.int32, "w": np.int32, "single": np.int32}
    pairs = hpyp._table(hpyp.SEATED, part=[0], **{k: [np.array(v, kinds.get(k, np.int64))] for k, v in values.items()})
    shares = lambda tables: pa.table({"word": pa.array([9, 5], pa.int64()), "share": [1e-3, 1e-3], "n": [400, 900_000], "tables": [0, tables]})
    seats = lambda tables, parts: hpyp._numbers(hpyp._seat(parts, 1000, 10.0, 3, 1)([pa.scalar(0)], pairs, shares(tables)).column("t")[0]).tolist()
    assert seats(37, 2) == seats(900_000, 1)  # nothing elsewhere
    assert sum(seats(90_000, 2)) > sum(seats(37, 2))
