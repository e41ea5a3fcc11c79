"""The mix against its targets, worked out by resharing round by round, and against its own schedule."""

import collections
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from skillspark.llm import mixture

SCHEMA = "doc_id long, text string, source string, id long, size string, has long, copy long, slot string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "s", 1, 1, "t") for i, t, s in rows], SCHEMA)


def words(n):
    return " ".join(f"w{i}" for i in range(n))


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def shares(rows, most=3):
    """Target of each source: what is above goes to the others by weight, round by round."""
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    full = {}
    while True:
        left = sum(sizes.values()) - sum(full.values())
        open_ = [s for s in order if s not in full]
        target = {s: Fraction(left * weight[s], sum(weight[x] for x in open_)) for s in open_}
        above = [s for s in open_ if target[s] > most * sizes[s]]
        if not above:
            return {**full, **target}, sizes
        full |= {s: Fraction(most * sizes[s]) for s in above}


def uneven(seed, n):
    rng = random.Random(seed)
    names = ["a", "b", "Z", "é", "", None, "tiny", "hot", "hot", "hot"]
    return [(i, words(rng.randrange(1, 40) if rng.random() < 0.9 else 600), rng.choice(names)) for i in range(n)] + [(n, words(2), "one"), (n + 1, words(1), "two")]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_sources_reach_their_targets(spark, seed):
    rows = uneven(seed, 150 * (seed + 1))
    target, sizes = shares(rows)
    got = mixture.amounts(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r["size"]) for r in got) == sorted((i, size(t)) for i, t, _ in rows)
    source = {i: s for i, _, s in rows}
    taken = collections.Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - float(target[s])) < 1e-6 and 0 <= r.taken <= 3 * r["size"]
        taken[s] += r.taken
    assert all(taken[s] == int(target[s]) for s in target)


def test_pieces_are_whole_documents_in_passes(spark):
    """A document's pieces are stretches of it; each slot has one source and at most a block of words; every pass is shuffled."""
    rows = uneven(3, 300)
    pieces = mixture.mix(frame(spark, rows), slots=256, block=64).collect()
    total = sum(size(t) for _, t, _ in rows)
    block = min(64, -(-total // 256))
    slots, told = collections.defaultdict(list), collections.Counter()
    sizes = {i: size(t) for i, t, _ in rows}
    for p in pieces:
        slots[p.slot].append(p)
        told[p.doc_id] += p.n_words
        assert p.n_words > 0 and 0 <= p.first_word and p.first_word + p.n_words <= sizes[p.doc_id]
    assert all(len({p.source for p in x}) == 1 and sum(p.n_words for p in x) <= block for x in slots.values())
    assert told == {r.doc_id: r.taken for r in mixture.amounts(frame(spark, rows), slots=256, block=64).collect() if r.taken}
    # Any beginning of the mix has about the wanted shares.
    target, _ = shares(rows)
    line = sorted(slots)
    for part in (0.25, 0.5, 0.75):
        here = collections.Counter(slots[x][0].source for x in line[: int(len(line) * part)])
        for s, t in target.items():
            assert abs(here[s] - part * float(t) / block) <= 3 + 0.02 * len(line)


def test_turned_bits(spark):
    rows = spark.range(1 << 9).select("id", mixture.turned(F.col("id"), 9).alias("x")).collect()
    assert all(r.x == int(f"{r.id:09b}"[::-1], 2) for r in rows)
    assert spark.range(1).select(mixture.turned(F.lit(1).cast("long"), 40).alias("x")).first().x == 1 << 39


def test_reruns_and_layouts_agree(spark):
    rows = uneven(4, 200)
    a = sorted(tuple(r) for r in mixture.amounts(frame(spark, rows).repartition(7)).collect())
    assert a == sorted(tuple(r) for r in mixture.amounts(frame(spark, rows[::-1]).coalesce(1)).collect())


def test_nulls_repeated_rows_and_empty_tables(spark):
    rows = [(1, words(5), "a"), (1, words(5), "a"), (1, words(5), "a"), (None, words(4), "a"), (None, words(4), "a"), (2, None, "a"), (3, "", None), (4, " \t\n", "b"), (5, words(9), None), (6, words(3), "")]
    target, _ = shares(rows)
    got = mixture.amounts(frame(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.taken <= 3 * r["size"] for r in got)
    assert sum(r.taken for r in got) == sum(int(x) for x in target.values())
    assert {(r["size"], r.source_size) for r in got if r.doc_id in (3, 5)} == {(0, 9), (9, 9)}
    assert [tuple(r) for r in mixture.amounts(frame(spark, [(1, None, None), (2, " ", "x")])).orderBy("doc_id").collect()] == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    assert mixture.amounts(frame(spark, [])).collect() == [] and mixture.mix(frame(spark, [])).collect() == []


def test_one_document_and_very_long_ones(spark):
    assert [tuple(r) for r in mixture.amounts(frame(spark, [(1, words(7), "a")])).collect()] == [(1, 7, 7, 7.0, 7)]
    rows = [(1, words(300_000), "a"), (2, words(10), "b")]
    got = {r.doc_id: r for r in mixture.amounts(frame(spark, rows)).collect()}
    assert got[2].taken == 30 and got[1].taken == 300_010 - 30


def test_no_python_on_the_way(spark):
    plan = mixture.amounts(frame(spark, uneven(5, 30)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
