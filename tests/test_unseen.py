"""Unseen puzzles in a range: all pairs against plain loops, and their counts."""

from collections import Counter

from skillspark.operators import recommend as RC
from skillspark.plans import registry


def test_pairs_and_counts_equal_loops(spark):
    puzzles = [(f"p{k}", None if k % 13 == 0 else 900 + 7 * k) for k in range(120)]
    want = [(1, 1000, 1200), (2, 1150, 1150), (3, 0, 500), (4, 1100, 1900), (5, 1300, 1200)]
    seen = [(p, f"p{k}") for p, *_ in want for k in range(0, 120, p + 1)] * 2
    rated = {k: 1200 if x is None else x for k, x in puzzles}
    pairs = {(p, k) for p, low, high in want for k, x in rated.items() if low <= x <= high} - set(seen)
    make = lambda rows, names: spark.createDataFrame(rows, names)
    w, z, a = make(want, "player_id long, low int, high int"), make(puzzles, "puzzle_id string, rating int"), make(seen, "player_id long, puzzle_id string")
    found = [(r.player_id, r.puzzle_id) for r in RC.unseen_pairs(w, z, a).collect()]
    assert len(found) == len(set(found)) and set(found) == pairs
    counts = Counter(p for p, _ in pairs)
    assert {r.player_id: r.unseen for r in RC.unseen_in_range(w.where("low <= high"), z, a).collect()} == {p: counts[p] for p, low, high in want if low <= high}


def test_query_gives_pairs(spark, sf_dir):
    assert set(registry.QUERIES["f10_j8_unseen_in_range"](spark, sf_dir).columns) == {"player_id", "puzzle_id"}
