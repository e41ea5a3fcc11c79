"""Permutations against a plain loop: rows keep their columns and repeated units each count."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from skillspark.operators import models as ML


def test_permutations_equal_ordering_all_units_by_hash(spark):
    rows = [(i, "abc"[i * i % 3] if i % 7 else "d", i * 10) for i in range(500)] + [(3, "a", -1), (3, "d", -2), (4, None, 0)]
    df = spark.createDataFrame(rows, "unit long, y string, x long")
    got = ML.permuted_labels(df, "unit", "y", 6, seed=2, part=64, keep=("x",)).collect()
    known = [r for r in rows if r[1] is not None]
    assert Counter((r.rep, r.unit, r.x) for r in got) == Counter((k, u, x) for k in range(7) for u, _, x in known)
    assert Counter((r.rep, r.y) for r in got) == Counter((k, y) for k in range(7) for _, y, _ in known)
    hashes = {(r.unit, r.rep): r.h for r in df.select("unit", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("rep")).select("unit", "rep", F.xxhash64("unit", "rep", F.lit(2)).alias("h")).collect()}
    labels, found = sorted(y for _, y, _ in known), defaultdict(list)
    for r in got:
        if r.rep:
            found[r.rep].append((hashes[r.unit, r.rep], r.unit, r.y))
    assert all([y for _, _, y in sorted(x)] == labels for x in found.values())
