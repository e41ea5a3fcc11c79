"""Tables that grow after Spark has sized them are not broadcast."""

import uuid

from pyspark.sql import functions as F

from skillspark.llm import simhash


def test_keys_of_few_fingerprints_are_shuffled(spark, monkeypatch):
    """4,000 fingerprints take 64 kB, their 140,000 keys some 50 times that."""
    monkeypatch.setattr(simhash, "cut", lambda df: df)
    fps = spark.range(4000).select(F.xxhash64("id").alias("fp"))
    met = simhash._met(fps, 3)
    rows = {(r.key, r.fp, r.stored) for r in met.collect()}
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    keys = {}
    for r in simhash._keys(fps).collect():
        keys.setdefault(r.key, []).append(r)
    want = {(r.key, r.fp, r.stored) for k in keys.values() for r in k if any(x.stored for x in k) and not all(x.stored for x in k) and (len(k) > 2 or sum(x.stored for x in k) == 1)}
    assert rows == want


def test_blocks_of_a_common_shingle_are_shuffled(spark, monkeypatch):
    """The last pairs of near_links are joined by a shuffle: rows are there once for each block, which Spark doesn't see."""
    monkeypatch.setattr(simhash, "BLOCK", 4)
    monkeypatch.setattr(simhash, "TURNS", 0)
    plans, few = [], simhash.Store.few

    def keep(self, df):
        out = few(self, df)
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return out

    monkeypatch.setattr(simhash.Store, "few", keep)
    docs = [(i, " ".join(f"common{j}" for j in range(12)) + " " + " ".join(uuid.UUID(int=100 * i + j).hex for j in range(6))) for i in range(40)]
    simhash.near_links(spark.createDataFrame(docs, "doc_id long, text string"))
    joined = [x for x in plans if "explode(sequence(" in x]
    assert "rightHint=(strategy=merge)" in joined[-1]  # the first is of the keys' blocks, which are grouped
