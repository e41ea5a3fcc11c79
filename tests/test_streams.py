"""Streams with state against their batch twins: seeds and priors, servings that are used once, late attempts."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from skillspark.operators import serving as SV
from skillspark.operators import skill as S
from skillspark.operators import states as ST
from skillspark.plans.bindings import view
from skillspark.streaming import attempts as X

pytest.importorskip("google.protobuf")
ZERO = datetime.datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def written(parts, path):
    """Each part as a file, in this order."""
    import os
    import time

    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(path)
        for name in os.listdir(path):
            if name.endswith(".parquet") and not os.path.exists(f"{path}/.{name}.at"):
                os.utime(f"{path}/{name}", (time.time() - 1000 + i * 10,) * 2)
                open(f"{path}/.{name}.at", "w").close()
    return path


def run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name)


@pytest.fixture(scope="module")
def log(spark, sf_dir):
    a = view(spark, sf_dir, "attempts").where("not skipped and player_id % 3 = 0").withColumn("ts", F.col("ts").cast("timestamp"))
    return a.select("attempt_id", "player_id", "ts", "puzzle_id", "category", "rating", "solved", "skipped").cache()


def test_skills_begin_with_stored_states_and_priors(spark, log, tmp_path):
    """Some players have a stored state, some a known rating and arms, some neither."""
    players = log.select("player_id").distinct().withColumn("rating", F.when(F.col("player_id") % 2 == 0, 1800))
    offsets = players.select("player_id", F.lit("Fork").alias("category"), F.lit(0.5).alias("mean"), F.lit(0.2).alias("sd"))
    stored = ST.snapshot(S.fit_skill(log.where("player_id % 4 = 1"))[1])
    states = ST.restore(stored, players, offsets).where("player_id % 5 <> 0")
    middle = log.agg(F.percentile_approx("ts", 0.5)).first()[0]
    path = written([log.where(F.col("ts") < middle), log.where(F.col("ts") >= middle)], str(tmp_path / "a"))
    got = {r.attempt_id: r.predicted for r in run(X.skill(X.read(spark, path), states), "seeded").collect()}
    want = {r.attempt_id: r.predicted for r in S.fit_skill(log, None, states)[0].collect()}
    assert got == pytest.approx(want)


SERVED, RESULT = "serve_id long, player_id long, puzzle_id string, ts timestamp", "attempt_id long, player_id long, puzzle_id string, ts timestamp"


def plain_servings(served, results, most, within):
    rows = sorted([(ts, 0, i, p, q) for i, p, q, ts in served] + [(ts, 1, i, p, q) for i, p, q, ts in results])
    open_, out = {}, {}
    for ts, is_result, i, p, q in rows:
        mine = open_.setdefault(p, {})
        for k in [k for k, (_, t) in mine.items() if within is not None and (ts - t).total_seconds() > within]:
            del mine[k]
        if is_result:
            out[i] = mine.pop(q, (None, None))[0]
        else:
            mine[q] = (i, ts)
            while len(mine) > most:
                del mine[next(iter(mine))]
    return out


def servings(seed, n=300):
    rng = random.Random(seed)
    t = [ZERO + datetime.timedelta(minutes=rng.randrange(600)) for _ in range(2 * n)]
    row = lambda i: (i, rng.randrange(3), f"p{rng.randrange(25)}", t[i])
    return [row(i) for i in range(n)], [row(i) for i in range(n, 2 * n)]


@pytest.mark.parametrize("most,within", [(50, None), (4, None), (50, 1800.0), (3, 3600.0)])
def test_a_serving_is_used_once(spark, most, within):
    served, results = servings(most)
    got = SV.served_once(spark.createDataFrame(served, SERVED), spark.createDataFrame(results, RESULT), most, within).collect()
    assert {r.attempt_id: r.serve_id for r in got} == plain_servings(served, results, most, within)
    used = [r.serve_id for r in got if r.serve_id is not None]
    assert used and len(used) == len(set(used))


def test_servings_of_odd_tables(spark):
    s, r = spark.createDataFrame([(1, 1, "a", ZERO), (2, None, "a", ZERO), (3, 1, None, ZERO), (4, 1, "a", None)], SERVED), spark.createDataFrame([(5, 1, "a", ZERO), (6, 1, "a", ZERO), (7, None, "a", ZERO)], RESULT)
    assert sorted((x.attempt_id, x.serve_id) for x in SV.served_once(s, r).collect()) == [(5, 1), (6, None)]
    assert SV.served_once(s.limit(0), r.limit(0)).collect() == []


def test_stream_of_servings_equals_batch(spark, tmp_path):
    served, results = servings(9)
    cuts = [ZERO + datetime.timedelta(minutes=m) for m in (0, 150, 300, 450, 600)]
    parts = lambda rows, schema, name: written([spark.createDataFrame([r for r in rows if a <= r[3] < b], schema) for a, b in zip(cuts, cuts[1:])], str(tmp_path / name))
    s, r = parts(served, SERVED, "s"), parts(results, RESULT, "r")
    read = lambda schema, path: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = {x.attempt_id: x.serve_id for x in run(X.served_once(read(SERVED, s), read(RESULT, r), 4, 3600.0, "10 minutes"), "once").collect()}
    assert got == plain_servings(served, results, 4, 3600.0)


def test_attempts_out_of_order_and_late_ones(spark, log, tmp_path):
    """Within the delay the order of arrival doesn't matter; a player with an attempt beyond it is fitted again."""
    rng = random.Random(3)
    rows = [tuple(r) for r in log.orderBy("attempt_id").limit(240).collect()]
    rows = [(r[0], r[1], ZERO + datetime.timedelta(minutes=10 * i), *r[3:]) for i, r in enumerate(rows)]
    order = sorted(range(len(rows)), key=lambda i: i + rng.uniform(0, 30))  # at most 30 places, or 300 minutes, too late
    behind = order.pop(order.index(20))  # this one comes after all others
    end = (10**9, -1, ZERO + datetime.timedelta(days=400), "p", "Fork", 1500, True, False)
    shuffled = [rows[i] for i in order]
    parts = [*(shuffled[i : i + 40] for i in range(0, len(shuffled), 40)), [end], [rows[behind], (10**9 + 1, -1, end[2] + datetime.timedelta(days=1), *end[3:])]]
    path = written([spark.createDataFrame(p, log.schema) for p in parts], str(tmp_path / "late"))
    said = run(X.ordered_skill(X.read(spark, path), "400 minutes"), "late").where("player_id >= 0")
    got = {r.attempt_id: r.predicted for r in said.where("kind = 'predicted'").collect()}
    late = said.where("kind = 'late'").collect()
    assert [r.attempt_id for r in late] == [rows[behind][0]]
    whole = spark.createDataFrame(rows, log.schema)
    want = {r.attempt_id: r.predicted for r in S.fit_skill(whole.where(F.col("attempt_id") != rows[behind][0]))[0].collect()}
    assert got == pytest.approx(want)
    again, states = X.refit(said, whole)
    ids = {r[0] for r in rows if r[1] == rows[behind][1]}
    full = {r.attempt_id: r.predicted for r in S.fit_skill(whole)[0].collect()}
    assert {r.attempt_id: r.predicted for r in again.collect()} == pytest.approx({k: full[k] for k in ids})
    assert [r.player_id for r in states.collect()] == [rows[behind][1]]
