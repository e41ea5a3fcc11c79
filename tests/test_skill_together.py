"""Players side by side against one after the other, in small pieces of the stream."""

import random

import numpy as np
import pytest

from skillspark.operators import skill as S
from skillspark.taxonomy import ARMS, GENERAL


@pytest.mark.parametrize("buffer", [6, 20_000])
def test_players_side_by_side_equal_single_ones(spark, monkeypatch, buffer):
    rng = random.Random(3)
    rows = [(i, rng.randrange(5) if i % 2 else 9, i, rng.choice([*ARMS[:4], GENERAL]), rng.randrange(900, 2000), rng.random() < 0.5) for i in range(240)]
    attempts = spark.createDataFrame(rows, "attempt_id long, player_id long, ts int, category string, rating int, solved boolean")
    players = spark.createDataFrame([(k, 1300 + 50 * k) for k in range(3)], "player_id long, rating int")
    mine, said = {}, {}
    for i, who, _, category, rating, solved in rows:
        mine.setdefault(who, S.Skill(1300 + 50 * who if who < 3 else None))
        said[i] = mine[who].attempt(category, rating, solved)
    monkeypatch.setattr(S, "BUFFER", buffer)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(buffer, 10_000)))
    try:
        predicted, states = (x.collect() for x in S.fit_skill(attempts, players))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.attempt_id: r.predicted for r in predicted} == pytest.approx(said, rel=1e-9)
    assert {r.player_id: r.n for r in states} == {k: sum(r[1] == k for r in rows) for k in mine}
    for r in states:
        assert r.mean == pytest.approx(mine[r.player_id].mean.tolist(), abs=1e-12)
        assert r.cov == pytest.approx(mine[r.player_id].cov[np.triu_indices(len(ARMS) + 1)].tolist(), abs=1e-12)
