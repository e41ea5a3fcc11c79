"""Large components: games side by side, and how often a slice is written."""

import random

import numpy as np
import pytest

from skillspark.operators import ratings as RT
from skillspark.operators.store import Store
from tests.test_ratings import SCHEMA, log, plain


def test_games_side_by_side_equal_single_games():
    rng = random.Random(5)
    rows = [(rng.uniform(-3, 3), rng.uniform(0.2, 2.0), rng.uniform(0.02, 0.2), rng.uniform(-3, 3), rng.uniform(0.2, 2.0), float(rng.random() < 0.5)) for _ in range(500)]
    got = np.stack(RT.games(*map(np.array, zip(*rows))), axis=1)
    assert got == pytest.approx(np.array([RT.one_game(*r) for r in rows]), rel=1e-9)


@pytest.mark.parametrize("buffer", [7, 100_000])
def test_a_slice_is_written_every_few_rounds(spark, monkeypatch, buffer):
    """Each round was a job that wrote all rows with both sides' states."""
    count, put = [], Store.put
    monkeypatch.setattr(Store, "put", lambda self, df: (count.append(df.columns), put(self, df))[1])
    monkeypatch.setattr(RT, "BUFFER", buffer)
    if buffer < 100:
        monkeypatch.setattr(RT, "FEW", 3)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    rows = log(3, 40, 6, 400, 1)
    said, states = plain(rows, {})
    try:
        got, ends = RT.glicko2_symmetric(spark.createDataFrame(rows, SCHEMA), most=10)
        assert {r.attempt_id: r.predicted for r in got.collect()} == pytest.approx(said, abs=1e-6)
        found = {(r.side, r.id): (r.rating, r.rd, r.volatility) for r in ends.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found.keys() == states.keys() and all(found[k] == pytest.approx(x, abs=1e-3) for k, x in states.items())
    assert sum("change" in c for c in count) <= 4
