"""Learned models read a stored table in each fit, not the joins that made it."""

from functools import partial

import pytest

from skillspark.operators.store import Store
from skillspark.plans import report_queries as Q
from skillspark.plans.bindings import view


def _stored(spark, sf_dir, monkeypatch, name):
    count, put = [], Store.put
    monkeypatch.setattr(Store, "put", lambda self, df: (count.append(1), put(self, df))[1])
    assert getattr(Q, name)(partial(view, spark, sf_dir)).collect()
    return len(count)


@pytest.mark.parametrize("name", ["l10_human_difficulty", "l9_weakness_forest"])
def test_inputs_are_stored(spark, sf_dir, monkeypatch, name):
    assert _stored(spark, sf_dir, monkeypatch, name) > 0
