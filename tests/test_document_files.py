"""Files of documents follow the entries in them, so that a reader's task holds a bounded part of the table."""

import os
from functools import partial

from skillspark.plans import source_queries as Q
from skillspark.plans.bindings import view
from skillspark.sources import readers


def test_files_grow_with_entries(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(Q, "ENTRIES", 100, raising=False)
    load = partial(view, spark, sf_dir)
    p, place = Q._cohort(load)
    assert len([f for f in os.listdir(place.removeprefix("file:")) if f.startswith("bucket=")]) > load("moves").count() // 200
    assert readers.cohort(spark, place).count() == p.where("critical").count()
    assert readers.cohort_errors(spark, place).count() == p.where("severity is not null").count()
