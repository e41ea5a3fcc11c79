"""Registration of queries with their SQL, and all of them together."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from .bindings import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, views: tuple[str, ...] = ()):
    """Registers a function of a view loader under its name, with SQL over the same views."""

    def register(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        name = f.__name__
        if name in QUERIES:
            raise ValueError(f"{name} is registered already")
        QUERIES[name] = lambda spark, sf_dir: f(partial(view, spark, sf_dir))
        if oracle:
            ORACLES[name] = with_views(views, oracle)
        return f

    return register
