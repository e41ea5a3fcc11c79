"""Connected components of a graph in a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Store


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of edges (a, b, both long) reaches. Loops and repeated edges change nothing.

    Each node is hung to the smallest of its neighbours, first those above it, then those below (large and small stars), until a round changes nothing.
    """
    store = Store(edges.sparkSession)
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    links, path, n = store.few(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = lambda e, n: (n, e.agg(F.expr("bit_xor(xxhash64(u, v))")).first()[0])
    before = state(links, n)
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        above = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = above.groupBy("u").agg(F.min("v").alias("m"))
        below = above.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links, new, n = store.few(below.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        store.discard(path)
        now, path = state(links, n), new
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    return nodes.join(links.toDF("node", "root"), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
