"""Exact inner-product search in buckets of vectors of like length.

Candidates are put into buckets by length (each bucket's shortest is at least LEVEL times its longest) and, where a bucket is
large, into blocks of bounded size. For a query with a lower bound theta of its k-th score, the local threshold in a block
with longest vector l is the cosine theta / (|q| l): above 1 the block has nothing, at or above COORDINATE the candidates are cut
to those whose largest coordinates can still reach the cosine, below it to those long enough. What is left is verified
with exact products. Lower bounds come from a first round against the blocks of longest vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, need

LEVEL, COORDINATE, FOCUS = 0.9, 0.35, 3
#: Vectors of a block, queries of a block, and blocks of vectors of a cell, on average.
BLOCK, QUERIES, CELL = 4096, 4096, 8
SALTS = 16


def quantised(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component as whole numbers; null for a vector that is null or has a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


def search_block(queries: np.ndarray, ids: np.ndarray, theta: np.ndarray, block: np.ndarray, block_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the query, id, score): of each query the best k of the block with scores of theta or more, ties to the smaller id."""
    norm = np.sqrt((block.astype(np.float64) ** 2).sum(axis=1))
    order = np.argsort(-norm, kind="stable")
    block, block_ids, norm = block[order], block_ids[order], norm[order]
    unit = block / np.maximum(norm, 1e-30)[:, None]
    # Sums of whole numbers below 2^53 are exact in doubles.
    exact = np.float64 if block.size == 0 or float(np.abs(block).max()) * float(np.abs(queries).max(initial=0)) * max(block.shape[1], 1) < 2.0**53 else object
    wide, slack = block.astype(exact), 1e-9
    by_coordinate = np.sort(unit, axis=0), np.argsort(unit, axis=0, kind="stable")
    out_q, out_id, out_score = [], [], []
    for j, q in enumerate(queries):
        length = float(np.sqrt((q.astype(np.float64) ** 2).sum()))
        left = np.arange(len(block))
        if np.isfinite(theta[j]) and length > 0 and len(block) and norm[0] > 0 and theta[j] > 0:
            cosine = theta[j] / (length * norm[0])
            if cosine > 1 + slack:
                continue
            # Only vectors of this length can reach theta at all.
            long = int(np.searchsorted(-norm, -(theta[j] / length) * (1 - slack), side="right"))
            left = left[:long]
            if cosine >= COORDINATE:
                u = q / length
                for f in np.argsort(-np.abs(u))[:FOCUS]:
                    # u_f p_f + sqrt(1 - u_f^2) sqrt(1 - p_f^2) >= cosine holds for p_f = cos(angle) within these angles only.
                    a, b = np.arccos(np.clip(u[f], -1, 1)), np.arccos(min(1.0, cosine))
                    low, high = np.cos(min(np.pi, a + b)) - slack, np.cos(max(0.0, a - b)) + slack
                    if f == np.argmax(np.abs(u)):
                        x, y = np.searchsorted(by_coordinate[0][:, f], (low, high))
                        found = np.sort(by_coordinate[1][x:y, f])
                        left = found[found < long]
                    else:
                        p = unit[left, f]
                        left = left[(p >= low) & (p <= high)]
        score = wide[left] @ q.astype(exact)
        good = (score >= theta[j]) & (block_ids[left] != ids[j])
        left, score = left[good], score[good]
        if len(left) > k:
            least = np.partition(score, len(score) - k)[len(score) - k]
            left, score = left[score >= least], score[score >= least]
        best = np.lexsort((block_ids[left], -score.astype(np.float64) if exact is not object else np.array([-x for x in score])))[:k]
        out_q += [j] * len(best)
        out_id += block_ids[left[best]].tolist()
        out_score += [int(x) for x in score[best]]
    return np.array(out_q, np.int64), np.array(out_id, np.int64), np.array(out_score, np.int64)


def _lists(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as a matrix."""
    rows = column.combine_chunks()
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def _cell(k: int):
    """The best k of a cell's candidates for each of its queries, bucket by bucket from the longest; what is found raises the bound for the next."""

    def run(key, queries: pa.Table, candidates: pa.Table) -> pa.Table:
        kept_q, kept_id, kept_score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if queries.num_rows and candidates.num_rows:
            ids, q, theta = queries.column("id").to_numpy(), _lists(queries.column("q")), queries.column("theta").to_numpy().copy()
            levels, vec_ids, vectors = candidates.column("level").to_numpy(), candidates.column("id").to_numpy(), _lists(candidates.column("q"))
            for level in np.unique(levels)[::-1]:
                here = levels == level
                found = search_block(q, ids, theta, vectors[here], vec_ids[here], k)
                kept_q, kept_id, kept_score = (np.r_[x, y] for x, y in zip((kept_q, kept_id, kept_score), found))
                order = np.lexsort((kept_id, -kept_score, kept_q))
                kept_q, kept_id, kept_score = kept_q[order], kept_id[order], kept_score[order]
                place = np.arange(len(kept_q)) - np.searchsorted(kept_q, kept_q)
                last = place == k - 1
                theta[kept_q[last]] = np.maximum(theta[kept_q[last]], kept_score[last])
                kept_q, kept_id, kept_score = kept_q[place < k], kept_id[place < k], kept_score[place < k]
            kept_q = ids[kept_q]
        return pa.table([pa.array(kept_q, pa.int64()), pa.array(kept_id, pa.int64()), pa.array(kept_score, pa.int64())], names=["query_id", "vec_id", "score"])

    return run


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, the k best of all other rows.

    Score: inner product of the quantised vectors; ties go to the smaller id. Vectors that are null or empty, or hold a null or non-finite
    component, and rows with a null id take no part; only vectors of the query's dimension are its candidates. Ids are
    taken as unique: of rows with one id each counts, and none is a candidate of a query with that id. An empty table gives no rows.

    A cell is a block of queries and a few blocks of candidates, each of bounded size. Which blocks can meet is settled on a row for each block; vectors then
    go to the cells by the numbers of their blocks, so that what is sent is a vector for each cell that it is in.
    """
    rows = need(vectors, id_col, vector_col).select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("q")).where("id is not null and size(q) > 0")
    norm = F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    rows = rows.select("id", "q", F.size("q").alias("dim"), norm.alias("norm"))
    # Levels of length: at most a few hundred for any finite vectors, however many rows there are.
    level = F.when(F.col("norm") > 0, F.floor(F.log(F.col("norm")) / F.lit(float(-np.log(LEVEL))))).otherwise(F.lit(-1)).cast("int")
    rows = rows.withColumn("level", level)
    sizes = rows.groupBy("dim", "level").agg(F.count("*").alias("n"))
    held = cut(rows.join(sizes, ["dim", "level"]).withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / block))).drop("n"))
    blocks = held.groupBy("dim", "level", "block").agg(F.max("norm").alias("longest"))
    many = blocks.groupBy("dim").agg(F.ceil(F.count("*") / CELL).alias("cells"))
    blocks = cut(blocks.join(many, "dim").withColumn("cell", F.pmod(F.xxhash64("level", "block"), "cells")))
    asked = held.where(F.col("id") % every == 0)
    counts = asked.groupBy("dim").agg(F.count("*").alias("n_queries"))
    asked = asked.join(counts, "dim").select("id", "q", "dim", "norm", F.pmod(F.xxhash64("id", F.lit(1)), F.ceil(F.col("n_queries") / queries)).alias("qb"))

    def searched(asked: DataFrame, pairs: DataFrame) -> DataFrame:
        """The best k of each query in each cell; asked (id, q, dim, qb, theta), pairs (dim, qb, level, block, cell)."""
        theirs = held.join(pairs, ["dim", "level", "block"]).select("dim", "qb", "cell", "level", "id", "q").toDF("dim", "qb", "cell", "level", "id", "q")
        ours = asked.join(pairs.select("dim", "qb", "cell").distinct(), ["dim", "qb"]).select("dim", "qb", "cell", "id", "q", "theta")
        cells = ours.groupBy("dim", "qb", "cell").cogroup(theirs.groupBy("dim", "qb", "cell"))
        return cells.applyInArrow(_cell(k), "query_id long, vec_id long, score long")

    # The k-th score against some candidates, those of the longest block, is a lower bound of the k-th against all.
    longest = blocks.groupBy("dim").agg(F.max_by(F.struct("level", "block", "cell"), F.struct("level", F.negative("block"))).alias("b"))
    first = longest.join(asked.select("dim", "qb").distinct(), "dim").select("dim", "qb", "b.*")
    bound = searched(asked.withColumn("theta", F.lit(float("-inf"))), first).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("bound"))
    asked = asked.join(bound, F.col("id") == F.col("query_id"), "left").withColumn("theta", F.coalesce(F.col("bound").cast("double"), F.lit(float("-inf")))).drop("query_id", "bound")
    asked = cut(asked)
    # A row for each block of queries meets a row for each block of candidates of its dimension, salted, as there may be one dimension only.
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    meta = asked.groupBy("dim", "qb").agg(F.max("norm").alias("reach"), F.min("theta").alias("least")).withColumn("salt", F.explode(salts))
    pairs = meta.join(blocks.withColumn("salt", F.pmod(F.xxhash64("level", "block"), F.lit(SALTS)).cast("int")), ["dim", "salt"])
    pairs = cut(pairs.where(F.col("reach") * F.col("longest") * (1 + 1e-9) >= F.col("least")).select("dim", "qb", "level", "block", "cell"))
    return _best(searched(asked, pairs), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
