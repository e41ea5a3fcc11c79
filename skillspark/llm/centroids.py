"""Exact k-means over whole numbers with ns-bounds.

Each vector remembers, for every centroid, the exact squared distance of the round in which it was last worked out, and that
round. The centroids of all rounds are kept. A stored distance is loosened by the length of the centroid's whole
displacement since that round, |c(now) - c(then)|, which is never more than the sum of its moves round by round: back-and-forth moves cancel.
While the loosened bound of a vector's own centroid stays below those of all others it keeps its cluster unseen; where that fails, its own
distance is worked out exactly, then those of the centroids whose bound doesn't clear it.

Rounds are narrow passes: vectors never move. Only what changed its cluster is summed, exactly, so that what crosses the network in a round is a row
for each task, cluster and component. A round's rows are persisted and its predecessor's are let go; a lost executor's part is
worked out anew from its files by the same passes, as the centroids of each round are constants in them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, need

#: By this part a bound is loosened further, for the rounding of square roots.
SLACK = 1e-9
STATE = "id {id}, q binary, cluster int, was int, apart binary, seen binary"


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Binary values of one length as the rows of a matrix."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    width = rows.dtype.itemsize * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(rows)])


def _squared(q: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    d = q.astype(np.int64) - centroid
    return np.einsum("ij,ij->i", d, d)


def drifts(history: np.ndarray) -> np.ndarray:
    """[round, centroid]: the length of the displacement of each centroid since that round; history: [round, centroid, component]."""
    d = (history[-1][None] - history).astype(np.float64)
    return np.sqrt((d * d).sum(axis=2))


def reassigned(q: np.ndarray, cluster: np.ndarray | None, apart: np.ndarray | None, seen: np.ndarray | None, history: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(cluster, squared distances, the rounds that they are of, how many were worked out) after the last round of history.

    cluster: the former ones, with apart and seen as they were returned then; None at first.
    """
    now, k = len(history) - 1, history.shape[1]
    if cluster is None:
        apart = np.stack([_squared(q, c) for c in history[now]], axis=1)
        return apart.argmin(axis=1).astype(np.int32), apart, np.full(apart.shape, now, np.int16), apart.size
    apart, seen, cluster = apart.copy(), seen.copy(), cluster.astype(np.int64)
    drift, each, asked = drifts(history), np.arange(k), 0
    reach, moved = np.sqrt(apart.astype(np.float64)), drift[seen, each]
    low = (reach - moved) * (1 - SLACK) - SLACK * (reach + moved + 1)
    rows = np.arange(len(q))
    own = reach[rows, cluster] + moved[rows, cluster]
    own += SLACK * (own + 1)
    low[rows, cluster] = np.inf
    failed = np.flatnonzero(own >= low.min(axis=1))
    # First the distance to a vector's own centroid, then to those whose bound that doesn't clear.
    for j in range(k):
        at = failed[cluster[failed] == j]
        at = at[seen[at, j] != now]
        apart[at, j], seen[at, j] = _squared(q[at], history[now][j]), now
        asked += len(at)
    best, best_d = cluster.copy(), apart[rows, cluster].copy()
    bound = np.sqrt(best_d.astype(np.float64)) * (1 + SLACK) + SLACK
    for j in range(k):
        at = failed[(low[failed, j] <= bound[failed]) & (cluster[failed] != j)]
        new = at[seen[at, j] != now]
        apart[new, j], seen[new, j] = _squared(q[new], history[now][j]), now
        asked += len(new)
        d = apart[at, j]
        nearer = (d < best_d[at]) | (d == best_d[at]) & (j < best[at])
        best[at[nearer]], best_d[at[nearer]] = j, d[nearer]
    return best.astype(np.int32), apart, seen, asked


def _pass(history: np.ndarray, first: bool):
    """A round over rows (id, q) at first, and over the rows of the round before from then on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q = _matrix(batch.column("q"), "<i4")
                was = None if first else batch.column("cluster").to_numpy()
                state = (None, None) if first else (_matrix(batch.column("apart"), "<i8"), _matrix(batch.column("seen"), "<i2"))
                cluster, apart, seen, _ = reassigned(q, was, *state, history)
                was = pa.nulls(len(q), pa.int32()) if first else pa.array(was, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("q"), pa.array(cluster, pa.int32()), was, _binary(apart), _binary(seen)], names=["id", "q", "cluster", "was", "apart", "seen"])

    return run


def _summed(k: int, width: int):
    """(cluster, component, total) of what came to a cluster less what left it; the number of vectors is component -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, width + 1), object)
        for batch in batches:
            q, now, was = _matrix(batch.column("q"), "<i4").astype(np.int64), batch.column("cluster").to_numpy(), batch.column("was").fill_null(-1).to_numpy()
            for j in range(k):
                came, left = q[now == j], q[was == j]
                total[j, 0] += len(came) - len(left)
                total[j, 1:] += came.sum(axis=0) - left.sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(k), width + 1), pa.int32()), pa.array(np.tile(np.arange(-1, width), k), pa.int32()), pa.array([str(x) for x in total.ravel()])], names=["cluster", "component", "total"]
        )

    return run


def limit(dims: int) -> float:
    """Whole numbers beyond this count as this, so that squared distances fit a long: 2^27 for 64 components."""
    return float(int(2**30 / max(1, dims) ** 0.5))


def _numbers(df: DataFrame, id_col: str, vector_col: str, dims: int, scale: float) -> DataFrame:
    """(id, q) of the vectors that take part: floor(scale * x) as a binary of 32-bit numbers."""
    vector, most = F.col("vector"), limit(dims)
    good = (F.size(vector) == dims) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(vector, lambda x: F.floor(F.greatest(F.least(F.lit(scale) * x.cast("double"), F.lit(most)), F.lit(-most))).cast("int"))
    rows = need(df, id_col, vector_col).toDF("id", "vector").where(F.col("id").isNotNull() & vector.isNotNull() & good).select("id", whole.alias("q"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = batch.column("q").flatten().to_numpy().reshape(-1, dims).astype("<i4")
            yield pa.RecordBatch.from_arrays([batch.column("id"), _binary(q)], names=["id", "q"])

    return rows.mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, q binary")


def start(rows: DataFrame, k: int, seed: int, width: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of "seed:id", in that order; equal ids go by their bytes."""
    code = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.select("q", code.alias("code")).orderBy("code", "q").limit(k).select("q").collect()
    return np.array([np.frombuffer(r.q, "<i4") for r in first], np.int64).reshape(-1, width)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: float = 1024.0, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row for each vector with exactly `dims` components that are neither null nor non-finite.

    Components become floor(scale * x), at most `limit` (2^17 before scaling, for the values here); the first centroids are the vectors with the smallest sha256 of "seed:id". A round assigns every
    vector to the nearest centroid (squared distance, ties to the smaller number) and replaces each centroid that has vectors by floor(sum / count);
    after `rounds` of them vectors are assigned once more. All of it is exact, whatever the layout.

    Vectors that are null, empty, of another length or with bad components, and rows with a null id, take no part. Repeated rows each count and each have
    a row. With fewer than k vectors there are as many centroids. An empty table gives no rows; further columns, whatever their names, aren't read.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = _numbers(vectors, id_col, vector_col, dims, scale).persist(StorageLevel.MEMORY_AND_DISK)
    history = start(rows, k, seed, dims)[None]
    k = history.shape[1]
    if not k:
        rows.unpersist()
        return vectors.sparkSession.createDataFrame([], f"{id_col} {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    total = np.zeros((k, dims + 1), object)
    held = rows
    for t in range(rounds):
        step = held.mapInArrow(_pass(history, t == 0), STATE.format(id=kind)).persist(StorageLevel.MEMORY_AND_DISK)
        moved = step.where("was is null or was <> cluster").select("q", "cluster", "was").mapInArrow(_summed(k, dims), "cluster int, component int, total string")
        for r in moved.groupBy("cluster", "component").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():  # k * (dims + 1) rows
            total[r.cluster, r.component + 1] += int(r.total)
        held.unpersist()
        held = step
        now = history[-1].copy()
        for j in range(k):
            if total[j, 0]:
                now[j] = [x // total[j, 0] for x in total[j, 1:]]
        history = np.concatenate((history, now[None]))
    last = cut(held.mapInArrow(_final(history, not rounds), f"id {kind}, cluster int, distance long"))
    each = last.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # k rows
    held.unpersist()
    inertia = sum(r.cluster_inertia for r in each)
    code = F.create_map(*[F.lit(x) for j in range(k) for x in (j, ",".join(map(str, history[-1][j])))])[F.col("cluster")]
    own = F.create_map(*[F.lit(x) for r in each for x in (r.cluster, r.cluster_inertia)])[F.col("cluster")]
    return last.select(F.col("id").alias(id_col), "cluster", "distance", own.cast("long").alias("cluster_inertia"), F.lit(inertia).cast("long").alias("inertia"), F.sha2(code, 256).alias("centroid_sha256"))


def _final(history: np.ndarray, first: bool):
    """The last assignment, with the exact distance of each vector to its centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for big in batches for x in _pass(history, first)(iter([big]))):
            q, cluster = _matrix(batch.column("q"), "<i4").astype(np.int64), batch.column("cluster").to_numpy()
            d = q - history[-1][cluster]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("cluster"), pa.array(np.einsum("ij,ij->i", d, d), pa.int64())], names=["id", "cluster", "distance"])

    return run
