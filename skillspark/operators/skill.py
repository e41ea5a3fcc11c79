"""Skill models over attempts: a Gaussian state of ability and category offsets, selection and recommendation.

The updates of one player follow each other, and players are independent: attempts are dealt out by player, sorted, and streamed through a task that
holds the state of one player at a time, so that memory doesn't grow with a history.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.games import SCALE
from ..taxonomy import ARMS

THETA_SD, SEEDED_SD, DELTA_SD, PUZZLE_RD = 350 / SCALE, 250 / SCALE, 0.6, 75.0
DRIFT_THETA, DRIFT_DELTA = 0.02**2, 0.04**2
_PLACE = {c: i + 1 for i, c in enumerate(ARMS)}


def sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def shrink(variance: float) -> float:
    return 1 / math.sqrt(1 + 3 * variance / math.pi**2)


def symmetric(values: list[float], n: int) -> np.ndarray:
    """The matrix whose upper triangle, row by row, has these values."""
    out = np.zeros((n, n))
    out[np.triu_indices(n)] = values
    return out + np.triu(out, 1).T


class Skill:
    """Mean and covariance of [ability, offset of each arm], on the logit scale of ratings."""

    def __init__(self, rating: float | None = None, mean: np.ndarray | None = None, cov: np.ndarray | None = None) -> None:
        n = len(ARMS) + 1
        if mean is None:
            mean = np.zeros(n)
            sd = np.full(n, DELTA_SD)
            sd[0] = SEEDED_SD if rating else THETA_SD
            mean[0] = (rating - 1500) / SCALE if rating else 0.0
            cov = np.diag(sd**2)
        self.mean, self.cov = mean, cov
        self.drift = np.r_[DRIFT_THETA, np.full(n - 1, DRIFT_DELTA)]

    def attempt(self, category: str, rating: float, solved: bool, rd: float = PUZZLE_RD) -> float:
        """The probability of a solve before the result is seen; then the state takes the result in. Categories that aren't arms move ability alone."""
        at = _PLACE.get(category, 0)
        self.cov.ravel()[:: len(self.mean) + 1] += self.drift
        column = self.cov[0] + self.cov[at] if at else self.cov[0].copy()  # the covariance is symmetric
        q, noise = float(column[0] + column[at]) if at else float(column[0]), (rd / SCALE) ** 2
        z = float(self.mean[0] + self.mean[at] if at else self.mean[0]) - (rating - 1500) / SCALE
        predicted = sigmoid(shrink(q + noise) * z)
        k = shrink(noise)
        p = sigmoid(k * z)
        h = k * k * p * (1 - p)
        self.mean = self.mean + k * (float(solved) - p) / (1 + h * q) * column
        self.cov -= (h / (1 + h * q) * column)[:, None] * column
        return predicted


def together(mean: np.ndarray, cov: np.ndarray, arms: np.ndarray, z: np.ndarray, solved: np.ndarray, noise: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Predictions of the attempts of many players, a row after the other of each (length rows from first on), as Skill.attempt makes them; mean and cov, a row for each player, end as they are after the last.

    arms: places of categories, 0 where there is none; z: ratings on the scale of abilities; noise: squared deviations. The i-th attempts of all players are taken side by side.
    """
    n, out = mean.shape[1], np.zeros(len(arms))
    order = np.argsort(-length, kind="stable")
    first, length, m, c = first[order], length[order], mean[order], cov[order]
    drift = np.r_[DRIFT_THETA, np.full(n - 1, DRIFT_DELTA)]
    k = 1 / np.sqrt(1 + 3 * noise / math.pi**2)
    diagonal = c.reshape(len(c), n * n)[:, :: n + 1]
    for i in range(int(length.max(initial=0))):
        who = np.arange(int(np.searchsorted(-length, -i, side="left")))
        e, live = first[: len(who)] + i, len(who)
        a = arms[e]
        diagonal[:live] += drift
        column = c[:live, 0] + np.where((a > 0)[:, None], c[who, a], 0.0)
        q = column[:, 0] + np.where(a > 0, column[who, a], 0.0)
        w = m[:live, 0] + np.where(a > 0, m[who, a], 0.0) - z[e]
        out[e] = 1 / (1 + np.exp(-w / np.sqrt(1 + 3 * (q + noise[e]) / math.pi**2)))
        p = 1 / (1 + np.exp(-k[e] * w))
        h = k[e] ** 2 * p * (1 - p)
        m[:live] += (k[e] * (solved[e] - p) / (1 + h * q))[:, None] * column
        c[:live] -= ((h / (1 + h * q))[:, None] * column)[:, :, None] * column[:, None, :]
    mean[order], cov[order] = m, c
    return out


#: Attempts that a task holds at a time.
BUFFER = 20_000


def seeded(attempts: DataFrame, players: DataFrame | None, *columns: str, dealt: bool = True) -> DataFrame:
    """Attempts with the player's known rating as `seed`; dealt, those of a player are together and in order of time."""
    rows = attempts.select("player_id", "attempt_id", "ts", "rating", "solved", *columns)
    if players is None:
        rows = rows.withColumn("seed", F.lit(None).cast("double"))
    else:
        rows = rows.join(players.select("player_id", F.col("rating").cast("double").alias("seed")), "player_id", "left")
    return rows.repartition("player_id").sortWithinPartitions("player_id", "ts", "attempt_id") if dealt else rows


def buffers(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Batches joined to tables of `size` rows and more."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= size:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def fit_skill(attempts: DataFrame, players: DataFrame | None = None, states: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(attempt_id, player_id, predicted) of every attempt, and (player_id, mean, sd, cov, n) after the last one. Attempts may have a column rd of their puzzles' deviations.

    Players go on from their states (player_id, mean, cov, n; see operators.states), those without from their known rating in players. A player's state comes before the attempts in the stream, so that it is sent once;
    a player with a state and no attempts keeps it. cov is the upper triangle of the covariance, row by row.
    """
    n_dims = len(ARMS) + 1
    upper = np.triu_indices(n_dims)
    rd = ["rd"] if "rd" in attempts.columns else []
    rows = seeded(attempts, players, "category", *rd, dealt=False).withColumns({"kind": F.lit(1), "mean": F.lit(None).cast("array<double>"), "cov": F.lit(None).cast("array<double>"), "n": F.lit(0).cast("long")})
    if states is not None:
        rows = rows.unionByName(states.select("player_id", "mean", "cov", F.col("n").cast("long").alias("n"), F.lit(0).alias("kind")), allowMissingColumns=True)
    rows = rows.repartition("player_id").sortWithinPartitions("player_id", "kind", "ts", "attempt_id")

    size = BUFFER

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"attempt_id": pa.int64(), "player_id": pa.int64(), "predicted": pa.float64(), "mean": pa.list_(pa.float64()), "sd": pa.list_(pa.float64()), "cov": pa.list_(pa.float64()), "n": pa.int64()}
        frame = lambda size, **known: pa.RecordBatch.from_arrays([known[k] if k in known else pa.nulls(size, t) for k, t in kinds.items()], names=list(kinds))
        lists = lambda x: pa.array(list(x), pa.list_(pa.float64()))

        def ends(players: np.ndarray, mean: np.ndarray, cov: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            sd = np.sqrt(np.diagonal(cov, axis1=1, axis2=2))
            return frame(len(players), player_id=pa.array(players), mean=lists(mean), sd=lists(sd), cov=lists(cov[:, upper[0], upper[1]]), n=pa.array(n))

        last = None
        for table in buffers(batches, size):
            get = lambda c: table.column(c).to_numpy()
            player, kind = get("player_id"), get("kind")
            b = np.flatnonzero(np.r_[True, player[1:] != player[:-1]])
            stop = np.r_[b[1:], len(player)]
            begun = [Skill(x) if k else Skill(mean=np.array(m), cov=symmetric(c, n_dims)) for x, k, m, c in zip(*(table.column(c).take(pa.array(b)).to_pylist() for c in ("seed", "kind", "mean", "cov")))]
            mean, cov, n = np.stack([x.mean for x in begun]), np.stack([x.cov for x in begun]), get("n")[b].astype(np.int64)
            if last is not None:
                if last[0] == player[0]:  # the player goes on from the rows before
                    mean[0], cov[0], n[0] = last[1:]
                else:
                    yield ends(np.array([last[0]]), last[1][None], last[2][None], np.array([last[3]]))
            first = b + (kind[b] == 0)
            if any(table.column(c).filter(pa.array(kind == 1)).null_count for c in ("rating", "solved")):
                raise ValueError("an attempt has no rating or no result")
            arms = np.array([_PLACE.get(c, 0) for c in table.column("category").to_pylist()])
            dev = get("rd").astype(np.float64) if rd else np.full(len(player), PUZZLE_RD)
            solved = np.array([float(x or 0) for x in table.column("solved").to_pylist()])
            predicted = together(mean, cov, arms, (get("rating").astype(np.float64) - 1500) / SCALE, solved, (dev / SCALE) ** 2, first, stop - first)
            n += stop - first
            e = pa.array(kind == 1)
            yield from pa.Table.from_batches([frame(len(player), attempt_id=table.column("attempt_id").combine_chunks(), player_id=pa.array(player), predicted=pa.array(predicted))]).filter(e).to_batches()
            if len(b) > 1:
                yield ends(player[b[:-1]], mean[:-1], cov[:-1], n[:-1])
            last = player[-1], mean[-1], cov[-1], n[-1]
        if last is not None:
            yield ends(np.array([last[0]]), last[1][None], last[2][None], np.array([last[3]]))

    done = rows.mapInArrow(run, "attempt_id long, player_id long, predicted double, mean array<double>, sd array<double>, cov array<double>, n long")
    return done.where("mean is null").select("attempt_id", "player_id", "predicted"), done.where("mean is not null").select("player_id", "mean", "sd", "cov", "n")


def fit_ability(attempts: DataFrame) -> DataFrame:
    """(player_id, theta, variance): the model with ability alone."""
    k = shrink((PUZZLE_RD / SCALE) ** 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        player, m, v, out = None, 0.0, 0.0, []
        for batch in batches:
            for who, rating, solved in zip(*(batch.column(c).to_pylist() for c in ("player_id", "rating", "solved"))):
                if who != player:
                    if player is not None:
                        out.append((player, m, v))
                    player, m, v = who, 0.0, THETA_SD**2
                q = v + DRIFT_THETA
                p = sigmoid(k * (m - (rating - 1500) / SCALE))
                h = k * k * p * (1 - p)
                m, v = m + k * (float(solved) - p) / (1 + h * q) * q, q - h / (1 + h * q) * q * q
            if len(out) > 10_000:
                yield _columns(out)
                out = []
        yield _columns(out + ([(player, m, v)] if player is not None else []))

    def _columns(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate((pa.int64(), pa.float64(), pa.float64()))], names=["player_id", "theta", "variance"])

    return seeded(attempts, None).mapInArrow(run, "player_id long, theta double, variance double")
