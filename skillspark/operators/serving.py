"""Servings of puzzles and the results that use them, each serving once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Servings that a player can have open at most.
PENDING = 50


class Pending:
    """A player's open servings, the oldest first: puzzle -> (serving, microsecond). A puzzle that is served again keeps its place."""

    def __init__(self, most: int = PENDING, within: int | None = None, held: Iterator[tuple[str, int, int]] = ()) -> None:
        self.most, self.within = most, within
        self.open = {puzzle: (serving, at) for puzzle, serving, at in held}

    def expire(self, now: int) -> None:
        """Servings of more than `within` microseconds ago go."""
        if self.within is not None:
            self.open = {k: x for k, x in self.open.items() if x[1] >= now - self.within}

    def serve(self, puzzle: str, serving: int, at: int) -> None:
        self.expire(at)
        self.open[puzzle] = (serving, at)
        while len(self.open) > self.most:
            del self.open[next(iter(self.open))]

    def take(self, puzzle: str, at: int) -> int | None:
        """The serving that a result uses up."""
        self.expire(at)
        return self.open.pop(puzzle, (None, 0))[0]


def events(served: DataFrame, results: DataFrame) -> DataFrame:
    """(player_id, puzzle_id, ts, is_result, id): servings (serve_id, player_id, puzzle_id, ts) and results (attempt_id, ...) as one table."""
    row = lambda df, kind, c: df.select("player_id", "puzzle_id", "ts", F.lit(kind).alias("is_result"), F.col(c).cast("long").alias("id"))
    return row(served, 0, "serve_id").unionByName(row(results, 1, "attempt_id"))


def served_once(served: DataFrame, results: DataFrame, pending: int = PENDING, within_seconds: float | None = None) -> DataFrame:
    """(attempt_id, player_id, puzzle_id, serve_id) of each result: the open serving of its puzzle to the player, null where there is none.

    In order of time, a serving before a result of the same time. A result uses its serving up; of over `pending` open servings the oldest go; one that is older than within_seconds is no longer open. Players' events are
    dealt out by player, sorted and streamed through a task that holds the open servings of one player.
    """
    within = None if within_seconds is None else int(within_seconds * 1e6)
    rows = events(served, results).where("player_id is not null and puzzle_id is not null and ts is not null").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))).drop("ts")
    rows = rows.repartition("player_id").sortWithinPartitions("player_id", "at", "is_result", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        player, held = None, Pending(pending, within)
        for batch in batches:
            out = []
            for who, puzzle, is_result, key, at in zip(*(batch.column(c).to_pylist() for c in ("player_id", "puzzle_id", "is_result", "id", "at"))):
                if who != player:
                    player, held = who, Pending(pending, within)
                if is_result:
                    out.append((key, who, puzzle, held.take(puzzle, at)))
                else:
                    held.serve(puzzle, key, at)
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64()))], names=["attempt_id", "player_id", "puzzle_id", "serve_id"])

    return rows.mapInArrow(run, "attempt_id long, player_id long, puzzle_id string, serve_id long")
