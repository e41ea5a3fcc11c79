"""The online side: attempts as a stream, with incremental posteriors, first sights, joins, servings that are used once, and skill states in order of time."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.serving import PENDING, Pending, events
from ..operators.skill import Skill, fit_skill, symmetric
from ..taxonomy import ARMS

SCHEMA = "attempt_id long, player_id long, ts timestamp, puzzle_id string, category string, rating int, solved boolean, skipped boolean"


def read(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(path)


def beta(attempts: DataFrame) -> DataFrame:
    """Solves and failures of each player and arm so far (update or complete mode)."""
    known = attempts.where(F.col("category").isin(*ARMS) & ~F.coalesce("skipped", F.lit(False)))
    return known.groupBy("player_id", "category").agg((1 + F.sum(F.col("solved").cast("long"))).alias("alpha"), (1 + F.sum((~F.col("solved")).cast("long"))).alias("beta"))


def first_seen(attempts: DataFrame, watermark: str = "365 days") -> DataFrame:
    """The first attempt of each player and puzzle within the watermark."""
    return attempts.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["player_id", "puzzle_id"])


def served_join(served: DataFrame, results: DataFrame, within: str = "1 hour", watermark: str = "2 hours") -> DataFrame:
    """Results with their serving, if it was at most `within` before; a result without one comes out when the watermark has passed it."""
    a = results.withWatermark("ts", watermark).alias("a")
    b = served.select("serve_id", F.col("player_id").alias("s_player"), F.col("puzzle_id").alias("s_puzzle"), F.col("ts").alias("served_ts")).withWatermark("served_ts", watermark).alias("b")
    on = (F.col("player_id") == F.col("s_player")) & (F.col("puzzle_id") == F.col("s_puzzle")) & (F.col("served_ts") <= F.col("ts")) & (F.col("served_ts") >= F.col("ts") - F.expr(f"interval {within}"))
    return a.join(b, on, "left").select("attempt_id", "player_id", "puzzle_id", "serve_id")


class _Served(StatefulProcessor):
    """A player's open servings, the oldest first, and the time of the player's one timer, which frees those that no result can use any more.

    Each call to the state store or for a timer costs a message: a batch of a player reads the state once and writes it once. A timer stays until it fires, which is at most too early, and is then set anew.
    """

    def __init__(self, pending: int, within: int) -> None:
        self.pending, self.within = pending, within

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("open", "puzzle_id array<string>, serve_id array<long>, at array<long>, timer long")

    def _get(self) -> tuple[Pending, int | None]:
        held = self.held.get()
        return Pending(self.pending, self.within, zip(*held[:3]) if held else ()), held[3] if held else None

    def _put(self, open_: Pending, timer: int | None) -> None:
        if open_.open:
            due = min(at for _, at in open_.open.values()) // 1000 + self.within // 1000 + 1
            if timer is None or due < timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(due)
                timer = due
        if open_.open or timer is not None:
            serve_id, at = zip(*open_.open.values()) if open_.open else ((), ())
            self.held.update((list(open_.open), list(serve_id), list(at), timer))
        else:
            self.held.clear()

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        open_, timer = self._get()
        out = []
        for at, is_result, id_, puzzle in sorted((r.at, r.is_result, r.id, r.puzzle_id) for r in rows):
            if is_result:
                out.append(Row(attempt_id=id_, player_id=key[0], puzzle_id=puzzle, serve_id=open_.take(puzzle, at)))
            else:
                open_.serve(puzzle, id_, at)
        self._put(open_, timer)
        return iter(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        open_, _ = self._get()
        open_.expire(timerValues.getCurrentWatermarkInMs() * 1000)
        self._put(open_, None)
        return iter([])

    def close(self) -> None:
        pass


def served_once(served: DataFrame, results: DataFrame, pending: int = PENDING, within_seconds: float = 3600.0, watermark: str = "2 hours") -> DataFrame:
    """The stream of operators.serving.served_once: (attempt_id, player_id, puzzle_id, serve_id), in the order of arrival, by time within a batch; needs the RocksDB state store."""
    rows = events(served, results).where("player_id is not null and puzzle_id is not null and ts is not null").withColumn("at", F.unix_micros("ts")).withWatermark("ts", watermark)
    return rows.groupBy("player_id").transformWithState(_Served(pending, int(within_seconds * 1e6)), "attempt_id long, player_id long, puzzle_id string, serve_id long", "append", "EventTime")


_HELD = "arms string, state array<double>, current int, best int"
_ARMS = "/".join(ARMS)


class _SkillProcessor(StatefulProcessor):
    """State of a player: the arms' names, and mean and covariance as one array; streaks beside it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("skill", _HELD)

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        row = initialState.iloc[0]
        self.state.update((_ARMS, np.r_[row["mean"], symmetric(row["cov"], len(ARMS) + 1).ravel()].tolist(), 0, 0))

    def _advance(self, attempts: list[tuple[str, float, bool]]) -> tuple[list[float], int, int]:
        """Predictions of attempts in order (category, rating, solved), and the streaks after them."""
        n = len(ARMS) + 1
        skill, current, best = Skill(), 0, 0
        if self.state.exists():
            held = self.state.get()
            if held[0] == _ARMS:  # another list of arms starts afresh
                x = np.array(held[1])
                skill, current, best = Skill(mean=x[:n], cov=x[n:].reshape(n, n)), held[2], held[3]
        predicted = []
        for category, rating, solved in attempts:
            predicted.append(skill.attempt(category, rating, solved))
            if category in ARMS:
                current = current + 1 if solved else 0
                best = max(best, current)
        self.state.update((_ARMS, np.r_[skill.mean, skill.cov.ravel()].tolist(), current, best))
        return predicted, current, best

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["ts", "attempt_id"])
        predicted, current, best = self._advance(list(zip(pdf["category"], pdf["rating"], pdf["solved"])))
        yield pd.DataFrame({"attempt_id": pdf["attempt_id"], "player_id": key[0], "predicted": predicted, "best": best, "current": current})

    def close(self) -> None:
        pass


def skill(attempts: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """A prediction for each attempt before its result is taken in, and the player's streaks after the batch; needs the RocksDB state store.

    Players begin with their states (player_id, mean, cov; see operators.states: stored ones, or priors from known ratings and arms), if there are any.
    """
    held = states.select("player_id", "mean", "cov").groupBy("player_id") if states is not None else None
    return attempts.groupBy("player_id").transformWithStateInPandas(_SkillProcessor(), "attempt_id long, player_id long, predicted double, best int, current int", "append", "None", held)


class _Streaks(StatefulProcessor):
    """A player's streak and the longest one; an attempt of another category than the arms leaves both."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("streaks", "current int, best int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        current, best = held if held is not None else (0, 0)
        parts = [(x["ts"].to_numpy(), x["attempt_id"].to_numpy(), x["solved"].to_numpy()) for x in rows]
        ts, ids, solved = (np.concatenate(c) for c in zip(*parts))
        for hit in solved[np.lexsort((ids, ts))].tolist():
            current = current + 1 if hit else 0
            best = max(best, current)
        self.state.update((current, best))
        yield pd.DataFrame({"player_id": [key[0]], "current": [current], "best": [best]})

    def close(self) -> None:
        pass


def streaks(attempts: DataFrame) -> DataFrame:
    """(player_id, current, best) of each player of a batch after it: solves in a row now and at most, over attempts of the arms; needs the RocksDB state store."""
    known = attempts.where(F.col("category").isin(*ARMS)).select("player_id", "ts", "attempt_id", "solved")
    return known.groupBy("player_id").transformWithStateInPandas(_Streaks(), "player_id long, current int, best int", "append", "None")


class _OrderedSkill(_SkillProcessor):
    """Attempts wait until the watermark has passed them and then go in order of time; those that come after it are late."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, attempt_id long, category string, rating int, solved boolean")

    def _wait(self, rows: list[tuple]) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if rows:
            self.waiting.put(rows)
            self.handle.registerTimer(max(1, min(r[0] for r in rows) // 1000 + 1))
        else:
            self.waiting.clear()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        new = [(int(r[0]), int(r[1]), r[2], int(r[3]), bool(r[4])) for r in pd.concat(list(rows))[["at", "attempt_id", "category", "rating", "solved"]].itertuples(index=False)]
        late = [r for r in new if r[0] < passed]
        if len(late) < len(new):
            self._wait([*(tuple(x) for x in (self.waiting.get() if self.waiting.exists() else ())), *(r for r in new if r[0] >= passed)])
        yield pd.DataFrame({"kind": "late", "attempt_id": [r[1] for r in late], "player_id": key[0], "predicted": np.nan})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((tuple(x) for x in self.waiting.get()), key=lambda r: r[:2])
        due = [r for r in rows if r[0] < passed]
        self._wait([r for r in rows if r[0] >= passed])
        predicted, _, _ = self._advance([r[2:] for r in due])
        yield pd.DataFrame({"kind": "predicted", "attempt_id": [r[1] for r in due], "player_id": key[0], "predicted": predicted})


def ordered_skill(attempts: DataFrame, delay: str = "1 day", states: DataFrame | None = None) -> DataFrame:
    """(kind, attempt_id, player_id, predicted): predictions in order of time whatever the order of arrival, for attempts that come at most `delay` after a later one has been seen.

    An attempt waits in the player's state until the watermark has passed it. One that comes after that has kind `late` and moves no state: its player is to be fitted again (see refit).
    """
    rows = attempts.where("player_id is not null and ts is not null and rating is not null and solved is not null").withWatermark("ts", delay)
    # The operator itself tells late rows apart: of a column with a watermark Spark would drop them.
    rows = rows.select("player_id", "attempt_id", "category", "rating", "solved", F.unix_micros("ts").alias("at"))
    held = states.select("player_id", "mean", "cov").groupBy("player_id") if states is not None else None
    return rows.groupBy("player_id").transformWithStateInPandas(_OrderedSkill(), "kind string, attempt_id long, player_id long, predicted double", "append", "EventTime", held)


def refit(said: DataFrame, log: DataFrame, states: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Predictions and states of the players with late attempts (said: what ordered_skill has written), from their whole log in order."""
    players = said.where("kind = 'late'").select("player_id").distinct()
    begun = states.join(players, "player_id", "left_semi") if states is not None else None
    return fit_skill(log.join(players, "player_id", "left_semi"), None, begun)
