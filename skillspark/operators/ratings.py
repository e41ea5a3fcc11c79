"""Glicko-2: periods of many results in Catalyst, and replays of single attempts.

A replay with a frozen pool keeps players apart. A symmetric one rates puzzles too, and so ties players together: small components of the graph of players and puzzles are
replayed each in order; a large one in slices of time, in which all players and then all puzzles are replayed side by side until nothing changes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .skill import buffers, seeded, shrink, sigmoid
from .store import Store

TAU, GLICKO_SCALE, VOLATILITY = 0.5, 173.7178, 0.06
#: Deviations at first: of players without and with a known rating, of puzzles of the pool where it is frozen and where it isn't, and of mined ones.
NEW_RD, SEEDED_RD, POOL_RD, PUZZLE_RD, MINED_RD = 350.0, 200.0, 75.0, 200.0, 300.0
State = tuple[float, float, float]


def volatility(square: float, phi: float, v: float, sigma: float) -> float:
    """The new volatility: the root of the period's likelihood in log variance. square: that of the improvement delta.

    The likelihood's slope has its root between start - tau^2 / 2 and start + tau^2 square / (8 (phi^2 + v)); Newton's steps are kept within what is known to hold it.
    """
    start, d, t = 2 * math.log(sigma), phi * phi + v, TAU * TAU
    room = square - d
    low, high, x = start - t / 2, start, start
    if room > 0:
        high = start + min(t * square / (8 * d), max(0.0, math.log(room) - start))
    for _ in range(100):
        e = math.exp(x)
        s = d + e
        slope = e * (square - s) / (2 * s * s) - (x - start) / t
        if slope > 0:
            low = x
        else:
            high = x
        bend = e * (square * (d - e) - d * s) / (2 * s * s * s) - 1 / t
        new = x - slope / bend if bend < 0 else low - 1
        if not low <= new <= high:
            new = (low + high) / 2
        if abs(new - x) < 1e-13:
            break
        x = new
    return math.exp(x / 2)


def one_game(mu: float, phi: float, sigma: float, mu_j: float, phi_j: float, score: float) -> State:
    """A rating (centre, deviation, volatility) after a period of one game."""
    g = shrink(phi_j * phi_j)
    e = sigmoid(g * (mu - mu_j))
    info = max(g * g * e * (1 - e), 1e-12)
    sigma = volatility((g * (score - e) / info) ** 2, phi, 1 / info, sigma)
    phi = 1 / math.sqrt(1 / (phi * phi + sigma * sigma) + info)
    return mu + phi * phi * g * (score - e), phi, sigma


def _volatility(square: Column, phi: Column, v: Column, sigma: Column, steps: int = 60) -> Column:
    """`volatility` by halving, as an expression."""
    start, d, t = 2 * F.log(sigma), phi * phi + v, TAU * TAU
    high = F.when(square > d, start + F.least(t * square / (8 * d), F.greatest(F.lit(0.0), F.log(square - d) - start))).otherwise(start)

    def halved(x: Column, _: Column) -> Column:
        middle = (x["low"] + x["high"]) / 2
        e = F.exp(middle)
        up = e * (square - d - e) / (2 * (d + e) * (d + e)) - (middle - start) / t > 0
        return F.struct(F.when(up, middle).otherwise(x["low"]).alias("low"), F.when(up, x["high"]).otherwise(middle).alias("high"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct((start - t / 2).alias("low"), high.alias("high")), halved)
    return F.exp((found["low"] + found["high"]) / 4)


def glicko2_period(entities: DataFrame, results: DataFrame) -> DataFrame:
    """New rating, deviation and volatility of every entity (id, rating, rd, volatility) after results (id, opponent_rating, opponent_rd, score).

    An entity's results are summed, partly before they are sent; what follows is an expression over a row for each entity. Without results the deviation grows.
    """
    mine = entities.select("id", ((F.col("rating") - 1500) / GLICKO_SCALE).alias("mu"), (F.col("rd") / GLICKO_SCALE).alias("phi"), F.col("volatility").alias("sigma"))
    phi_j, mu_j = F.col("opponent_rd") / GLICKO_SCALE, (F.col("opponent_rating") - 1500) / GLICKO_SCALE
    g = 1 / F.sqrt(1 + 3 * phi_j**2 / math.pi**2)
    games = results.join(mine.select("id", "mu"), "id").withColumns({"g": g, "e": 1 / (1 + F.exp(-g * (F.col("mu") - mu_j)))})
    sums = games.groupBy("id").agg(F.sum(F.col("g") ** 2 * F.col("e") * (1 - F.col("e"))).alias("information"), F.sum(F.col("g") * (F.col("score") - F.col("e"))).alias("surprise"))
    rows = mine.join(sums, "id", "left").withColumn("v", F.when(F.col("information") > 0, 1 / F.col("information")))
    new = F.when(F.col("v").isNotNull(), _volatility((F.col("v") * F.col("surprise")) ** 2, F.col("phi"), F.col("v"), F.col("sigma"))).otherwise(F.col("sigma"))
    rows = rows.withColumn("new", new).withColumn("wide", F.col("phi") ** 2 + F.col("new") ** 2)
    rows = rows.withColumn("phi2", 1 / (1 / F.col("wide") + F.coalesce("information", F.lit(0.0))))
    mu = F.col("mu") + F.when(F.col("v").isNotNull(), F.col("phi2") * F.col("surprise")).otherwise(0.0)
    return rows.select("id", (1500 + GLICKO_SCALE * mu).alias("rating"), (GLICKO_SCALE * F.sqrt("phi2")).alias("rd"), F.col("new").alias("volatility"))


def glicko2_replay(attempts: DataFrame, seeds: DataFrame | None = None, pool_rd: float = POOL_RD, mined_rd: float = MINED_RD, mined: str = "gen_") -> DataFrame:
    """(attempt_id, player_id, predicted): one period an attempt in time order, with the probability before the result is seen.

    Puzzles of the pool keep their ratings. Those mined from the player's own games (ids that begin with `mined`) begin at mined_rd and are rated with the
    player, by the player's attempts; so players are independent.
    """
    rows = seeded(attempts, seeds, "puzzle_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        player, me, own = None, None, {}
        for batch in batches:
            columns, out = batch.to_pydict(), []
            for who, puzzle, rating, solved, seed in zip(*(columns[c] for c in ("player_id", "puzzle_id", "rating", "solved", "seed"))):
                if who != player:
                    player, own = who, {}
                    me = (0.0, NEW_RD / GLICKO_SCALE, VOLATILITY) if seed is None else ((seed - 1500) / GLICKO_SCALE, SEEDED_RD / GLICKO_SCALE, VOLATILITY)
                is_own = puzzle.startswith(mined)
                other = own.get(puzzle) or ((rating - 1500) / GLICKO_SCALE, (mined_rd if is_own else pool_rd) / GLICKO_SCALE, VOLATILITY)
                out.append(sigmoid(shrink(other[1] ** 2) * (me[0] - other[0])))
                before = me
                me = one_game(*me, *other[:2], float(solved))
                if is_own:
                    own[puzzle] = one_game(*other, *before[:2], 1.0 - float(solved))
            yield pa.RecordBatch.from_arrays([batch.column("attempt_id"), batch.column("player_id"), pa.array(out, pa.float64())], names=["attempt_id", "player_id", "predicted"])

    return rows.mapInArrow(run, "attempt_id long, player_id long, predicted double")


_START = {side: tuple(f"{c}_{x}_start" for x in ("mu", "phi", "sigma")) for side, c in (("player", "a"), ("puzzle", "b"))}
#: Rounds of a large component that run before it is looked whether any state has changed, rows of a task at a time, and tasks' rows; chains that are replayed one by one where fewer stand side by side.
ROUNDS, BUFFER, TASK, FEW = 4, 100_000, 20_000, 24


def _starts(rows: DataFrame) -> DataFrame:
    """Events with the states that their player and their puzzle begin with, unless these have been met before."""
    known = F.col("seed").isNotNull()
    player = (F.when(known, (F.col("seed") - 1500) / GLICKO_SCALE).otherwise(0.0), F.when(known, SEEDED_RD / GLICKO_SCALE).otherwise(NEW_RD / GLICKO_SCALE), F.lit(VOLATILITY))
    puzzle = ((F.col("rating") - 1500) / GLICKO_SCALE, F.lit(PUZZLE_RD / GLICKO_SCALE), F.lit(VOLATILITY))
    return rows.withColumns({name: x for side, xs in (("player", player), ("puzzle", puzzle)) for name, x in zip(_START[side], xs)}).drop("seed", "rating")


def _in_order(rows: DataFrame) -> DataFrame:
    """Small components, one after the other: events before the result (attempt_id, player_id, predicted), and states at the end (side, id, mu, phi, sigma)."""
    rows = rows.repartition("root").sortWithinPartitions("root", "ts", "attempt_id")
    names = [*_START["player"], *_START["puzzle"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, held = None, {}
        ends = lambda: [(None, None, None, side, str(k), *x) for (side, k), x in held.items()]

        def frame(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 8
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["attempt_id", "player_id", "predicted", "side", "id", "mu", "phi", "sigma"])

        for batch in batches:
            columns, out = batch.to_pydict(), []
            for where, attempt, who, puzzle, solved, *start in zip(*(columns[c] for c in ("root", "attempt_id", "player_id", "puzzle_id", "solved", *names))):
                if where != root:
                    out += ends()
                    root, held = where, {}
                me, other = held.get(("player", who)) or tuple(start[:3]), held.get(("puzzle", puzzle)) or tuple(start[3:])
                out.append((attempt, who, sigmoid(shrink(other[1] ** 2) * (me[0] - other[0])), None, None, None, None, None))
                held["player", who] = one_game(*me, *other[:2], float(solved))
                held["puzzle", puzzle] = one_game(*other, *me[:2], 1.0 - float(solved))
            yield frame(out)
        yield frame(ends())

    return rows.mapInArrow(run, "attempt_id long, player_id long, predicted double, side string, id string, mu double, phi double, sigma double")


def games(mu: np.ndarray, phi: np.ndarray, sigma: np.ndarray, mu_j: np.ndarray, phi_j: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`one_game` of many at once."""
    g = 1 / np.sqrt(1 + 3 * phi_j * phi_j / math.pi**2)
    p = 1 / (1 + np.exp(-g * (mu - mu_j)))
    info = np.maximum(g * g * p * (1 - p), 1e-12)
    square, start, d, t = (g * (score - p) / info) ** 2, 2 * np.log(sigma), phi * phi + 1 / info, TAU * TAU
    room = square - d
    low, x = start - t / 2, start
    high = np.where(room > 0, start + np.minimum(t * square / (8 * d), np.maximum(0.0, np.log(np.where(room > 0, room, 1.0)) - start)), start)
    for _ in range(100):
        e = np.exp(x)
        s = d + e
        slope = e * (square - s) / (2 * s * s) - (x - start) / t
        low, high = np.where(slope > 0, x, low), np.where(slope > 0, high, x)
        bend = e * (square * (d - e) - d * s) / (2 * s * s * s) - 1 / t
        new = np.where(bend < 0, x - slope / np.where(bend < 0, bend, -1.0), low - 1)
        new = np.where((low <= new) & (new <= high), new, (low + high) / 2)
        far = np.abs(new - x).max()
        x = new
        if far < 1e-13:
            break
    sigma = np.exp(x / 2)
    phi = 1 / np.sqrt(1 / (phi * phi + sigma * sigma) + info)
    return mu + phi * phi * g * (score - p), phi, sigma


def _along(first: np.ndarray, length: np.ndarray, state: np.ndarray, mu: np.ndarray, phi: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States before each row, and after the last one, of chains of rows: the i-th rows of all chains side by side, and one by one where few chains are left."""
    before, order = np.zeros((len(mu), 3)), np.argsort(-length, kind="stable")
    first, length, end = first[order], length[order], state[order]
    i, most = 0, int(length.max(initial=0))
    while i < most and (n := int(np.searchsorted(-length, -i, side="left"))) >= FEW:
        at = first[:n] + i
        before[at] = end[:n]
        end[:n] = np.stack(games(*end[:n].T, mu[at], phi[at], score[at]), axis=1)
        i += 1
    for k in range(int(np.searchsorted(-length, -i, side="left"))):
        here, me, out = slice(first[k] + i, first[k] + length[k]), tuple(end[k].tolist()), []
        for x in zip(mu[here].tolist(), phi[here].tolist(), score[here].tolist()):
            out.append(me)
            me = one_game(*me, *x)
        before[here], end[k] = out, me
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return before, end[back]


def _replayed(rows: DataFrame, states: DataFrame, side: str, parts: int, kept: bool = False, ends: bool = False) -> DataFrame:
    """Events (key, other, at, mu, phi) for the other side: each of a side's chains is replayed against the other side's states mu and phi, and what goes on is its own state before each event.

    at: twice the place of the event in time, and one more if it was solved. Where rows have no mu, chains keep the states that they begin with. kept: with the states far_mu and far_phi that the replay was against, and
    the largest change so far of a round, if rows have what this side had before as far_mu and far_phi. ends: (side, key, mu, phi, sigma) after the last event of each chain instead.
    """
    compared, begun, size = "far_mu" in rows.columns, "mu" in rows.columns, BUFFER
    if not begun:
        rows = rows.withColumns({c: F.lit(None).cast("double") for c in ("mu", "phi")})
    begin = states.where(F.col("side") == side).select("key", F.lit(-1).cast("long").alias("at"), "mu", "phi", "sigma")
    rows = rows.unionByName(begin, allowMissingColumns=True).repartition(parts, "key").sortWithinPartitions("key", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for table in buffers(batches, size):
            key, at = table.column("key").to_numpy(), table.column("at").to_numpy()
            get = lambda c: table.column(c).to_numpy()
            mu, phi, sigma = get("mu"), get("phi"), get("sigma")
            b = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            fresh, state = at[b] < 0, np.stack([mu[b], phi[b], sigma[b]], axis=1)
            if not fresh[0]:  # the chain goes on from the rows before
                state[0] = held
            first = b + fresh
            length = np.r_[b[1:], len(key)] - first
            if begun:
                won = (at & 1).astype(np.float64)
                before, end = _along(first, length, state, mu, phi, won if side == "player" else 1.0 - won)
            else:
                before, end = np.zeros((len(key), 3)), state
                before[at >= 0] = np.repeat(state, length, axis=0)
            if ends:
                if last is not None and last != key[0]:
                    yield _state(side, np.array([last]), held[None])
                yield _state(side, key[b[:-1]], end[:-1])
            last, held = key[-1], end[-1]
            if not ends:
                e = at >= 0
                new = {"key": table.column("other").filter(pa.array(e)), "other": pa.array(key[e]), "at": pa.array(at[e]), "mu": pa.array(before[e, 0]), "phi": pa.array(before[e, 1])}
                if kept:
                    new |= {"far_mu": pa.array(mu[e]), "far_phi": pa.array(phi[e])}
                    change = np.maximum(np.abs(before[e, 0] - get("far_mu")[e]), np.abs(before[e, 1] - get("far_phi")[e])) if compared else np.zeros(int(e.sum()))
                    new["change"] = pa.array(np.maximum(change, get("change")[e]) if compared else change)
                yield from pa.table(new).combine_chunks().to_batches()
        if ends and last is not None:
            yield _state(side, np.array([last]), held[None])

    if ends:
        return rows.mapInArrow(run, "side string, key long, mu double, phi double, sigma double")
    return rows.mapInArrow(run, "key long, other long, at long, mu double, phi double" + (", far_mu double, far_phi double, change double" if kept else ""))


def _state(side: str, key: np.ndarray, state: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([side] * len(key), pa.string()), pa.array(key), *[pa.array(x) for x in state.T]], names=["side", "key", "mu", "phi", "sigma"])


def _by_slices(rows: DataFrame, total: int, number: int, tolerance: float, store: Store) -> tuple[DataFrame, DataFrame]:
    """Predictions and final states of large components, slice of time by slice.

    In a slice, players are replayed against the puzzles' states as they stand, then puzzles against the players', and so on until no state before an event changes by more than
    the tolerance (0: until it stands still, which is the replay in order). Between the two go an event's numbers and one state of two numbers; each ROUNDS rounds are one job, whose last round is compared with the one before.
    """
    names, _ = store.put(rows.groupBy("puzzle_id").agg(F.min_by(F.struct(*_START["puzzle"]), F.struct("ts", "attempt_id")).alias("x")).select("puzzle_id", F.monotonically_increasing_id().alias("puzzle"), "x.*"))
    row = lambda df, side, key: df.select(F.lit(side).alias("side"), F.col(key).cast("long").alias("key"), *[F.col(c).alias(x) for c, x in zip(_START[side], ("mu", "phi", "sigma"))])
    states, states_path = store.put(row(rows.groupBy("player_id").agg(*[F.any_value(c).alias(c) for c in _START["player"]]), "player", "player_id").unionByName(row(names, "puzzle", "puzzle")))
    second = F.unix_micros("ts")
    cuts = rows.select(second.alias("t")).approxQuantile("t", [i / number for i in range(1, number)], 0.2 / number) if number > 1 else []
    bounds = F.array(*[F.lit(int(c)) for c in sorted(set(cuts))]).cast("array<long>")
    rows = rows.withColumn("slice", F.size(F.filter(bounds, lambda b: b <= second))).join(names.select("puzzle_id", "puzzle"), "puzzle_id").select("slice", "ts", "attempt_id", "player_id", "puzzle", "solved")
    most = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(most, total // number // TASK + 1))
    said = None
    for k in range(len(set(cuts)) + 1):
        here = rows.where(F.col("slice") == k).orderBy("ts", "attempt_id")
        here, numbered = store.put(here.select((2 * F.monotonically_increasing_id() + F.col("solved").cast("long")).alias("at"), "attempt_id", "player_id", "puzzle"))
        both = _replayed(here.select(F.col("puzzle").alias("key"), F.col("player_id").alias("other"), "at"), states, "puzzle", parts)
        path, far = "", math.inf
        while far > tolerance:
            for i in range(ROUNDS):
                both = _replayed(both, states, "player", parts, kept=i == ROUNDS - 1)
                both = _replayed(both, states, "puzzle", parts, kept=i >= ROUNDS - 2)
            done, new = store.put(both)
            if path:
                store.discard(path)
            path = new
            far = done.agg(F.max("change")).first()[0] or 0.0
            both = done.select("key", "other", "at", "mu", "phi")
        predicted = 1 / (1 + F.exp(-(F.col("far_mu") - F.col("mu")) / F.sqrt(1 + 3 * F.col("phi") ** 2 / math.pi**2)))
        part, _ = store.put(done.select("at", predicted.alias("predicted")).join(here.select("at", "attempt_id", "player_id"), "at").select("attempt_id", "player_id", "predicted"))
        said = part if said is None else said.unionByName(part)
        players = done.select("key", "other", "at", "mu", "phi")
        puzzles = done.select(F.col("other").alias("key"), F.col("key").alias("other"), "at", F.col("far_mu").alias("mu"), F.col("far_phi").alias("phi"))
        now, new = store.put(_replayed(players, states, "player", parts, ends=True).unionByName(_replayed(puzzles, states, "puzzle", parts, ends=True)))
        for old in (path, numbered, states_path):
            store.discard(old)
        states, states_path = now, new
    of = states.where("side = 'player'").select("side", F.col("key").cast("string").alias("id"), "mu", "phi", "sigma")
    return said, of.unionByName(states.where("side = 'puzzle'").join(names.select(F.col("puzzle").alias("key"), "puzzle_id"), "key").select("side", F.col("puzzle_id").alias("id"), "mu", "phi", "sigma"))


def glicko2_symmetric(attempts: DataFrame, seeds: DataFrame | None = None, most: int = 200_000, slice_events: int = 20_000_000, tolerance: float = 1e-7) -> tuple[DataFrame, DataFrame]:
    """(attempt_id, player_id, predicted) of every attempt before its result is seen, and (side, id, rating, rd, volatility) of every player and puzzle at the end.

    Each attempt is a period of one game for both: the puzzle wins where the player fails. Players begin at their seed or at 1500, puzzles at the rating of their first attempt.

    Players and puzzles that no attempt links don't touch each other. Components of at most `most` attempts are replayed in order, one at a time in a task that holds the states of
    that component. Larger ones are cut into slices of about `slice_events` attempts by time, see _by_slices; there ratings may differ from a replay in order by an amount of about the tolerance, in units of
    173.7 points. Of attempts without rating or result none takes part. An empty table gives no rows.
    """
    known = attempts.where("rating is not null and solved is not null and puzzle_id is not null and player_id is not null")
    rows = known.select("attempt_id", "player_id", F.col("puzzle_id").cast("string").alias("puzzle_id"), F.col("ts").cast("timestamp").alias("ts"), "rating", F.col("solved").cast("boolean").alias("solved"))
    node = lambda c, k: F.xxhash64(F.lit(k), F.col(c).cast("string"))
    edges = rows.select(node("player_id", 0).alias("a"), node("puzzle_id", 1).alias("b")).distinct()
    store = Store(attempts.sparkSession)
    # Two nodes of one hash join their components, which changes no result.
    players, _ = store.put(rows.groupBy("player_id").agg(F.count("*").alias("n")).withColumn("node", node("player_id", 0)).join(components(edges), "node").drop("node"))
    # A row for each `most` attempts at most.
    large = players.groupBy("root").agg(F.sum("n").alias("size")).where(F.col("size") > most).select("root", F.lit(True).alias("large"))
    players = players.join(F.broadcast(large), "root", "left").withColumn("large", F.coalesce("large", F.lit(False)))
    total = players.where("large").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    seed = seeds.select("player_id", F.col("rating").cast("double").alias("seed")) if seeds is not None else None
    players = players.drop("n").join(seed, "player_id", "left") if seed is not None else players.drop("n").withColumn("seed", F.lit(None).cast("double"))
    rows, _ = store.put(_starts(rows.join(players, "player_id")))
    done, _ = store.put(_in_order(rows.where("not large")))
    said, states = done.where("side is null").select("attempt_id", "player_id", "predicted"), done.where("side is not null").select("side", "id", "mu", "phi", "sigma")
    if total:
        more, ends = _by_slices(rows.where("large"), total, -(-total // slice_events), tolerance, store)
        said, states = said.unionByName(more), states.unionByName(ends)
    return said, states.select("side", "id", (1500 + GLICKO_SCALE * F.col("mu")).alias("rating"), (GLICKO_SCALE * F.col("phi")).alias("rd"), F.col("sigma").alias("volatility"))
