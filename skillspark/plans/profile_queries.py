"""Queries over games and graded positions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import games as G
from ..operators import profile as O
from ..taxonomy import ARMS
from .registry import query

GP = ("games", "positions", "arms")
ARM_LIST = "(" + ", ".join(f"'{a}'" for a in ARMS) + ")"


def _wp(x: str) -> str:
    return f"(50.0 + 50.0 * (2.0 / (1.0 + exp(-0.00368208::DOUBLE * least(greatest(({x})::DOUBLE, -9000), 9000))) - 1.0))"


GRADED = f"""gr AS (SELECT *, greatest(0.0, {_wp('best_cp')} - {_wp('after_cp')})::DOUBLE AS wp_loss, least(1000, greatest(0, best_cp - after_cp)) AS cp_loss,
  second_cp IS NOT NULL AND NOT recapture AND {_wp('best_cp')} - {_wp('second_cp')} >= 10.0 AS critical FROM positions),
g AS (SELECT * FROM (SELECT *, wp_loss < 5.0 AS hit, CASE WHEN wp_loss >= 15 THEN 'blunder' WHEN wp_loss >= 10 THEN 'mistake' WHEN wp_loss >= 5 THEN 'inaccuracy' END AS severity FROM gr) WHERE critical OR severity IS NOT NULL)"""
WEIGHTS = """w AS (SELECT game_id, player_id, rank, pow(0.5, rank / 25.0::DOUBLE) * CASE time_class WHEN 'bullet' THEN 0.5 WHEN 'blitz' THEN 0.85 WHEN 'rapid' THEN 1.0 WHEN 'daily' THEN 1.0 ELSE 0.85 END::DOUBLE AS weight
  FROM (SELECT *, (row_number() OVER (PARTITION BY player_id ORDER BY end_time DESC NULLS LAST, game_id) - 1)::INT AS rank FROM games))"""
STATS = f"""{GRADED}, {WEIGHTS},
s0 AS (SELECT w.player_id, category, sum(weight * hit::INT) AS hits, sum(weight) AS n, count(*) AS raw_n FROM g JOIN w ON g.game_id = w.game_id WHERE critical GROUP BY 1, 2),
s1 AS (SELECT *, sum(hits) OVER p / sum(n) OVER p AS overall, coalesce(sum(CASE WHEN category IN {ARM_LIST} THEN hits END) OVER p / sum(CASE WHEN category IN {ARM_LIST} THEN n END) OVER p, sum(hits) OVER p / sum(n) OVER p) AS baseline FROM s0 WINDOW p AS (PARTITION BY player_id)),
s AS (SELECT *, baseline AS expected, (hits + 4.0::DOUBLE * baseline) / (n + 4.0::DOUBLE) AS rate, n / (n + 4.0::DOUBLE) AS personal FROM s1)"""
GRID = f"""{STATS}, grid AS (SELECT p.player_id, p.raw_total, a.category, a.arm_id, CASE WHEN base > 0 THEN base ELSE 0.5 END AS base, s.raw_n, coalesce(s.rate, CASE WHEN base > 0 THEN base ELSE 0.5 END) AS rate, coalesce(s.n, 0) AS n, s.expected, s.personal
  FROM (SELECT player_id, any_value(overall) AS base, sum(raw_n) AS raw_total FROM s GROUP BY 1) p CROSS JOIN (SELECT * FROM arms WHERE arm_id < 23) a LEFT JOIN s ON s.player_id = p.player_id AND s.category = a.category)"""


def r(*names: str) -> dict:
    return {n: F.round(n, 5) for n in names}


def _stats(v):
    return O.opportunity_stats(v("games"), O.graded(v("moves")))


@query(f"WITH {STATS} SELECT player_id, category, rank::INT AS rank, round(rate, 5) AS rate, raw_n FROM (SELECT s.*, row_number() OVER (PARTITION BY player_id ORDER BY round(rate, 9), arm_id) AS rank FROM s JOIN arms a ON a.category = s.category AND a.arm_id < 23) WHERE rank <= 3", GP)
def flagship_top_weaknesses(v):
    rates = _stats(v).withColumn("rate", F.round("rate", 9))
    return O.top_weaknesses(rates, v("arms").where("arm_id < 23"), 3).select("player_id", "category", F.col("rank").cast("int").alias("rank"), F.round("rate", 5).alias("rate"), "raw_n")


@query(f"WITH {GRADED} SELECT game_id, ply_no, l_partkey, l_suppkey, round(wp_loss, 5) AS wp_loss, cp_loss, critical, hit, severity FROM g", GP)
def p32_grade_move(v):
    return O.graded(v("moves")).select("game_id", "ply_no", "l_partkey", "l_suppkey", F.round("wp_loss", 5).alias("wp_loss"), "cp_loss", "critical", "hit", "severity")


@query(f"WITH {WEIGHTS} SELECT game_id, rank, round(weight, 6) AS weight FROM w", GP)
def w1_recency_rank(v):
    return O.recency_weights(v("games")).select("game_id", "rank", F.round("weight", 6).alias("weight"))


@query(f"WITH {STATS} SELECT player_id, category, raw_n, round(hits, 5) AS hits, round(n, 5) AS n, round(overall, 5) AS overall, round(rate, 5) AS rate, round(personal, 5) AS personal FROM s", GP)
def a6_opportunity_stats(v):
    return _stats(v).select("player_id", "category", "raw_n", *[F.round(c, 5).alias(c) for c in ("hits", "n", "overall", "rate", "personal")])


NORMS = "norms AS (SELECT category, ((arm_id % 7) - 3) * 0.2::DOUBLE AS \"offset\" FROM arms WHERE arm_id < 15)"


@query(f"""WITH {STATS}, {NORMS} SELECT player_id, s.category, round(CASE WHEN "offset" IS NOT NULL AND baseline > 0 AND baseline < 1 THEN 1.0 / (1.0 + exp(-(ln(b / (1.0 - b)) + "offset"))) ELSE baseline END, 5) AS expected
FROM (SELECT *, least(0.98, greatest(0.02, baseline))::DOUBLE AS b FROM s) s LEFT JOIN norms USING (category)""", GP)
def j6_norms_join(v):
    norms = v("arms").where("arm_id < 15").select("category", ((F.col("arm_id") % 7 - 3) * 0.2).alias("offset"))
    return O.opportunity_stats(v("games"), O.graded(v("moves")), norms).select("player_id", "category", F.round("expected", 5).alias("expected"))


@query(f"WITH {GRID} SELECT player_id, category, round(1 - rate, 5) AS weakness FROM grid WHERE raw_total >= 10", GP)
def a8_empirical_weakness(v):
    return O.arm_grid(_stats(v), v("arms")).where("raw_total >= 10").select("player_id", "category", F.round(1 - F.col("rate"), 5).alias("weakness"))


@query(f"WITH {GRID} SELECT player_id, category, raw_n IS NOT NULL AS seen FROM grid", GP)
def j7_player_category_grid(v):
    return O.arm_grid(_stats(v), v("arms")).select("player_id", "category", "seen")


@query(f"WITH {GRID} SELECT player_id, category, round(1 + rate * least(10.0, n + 2), 5) AS alpha, round(1 + (1 - rate) * least(10.0, n + 2), 5) AS beta FROM grid WHERE raw_total >= 10", GP)
def r3_beta_priors(v):
    return O.beta_priors(O.arm_grid(_stats(v), v("arms"))).withColumns(r("alpha", "beta"))


@query(f"""WITH {GRID}, c AS (SELECT *, least(0.98, greatest(0.02, rate))::DOUBLE AS r, least(0.98, greatest(0.02, expected))::DOUBLE AS e FROM grid WHERE raw_total >= 10 AND raw_n IS NOT NULL)
SELECT player_id, category, round(greatest(-1.5, least(1.5, ln(r / (1 - r)) - ln(e / (1 - e)))), 5)::DOUBLE AS mean, round(1 / sqrt(1 / (0.6::DOUBLE * 0.6) + 0.5 * personal * n * rate * (1 - rate)), 5) AS sd FROM c""", GP)
def r4_irt_priors(v):
    return O.irt_priors(O.arm_grid(_stats(v), v("arms"))).withColumns(r("mean", "sd"))


COUNTS = f"""{GRADED}, c AS (SELECT gm.*, coalesce(errors, 0) AS errors, coalesce(blunders, 0) AS blunders, coalesce(mistakes, 0) AS mistakes, coalesce(inaccuracys, 0) AS inaccuracys, coalesce(opening_errors, 0) AS opening_errors,
  coalesce(middlegame_errors, 0) AS middlegame_errors, coalesce(endgame_errors, 0) AS endgame_errors, coalesce(avg_cp_loss, 0) AS avg_cp_loss, coalesce(avg_wp_loss, 0) AS avg_wp_loss
  FROM (SELECT player_id, count(*) AS games, count(*) FILTER (WHERE won) AS wins, count(*) FILTER (WHERE NOT won) AS losses, count(*) FILTER (WHERE won IS NULL) AS draws FROM games GROUP BY 1) gm
  LEFT JOIN (SELECT player_id, count(*) AS errors, count(*) FILTER (WHERE severity = 'blunder') AS blunders, count(*) FILTER (WHERE severity = 'mistake') AS mistakes, count(*) FILTER (WHERE severity = 'inaccuracy') AS inaccuracys,
    count(*) FILTER (WHERE phase = 'opening') AS opening_errors, count(*) FILTER (WHERE phase = 'middlegame') AS middlegame_errors, count(*) FILTER (WHERE phase = 'endgame') AS endgame_errors FROM g WHERE severity IS NOT NULL GROUP BY 1) e USING (player_id)
  LEFT JOIN (SELECT player_id, avg(cp) FILTER (WHERE cp > 0) AS avg_cp_loss, avg(wp) FILTER (WHERE wp > 0) AS avg_wp_loss FROM (SELECT player_id, game_id, avg(cp_loss) AS cp, avg(wp_loss) AS wp FROM g GROUP BY 1, 2) GROUP BY 1) l USING (player_id))"""


MAPS = """m AS (SELECT player_id, string_agg(k || ':' || n, ',' ORDER BY k) AS games_by_time_class FROM (SELECT player_id, time_class AS k, count(*) AS n FROM games GROUP BY 1, 2) GROUP BY 1),
em AS (SELECT player_id, string_agg(k || ':' || n, ',' ORDER BY k) AS errors_by_category FROM (SELECT player_id, category AS k, count(*) AS n FROM g WHERE severity IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"""


def _text(c):
    return F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",").alias(c)


@query(f"WITH {COUNTS}, {MAPS} SELECT c.* REPLACE (wins::BIGINT AS wins, losses::BIGINT AS losses, draws::BIGINT AS draws, round(avg_cp_loss, 5)::DOUBLE AS avg_cp_loss, round(avg_wp_loss, 5)::DOUBLE AS avg_wp_loss), games_by_time_class, coalesce(errors_by_category, '') AS errors_by_category FROM c JOIN m USING (player_id) LEFT JOIN em USING (player_id)", GP)
def a4_profile_counters(v):
    out = O.counters(v("games"), O.graded(v("positions"))).withColumns(r("avg_cp_loss", "avg_wp_loss"))
    return out.select(*[c for c in out.columns if not c.endswith(("_class", "_category"))], _text("games_by_time_class"), _text("errors_by_category"))


@query("""WITH f AS (SELECT player_id, color, opening_family, count(*) AS games, count(*) FILTER (WHERE won) AS wins, count(*) FILTER (WHERE NOT won) AS losses, count(*) FILTER (WHERE won IS NULL) AS draws, min(game_id) AS first_game, max_by('E' || (game_id % 100)::VARCHAR, game_id) AS eco FROM games GROUP BY 1, 2, 3)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY player_id, color ORDER BY games DESC, first_game)::INT AS rank FROM f) WHERE rank <= 10""", GP)
def a5_opening_repertoire(v):
    return O.opening_repertoire(v("games").withColumn("eco", F.concat(F.lit("E"), (F.col("game_id") % 100).cast("string"))))


def _raised(s, when, cap, by):
    return f"(CASE WHEN {when} THEN least({cap}::DOUBLE, {s} + {by}) ELSE {s} END)"


def _in(names):
    return "category IN (" + ", ".join(f"'{x}'" for x in names) + ")"


_S1 = _raised("0.5::DOUBLE", f"{_in(O.MIDDLEGAME)} AND m > 0.5", 0.9, "least(0.25::DOUBLE, m * 0.3::DOUBLE)")
_S2 = _raised("s1", f"{_in(O.ENDGAMES)} AND e > 0.25", 0.9, "least(0.30::DOUBLE, e * 0.4::DOUBLE)")
_S3 = f"CASE WHEN b >= 2 THEN {_raised('s2', _in(('Hanging Piece', 'Fork', 'Pin')), 0.92, '0.25::DOUBLE')} WHEN b >= 1 THEN {_raised('s2', _in(('Hanging Piece', 'Fork')), 0.85, '0.15::DOUBLE')} ELSE s2 END"
_S4 = _raised("s3", f"{_in(ARMS[:4])} AND acc < 70", 0.90, "0.10::DOUBLE")


@query(f"""WITH {COUNTS}, x AS (SELECT player_id, category, middlegame_errors / greatest(errors, 1)::DOUBLE AS m, endgame_errors / greatest(errors, 1)::DOUBLE AS e, blunders / greatest(games, 1)::DOUBLE AS b,
  CASE WHEN avg_wp_loss <= 0 AND avg_cp_loss <= 0 THEN 100.0 ELSE greatest(0, least(100, 103.1668::DOUBLE * exp(-0.04354::DOUBLE * CASE WHEN avg_wp_loss <= 0 THEN avg_cp_loss * 0.092::DOUBLE ELSE avg_wp_loss END) - 3.1669::DOUBLE)) END AS acc FROM c CROSS JOIN (SELECT * FROM arms WHERE arm_id < 23)),
x1 AS (SELECT *, {_S1} AS s1 FROM x), x2 AS (SELECT *, {_S2} AS s2 FROM x1), x3 AS (SELECT *, {_S3} AS s3 FROM x2)
SELECT player_id, category, round({_S4}, 5) AS score FROM x3""", GP)
def a7_weakness_rules(v):
    return O.weakness_rules(O.counters(v("games"), O.graded(v("positions"))), v("arms")).select("player_id", "category", F.round("score", 5).alias("score"))


@query("""WITH m AS (SELECT player_id, count(*) AS n, count(*) FILTER (WHERE won) AS wins, count(*) FILTER (WHERE NOT won) AS lost, count(*) FILTER (WHERE NOT won AND num_moves < 25) AS s, count(*) FILTER (WHERE NOT won AND num_moves > 40) AS l, floor(avg(1000 + game_id % 900))::INT AS elo FROM games GROUP BY 1),
p AS (SELECT *, wins / n::DOUBLE AS w, greatest(lost, 1)::DOUBLE AS d FROM m), q AS (SELECT *, greatest(0.30, least(0.85, 0.75 - w * 0.50 + s / d * 0.20))::DOUBLE AS tactical, greatest(0.25, least(0.80, 0.60 - w * 0.30 + l / d * 0.30))::DOUBLE AS endgame FROM p)
SELECT player_id, n, round(w, 5) AS win_rate, elo, category, round(CASE WHEN category IN ('Fork', 'Pin', 'Hanging Piece', 'Discovered Attack', 'Skewer', 'Deflection', 'King Safety', 'Mating Pattern') THEN tactical WHEN category LIKE '%Endgame' THEN endgame ELSE 0.5 END, 5)::DOUBLE AS score FROM q CROSS JOIN (SELECT category FROM arms WHERE arm_id < 23)""", GP)
def a9_heuristic_profile(v):
    p = O.heuristic_profile(v("games").withColumn("player_rating", 1000 + F.col("game_id") % 900))
    return O.heuristic_weaknesses(p, v("arms")).join(p.select("player_id", "n", "win_rate", "elo"), "player_id").withColumns(r("win_rate", "score"))


@query("SELECT player_id, rating, CASE WHEN rating < 1000 THEN 0 WHEN rating < 1400 THEN 1 WHEN rating < 1800 THEN 2 WHEN rating < 2200 THEN 3 WHEN rating < 3500 THEN 4 END AS band, least(1900, greatest(1100, 100 * ceil((rating - 50) / 100.0)))::INT AS level FROM players", ("players",))
def p40_p41_bands(v):
    return v("players").select("player_id", "rating", G.rating_band(F.col("rating")).alias("band"), G.nearest_level(F.col("rating")).alias("level"))


@query("SELECT band, count(*) AS n FROM (SELECT CASE WHEN rating < 1000 THEN 0 WHEN rating < 1400 THEN 1 WHEN rating < 1800 THEN 2 WHEN rating < 2200 THEN 3 WHEN rating < 3500 THEN 4 END AS band FROM players) GROUP BY 1", ("players",))
def a33_band_census(v):
    return v("players").groupBy(G.rating_band(F.col("rating")).alias("band")).agg(F.count("*").alias("n"))


@query(f"SELECT game_id, ply_no, l_partkey, l_suppkey, round({_wp('best_cp')}, 6) AS wp, greatest(-9000, least(9000, best_cp)) AS cp FROM positions", GP)
def p30_win_percent(v):
    return v("moves").select("game_id", "ply_no", "l_partkey", "l_suppkey", F.round(G.win_percent(F.col("best_cp")), 6).alias("wp"), F.greatest(F.lit(-9000), F.least(F.lit(9000), "best_cp")).alias("cp"))


FEN = "(SELECT puzzle_id, fen, split_part(fen, ' ', 1) AS b FROM puzzles WHERE fen IS NOT NULL)"


def _n(kinds: str) -> str:
    return f"(length(b) - length(translate(b, '{kinds}', '')))"


@query(f"""SELECT puzzle_id, split_part(fen, ' ', 2) AS side, {_n('pnbrqkPNBRQK')}::INT AS n, ({_n('P')} + 3 * {_n('N')} + 3 * {_n('B')} + 5 * {_n('R')} + 9 * {_n('Q')})::INT AS white, (3 * {_n('n')} + 3 * {_n('b')} + 5 * {_n('r')} + 9 * {_n('q')})::INT AS black_no_pawns,
CASE WHEN {_n('pnbrqkPNBRQK')} >= 28 THEN 'opening' WHEN {_n('pnbrqkPNBRQK')} >= 14 THEN 'middlegame' ELSE 'endgame' END AS phase, contains(split_part(fen, ' ', 3), 'K') AS castle FROM {FEN}""", ("puzzles",))
def p23_p24_fen_features(v):
    f = F.col("fen")
    return v("puzzles").where("fen is not null").select(
        "puzzle_id", F.split_part(f, F.lit(" "), F.lit(2)).alias("side"), G.pieces(f, "pnbrqkPNBRQK").alias("n"), G.material(f, True).alias("white"), G.material(f, False, False).alias("black_no_pawns"),
        G.game_phase(f).alias("phase"), F.split_part(f, F.lit(" "), F.lit(3)).contains("K").alias("castle"),
    )


@query("SELECT player_id, game_id FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY end_time DESC, game_id DESC) AS rn FROM games) WHERE rn <= 5", GP)
def w7_newest_n_games(v):
    w = Window.partitionBy("player_id").orderBy(F.desc("end_time"), F.desc("game_id"))
    return v("games").withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("player_id", "game_id")


@query("SELECT player_id, game_id, CASE WHEN rn <= floor(2 * n / 3) THEN 'train' ELSE 'test' END AS part, ((rn - 1) % 2)::INT AS half FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY end_time, game_id) AS rn, count(*) OVER (PARTITION BY player_id) AS n FROM games) WHERE n >= 15", GP)
def w2_w3_temporal_split(v):
    w = Window.partitionBy("player_id").orderBy("end_time", "game_id")
    g = v("games").withColumns({"rn": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy("player_id"))}).where("n >= 15")
    return g.select("player_id", "game_id", F.when(F.col("rn") <= F.floor(2 * F.col("n") / 3), "train").otherwise("test").alias("part"), ((F.col("rn") - 1) % 2).cast("int").alias("half"))


PGN = """pgn AS (SELECT o_orderkey AS game_id, concat('[White "', CASE WHEN o_orderkey % 3 = 0 THEN 'Ann' ELSE 'annabel' END, '"] [Black "', CASE WHEN o_orderkey % 2 = 0 THEN 'ann' ELSE 'Zed' END, '"] [Result "', CASE o_orderkey % 4 WHEN 0 THEN '1-0' WHEN 1 THEN '0-1' ELSE '1/2-1/2' END,
 '"] [TimeControl "', CASE o_orderkey % 6 WHEN 0 THEN '60' WHEN 1 THEN '180+2' WHEN 2 THEN '600+5' WHEN 3 THEN '1/86400' WHEN 4 THEN '-' ELSE 'abc' END, '"] [UTCDate "', replace(substring(CAST(o_orderdate AS STRING), 1, 10), '-', '.'), '"] [UTCTime "10:20:30"] ',
 CASE WHEN o_orderkey % 5 = 0 THEN '[ECOUrl "https://x.org/openings/Sicilian-Defense-Open/"] ' WHEN o_orderkey % 5 = 1 THEN '[Opening "French Defense"] ' ELSE '' END, '1. e4 {[%clk 0:01:', CAST(10 + o_orderkey % 50 AS STRING), ']} 1... e5 {[%clk 0:00:5', CAST(o_orderkey % 10 AS STRING), '.5]} 2. Nf3 (2. d4 exd4) Nc6 1-0') AS pgn FROM orders)"""


def _pgn(v):
    orders = v("orders")
    return orders.sparkSession.sql(f"WITH {PGN.replace('{', '{{').replace('}', '}}').replace('FROM orders', 'FROM {orders}')} SELECT * FROM pgn", orders=orders)


def _tag(k):
    return f"nullif(regexp_extract(pgn, '\\[{k} \"([^\"]*)\"\\]', 1), '')"


@query(f"""WITH {PGN}, t AS (SELECT game_id, pgn, lower({_tag('White')}) AS w, lower({_tag('Black')}) AS b, {_tag('Result')} AS res, {_tag('TimeControl')} AS tc FROM pgn),
c AS (SELECT *, CASE WHEN w = 'ann' THEN 'white' WHEN b = 'ann' THEN 'black' WHEN contains(w, 'ann') THEN 'white' ELSE 'black' END AS color FROM t)
SELECT game_id, color, CASE WHEN res = '1-0' THEN color = 'white' WHEN res = '0-1' THEN color = 'black' END AS won,
CASE tc WHEN '60' THEN 'bullet' WHEN '180+2' THEN 'blitz' WHEN '600+5' THEN 'rapid' WHEN '1/86400' THEN 'daily' ELSE 'unknown' END AS time_class,
epoch(try_strptime({_tag('UTCDate')} || ' ' || {_tag('UTCTime')}, '%Y.%m.%d %H:%M:%S'))::BIGINT AS end_time,
coalesce(replace(string_split(rtrim({_tag('ECOUrl')}, '/'), '/')[-1], '-', ' '), {_tag('Opening')}, 'Unknown') AS opening FROM c""")
def s9_p12_p20_pgn_tags(v):
    p = F.col("pgn")
    color = G.player_color(G.tag(p, "White"), G.tag(p, "Black"), F.lit("Ann"))
    return _pgn(v).select("game_id", color.alias("color"), G.outcome(G.tag(p, "Result"), color).alias("won"), G.time_class(G.tag(p, "TimeControl")).alias("time_class"), G.end_time(p).alias("end_time"), G.opening_slug(p).alias("opening"))


@query(f"WITH {PGN} SELECT game_id, 4 AS plies, 60.0::DOUBLE + 10 + game_id % 50 AS first_clock, 50.5::DOUBLE + game_id % 10 AS second_clock FROM pgn")
def p21_p28_clock_and_plies(v):
    p = F.regexp_replace("pgn", r"\[[A-Za-z]+ \"[^\"]*\"\]", "")
    clocks = G.clock_seconds(F.col("pgn"))
    return _pgn(v).select("game_id", G.ply_count(p).alias("plies"), clocks[0].alias("first_clock"), clocks[1].alias("second_clock"))
