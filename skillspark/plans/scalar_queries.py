"""Queries over further scalar expressions and summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import games as G
from ..functions import puzzles as P
from .registry import query

PV, PZ, PL = ("positions", "arms"), ("puzzles",), ("players",)
KEY = ("game_id", "ply_no", "l_partkey", "l_suppkey")


@query("SELECT game_id, ply_no, l_partkey, l_suppkey, CASE WHEN l_suppkey % 4 = 1 THEN 9000 WHEN l_suppkey % 4 IN (0, 2) THEN -9000 ELSE best_cp END::DOUBLE AS cp FROM positions", PV)
def p34_mate_to_cp(v):
    mate = F.when(F.col("l_suppkey") % 4 == 1, 2).when((F.col("l_suppkey") % 4).isin(0, 2), -1)
    return v("moves").select(*KEY, G.mate_to_cp(mate, F.col("best_cp")).alias("cp"))


@query("SELECT game_id, ply_no, l_partkey, l_suppkey, round(CASE WHEN x <= 0 THEN 100 ELSE greatest(0, least(100, 103.1668::DOUBLE * exp(-0.04354::DOUBLE * x) - 3.1669::DOUBLE)) END, 5)::DOUBLE AS accuracy FROM (SELECT *, CASE WHEN l_partkey % 3 = 0 AND l_suppkey % 50 > 0 THEN (l_suppkey % 50) * 0.092::DOUBLE ELSE (l_partkey % 3) * 7.5::DOUBLE END AS x FROM positions)", PV)
def p35_accuracy_estimate(v):
    wp, cp = (F.col("l_partkey") % 3) * F.lit(7.5), F.col("l_suppkey") % 50
    return v("moves").select(*KEY, F.round(G.accuracy_estimate(wp, cp), 5).alias("accuracy"))


@query("""SELECT player_id, round((rating - 1500) / (400 / ln(10)), 6) AS z, round(1 / (1 + exp(-(rating - 1500) / (400 / ln(10)))), 6) AS s, round(1 / sqrt(1 + 3 * (rating / 1000.0) / (pi() * pi())), 6) AS k,
round(ln(p / (1 - p)), 6) AS lo FROM (SELECT *, least(0.98, greatest(0.02, rating / 3000.0))::DOUBLE AS p FROM players)""", PL)
def p36_logit_family(v):
    r = F.col("rating")
    z = G.rating_to_logit(r)
    return v("players").select("player_id", F.round(z, 6).alias("z"), F.round(G.sigmoid(z), 6).alias("s"), F.round(G.kappa(r / 1000.0), 6).alias("k"), F.round(G.logit(r / 3000.0), 6).alias("lo"))


@query("SELECT player_id, least(3200, greatest(400, round_even(rating * 1.3::DOUBLE + 0.5, 0)))::INT AS rating, greatest(75, round_even((rating % 300) / 2.0::DOUBLE, 0))::INT AS rd FROM players", PL)
def p39_clamp_rating(v):
    r = F.col("rating")
    return v("players").select("player_id", G.clamp_rating(r * F.lit(1.3) + 0.5).alias("rating"), F.greatest(F.lit(75), F.bround((r % 300) / 2.0).cast("int")).alias("rd"))


@query("SELECT player_id, round(ln(p) - ln(1 - p), 5) AS lo FROM (SELECT player_id, least(greatest((rating % 101) / 100.0::DOUBLE, 5e-5), 1 - 1e-4) AS p FROM players)", PL)
def p42_prob_logodds(v):
    return v("players").select("player_id", F.round(G.prob_logodds((F.col("rating") % 101) / 100.0), 5).alias("lo"))


@query("SELECT puzzle_id, CASE WHEN NOT starts_with(puzzle_id, 'gen_') THEN 75 WHEN rating % 2 = 0 THEN 120 ELSE 300 END AS rd FROM (SELECT DISTINCT puzzle_id, rating FROM attempts)", ("attempts",))
def p45_puzzle_rd(v):
    mined = F.col("puzzle_id").startswith("gen_")
    return v("attempts").select("puzzle_id", "rating").distinct().select("puzzle_id", F.when(~mined, 75).when(F.col("rating") % 2 == 0, 120).otherwise(300).alias("rd"))


@query("SELECT puzzle_id, CASE WHEN rating % 7 = 0 OR rating % 11 = 0 THEN NULL ELSE rating::DOUBLE END AS x FROM puzzles", PZ)
def p9_json_safe(v):
    r = F.col("rating")
    return v("puzzles").select("puzzle_id", P.json_safe(F.when(r % 7 == 0, F.lit(float("nan"))).when(r % 11 == 0, F.lit(float("inf"))).otherwise(r.cast("double"))).alias("x"))


@query("SELECT puzzle_id, list_sort(list_filter(regexp_split_to_array(trim(coalesce(themes, '')), '\\s+'), lambda s: s NOT IN ('', 'short', 'long', 'veryLong', 'oneMove', 'crushing', 'advantage', 'equality'))) AS shown FROM puzzles", PZ)
def p8_display_fields(v):
    meta = P.strings(("short", "long", "veryLong", "oneMove", "crushing", "advantage", "equality"))
    return v("puzzles").select("puzzle_id", F.array_sort(F.array_except(P.tokens(F.col("themes")), meta)).alias("shown"))


@query("SELECT puzzle_id, replace(lower(themes), ' ', '') || ' personal' AS themes FROM puzzles", PZ)
def p27_mined_themes(v):
    return v("puzzles").select("puzzle_id", F.concat(F.replace(F.lower("themes"), F.lit(" "), F.lit("")), F.lit(" personal")).alias("themes"))


@query("SELECT player_id, list_sort(list(DISTINCT chr((65 + game_id % 5)::INT))) AS families, count(DISTINCT game_id % 5) AS breadth FROM games GROUP BY 1", ("games",))
def p10_eco_families(v):
    letter = F.chr(65 + F.col("game_id") % 5)
    return v("games").groupBy("player_id").agg(F.array_sort(F.collect_set(letter)).alias("families"), F.countDistinct(F.col("game_id") % 5).alias("breadth"))


@query("SELECT game_id, CASE WHEN game_id % 4 = 0 THEN 'checkmate' WHEN game_id % 4 = 1 THEN 'resignation' WHEN game_id % 4 = 2 THEN 'timeout' ELSE 'other' END AS kind FROM games", ("games",))
def p22_termination_class(v):
    text = F.when(F.col("game_id") % 4 == 0, "A won by CHECKMATE").when(F.col("game_id") % 4 == 1, "B won by resignation").when(F.col("game_id") % 4 == 2, "B won on time")
    return v("games").select("game_id", G.termination_class(text).alias("kind"))


@query("SELECT game_id, ply_no, l_partkey, l_suppkey, CASE WHEN l_partkey % 3 = 0 THEN best_cp WHEN l_partkey % 3 = 1 THEN coalesce(second_cp, -after_cp) ELSE -after_cp END AS played FROM positions", PV)
def p33_played_eval(v):
    k = F.col("l_partkey") % 3
    return v("moves").select(*KEY, F.when(k == 0, F.col("best_cp")).when(k == 1, F.coalesce("second_cp", -F.col("after_cp"))).otherwise(-F.col("after_cp")).alias("played"))


@query("SELECT a.category AS a, b.category AS b, round(CASE WHEN a.arm_id = b.arm_id THEN 0.36::DOUBLE ELSE 0.45::DOUBLE * 0.36 END, 6) AS cov FROM arms a JOIN arms b ON a.arm_id % 6 = b.arm_id % 6 WHERE a.arm_id < 23 AND b.arm_id < 23", ("arms",))
def r12_family_covariance(v):
    arms = v("arms").where("arm_id < 23").withColumn("family", F.col("arm_id") % 6)
    x, y = arms.select("family", F.col("category").alias("a")), arms.select("family", F.col("category").alias("b"))
    return x.join(F.broadcast(y), "family").select("a", "b", F.round(F.when(F.col("a") == F.col("b"), F.lit(0.36)).otherwise(F.lit(0.45) * 0.36), 6).alias("cov"))


@query("""WITH d AS (SELECT player_id, category, count(*) AS n, avg(solved::INT) AS rate FROM attempts GROUP BY 1, 2), k AS (SELECT player_id, row_number() OVER (PARTITION BY player_id ORDER BY rate, category) AS a, row_number() OVER (PARTITION BY player_id ORDER BY n, category) AS b FROM d)
SELECT player_id, count(*) FILTER (WHERE a <= 3 AND b <= 3) AS both_ FROM k GROUP BY 1""", ("attempts",))
def u5_m17_intersect_size(v):
    d = v("attempts").groupBy("player_id", "category").agg(F.count("*").alias("n"), F.avg(F.col("solved").cast("int")).alias("rate"))
    top = lambda c: F.transform(F.slice(F.array_sort(F.collect_list(F.struct(c, "category"))), 1, 3), lambda s: s["category"])
    return d.groupBy("player_id").agg(top("rate").alias("a"), top("n").alias("b")).select("player_id", F.size(F.array_intersect("a", "b")).cast("long").alias("both_"))


@query("""SELECT player_id, i, round(avg(x) OVER (PARTITION BY player_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 6) AS smooth FROM (SELECT player_id, row_number() OVER (PARTITION BY player_id ORDER BY ts, attempt_id)::INT AS i, solved::INT AS x FROM attempts)""", ("attempts",))
def w14_moving_average(v):
    i = F.row_number().over(Window.partitionBy("player_id").orderBy("ts", "attempt_id"))
    w = Window.partitionBy("player_id").orderBy("i").rowsBetween(-4, 4)
    rows = v("attempts").select("player_id", i.alias("i"), F.col("solved").cast("int").alias("x"))
    return rows.select("player_id", "i", F.round(F.avg("x").over(w), 6).alias("smooth"))


@query("""WITH x AS (SELECT game_id AS run, ply_no AS step, avg(best_cp) AS m FROM positions GROUP BY 1, 2) SELECT step, count(*) AS n, round(avg(m), 4) AS mean, round(coalesce(stddev_pop(m), 0), 4)::DOUBLE AS sd FROM x GROUP BY 1""", PV)
def m19_episode_summary(v):
    x = v("moves").groupBy(F.col("game_id").alias("run"), F.col("ply_no").alias("step")).agg(F.avg("best_cp").alias("m"))
    return x.groupBy("step").agg(F.count("*").alias("n"), F.round(F.avg("m"), 4).alias("mean"), F.round(F.stddev_pop("m"), 4).alias("sd"))


@query("SELECT phase, count(*) AS n, round(avg(best_cp - after_cp), 4) AS mean, round(avg(best_cp - after_cp) - 1.96::DOUBLE * stddev_samp(best_cp - after_cp) / sqrt(count(*)), 4) AS low FROM positions GROUP BY 1", PV)
def m14_mean_ci(v):
    d = F.col("best_cp") - F.col("after_cp")
    return v("moves").groupBy("phase").agg(F.count("*").alias("n"), F.round(F.avg(d), 4).alias("mean"), F.round(F.avg(d) - 1.96 * F.stddev_samp(d) / F.sqrt(F.count("*")), 4).alias("low"))


@query("""SELECT CASE WHEN rating < 1000 THEN 0 WHEN rating < 1400 THEN 1 WHEN rating < 1800 THEN 2 WHEN rating < 2200 THEN 3 ELSE 4 END AS band, count(*) AS n, round(avg(solved::INT - 0.5::DOUBLE), 6) AS bias, round(avg(abs(solved::INT - 0.5::DOUBLE)), 6) AS mae FROM attempts GROUP BY 1""", ("attempts",))
def a30_error_by_band(v):
    e = F.col("solved").cast("int") - 0.5
    return v("attempts").groupBy(F.coalesce(G.rating_band(F.col("rating")), F.lit(4)).alias("band")).agg(F.count("*").alias("n"), F.round(F.avg(e), 6).alias("bias"), F.round(F.avg(F.abs(e)), 6).alias("mae"))


@query("""WITH l AS (SELECT attempt_id, 'a' AS labeller, category AS label FROM attempts UNION ALL SELECT attempt_id, 'b', CASE WHEN attempt_id % 3 = 0 THEN 'General' ELSE category END FROM attempts)
SELECT labeller, label, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY labeller))::DOUBLE, 6) AS share FROM l GROUP BY 1, 2""", ("attempts",))
def a25_label_share(v):
    b = F.when(F.col("attempt_id") % 3 == 0, "General").otherwise(F.col("category"))
    rows = v("attempts").select(F.explode(F.array(F.struct(F.lit("a").alias("labeller"), F.col("category").alias("label")), F.struct(F.lit("b").alias("labeller"), b.alias("label")))).alias("x")).select("x.*")
    n = rows.groupBy("labeller", "label").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("labeller")), 6))


@query("""WITH l AS (SELECT seq, puzzle_id, level, least(0.99, greatest(0.01, ((seq * 13 + level) % 97) / 97.0))::DOUBLE AS p FROM puzzles, (SELECT unnest(range(1100, 2000, 100)) AS level)) SELECT level::INT AS level, round(avg(p), 6) AS mean_p, round(avg(ln(p)), 6) AS mean_log FROM l GROUP BY 1""", PZ)
def a32_mean_prob_by_level(v):
    l = v("puzzles").withColumn("level", F.explode(F.sequence(F.lit(1100), F.lit(1900), F.lit(100))))
    p = F.least(F.lit(0.99), F.greatest(F.lit(0.01), ((F.col("seq") * 13 + F.col("level")) % 97) / 97.0))
    return l.groupBy("level").agg(F.round(F.avg(p), 6).alias("mean_p"), F.round(F.avg(F.log(p)), 6).alias("mean_log"))


STYLE = """gm AS (SELECT game_id, player_id, won, CASE game_id % 4 WHEN 0 THEN 'checkmate' WHEN 1 THEN 'resignation' WHEN 2 THEN 'timeout' ELSE 'other' END AS termination, game_id % 5 AS eco FROM games),
mv AS (SELECT game_id, count(*) AS moves, count(*) FILTER (WHERE l_partkey % 200 < 30) AS low, count(*) FILTER (WHERE (l_suppkey % 10) * 100 > (l_partkey % 4) * 100 + 400) AS sac FROM positions GROUP BY 1),
t AS (SELECT player_id, count(*) AS games, count(*) FILTER (WHERE won) AS wins, count(*) FILTER (WHERE NOT won) AS losses, count(*) FILTER (WHERE won AND termination = 'checkmate') AS mates, count(*) FILTER (WHERE NOT won AND termination = 'resignation') AS resigned,
  coalesce(sum(moves), 0) AS moves, coalesce(sum(low), 0) AS low, coalesce(sum(sac), 0) AS sac, count(DISTINCT eco) AS breadth FROM gm LEFT JOIN mv USING (game_id) GROUP BY 1),
r AS (SELECT player_id, games, breadth, wins / games::DOUBLE AS win_rate, coalesce(mates / nullif(wins, 0)::DOUBLE, 0) AS mate_share, coalesce(resigned / nullif(losses, 0)::DOUBLE, 0) AS resigned_share, coalesce(low / nullif(moves, 0)::DOUBLE, 0) AS pressure, sac / games::DOUBLE AS sacrifice_rate FROM t),
a AS (SELECT *, least(100, trunc(55 * mate_share + least(70 * sacrifice_rate, 35) + 10 * (1 - resigned_share)))::INT AS aggression FROM r)"""


@query(f"""WITH {STYLE} SELECT player_id, games, breadth, round(win_rate, 6) AS win_rate, round(pressure, 6) AS pressure, round(sacrifice_rate, 6) AS sacrifice_rate, aggression,
CASE WHEN mate_share >= 0.35 OR aggression >= 65 THEN 'Tactical Attacker' WHEN pressure >= 0.15 THEN 'Time-Trouble Gambler' WHEN win_rate >= 0.55 AND breadth >= 3 THEN 'Opening Theorist' WHEN win_rate >= 0.5 AND sacrifice_rate < 0.03 THEN 'Positional Grinder' ELSE 'Balanced Player' END AS archetype FROM a""", ("games", "positions"))
def a10_a11_style_profile(v):
    from ..operators.style import style_profile

    k = F.col("game_id") % 4
    games = v("games").select("player_id", "game_id", "won", F.when(k == 0, "checkmate").when(k == 1, "resignation").when(k == 2, "timeout").otherwise("other").alias("termination"), (F.col("game_id") % 5).alias("eco"))
    moves = v("moves").select("game_id", (F.col("l_partkey") % 200).alias("clock"), (F.col("l_suppkey") % 10 * 100).alias("attacker"), (F.col("l_partkey") % 4 * 100).alias("captured"))
    out = style_profile(games, moves).drop("mate_share", "resigned_share")
    return out.withColumns({c: F.round(c, 6) for c in ("win_rate", "pressure", "sacrifice_rate")})
