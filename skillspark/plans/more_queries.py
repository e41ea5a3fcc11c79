"""Queries over rankings, nested rewrites, predictions and serving."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import games as G
from ..operators import attempts as A
from ..operators import metrics as M
from ..operators import mining as MI
from ..operators import profile as PR
from ..operators import puzzles as P
from ..taxonomy import ARMS, TIERS
from .attempt_queries import PRED, _pred
from .profile_queries import COUNTS, GRADED
from .puzzle_queries import E as ENRICHED
from ..operators import recommend as RC
from .registry import query

PV, PZ, AT = ("positions", "arms"), ("puzzles",), ("attempts",)


@query("""(SELECT 'top' AS part, puzzle_id, popularity FROM puzzles ORDER BY popularity DESC, seq LIMIT 10) UNION ALL (SELECT 'bottom', puzzle_id, popularity FROM puzzles ORDER BY popularity, seq LIMIT 10)""", PZ)
def t2_best_worst_puzzles(v):
    pick = lambda order, name: v("puzzles").orderBy(order, "seq").limit(10).select(F.lit(name).alias("part"), "puzzle_id", "popularity")
    return pick(F.desc("popularity"), "top").unionByName(pick(F.asc("popularity"), "bottom"))


@query("SELECT player_id, coalesce(greatest(CASE WHEN rating % 2 = 0 THEN rating END, CASE WHEN rating % 3 = 0 THEN rating - 10 END), 1200) AS best FROM players", ("players",))
def t4_best_rating(v):
    r = F.col("rating")
    return v("players").select("player_id", F.coalesce(F.greatest(F.when(r % 2 == 0, r), F.when(r % 3 == 0, r - 10)), F.lit(1200)).alias("best"))


@query("SELECT puzzle_id FROM puzzles ORDER BY md5(puzzle_id || '/3'), puzzle_id LIMIT 50", PZ)
def t5_sample_n(v):
    return v("puzzles").orderBy(F.md5(F.concat("puzzle_id", F.lit("/3")).cast("binary")), "puzzle_id").limit(50).select("puzzle_id")


@query(f"WITH {ENRICHED}, r AS (SELECT primary_category, puzzle_id, row_number() OVER (PARTITION BY primary_category ORDER BY md5(puzzle_id), puzzle_id) AS rn FROM e) SELECT primary_category, count(*) AS n, count(*) FILTER (WHERE rn <= 8) AS kept FROM r GROUP BY 1", PZ)
def t6_category_pool_sample(v):
    w = Window.partitionBy("primary_category").orderBy(F.md5(F.col("puzzle_id").cast("binary")), "puzzle_id")
    r = P.enrich(v("puzzles")).withColumn("rn", F.row_number().over(w))
    return r.groupBy("primary_category").agg(F.count("*").alias("n"), F.count_if(F.col("rn") <= 8).alias("kept"))


_TIERS = "(SELECT * FROM (VALUES " + ", ".join(f"('{t[0]}')" for t in TIERS) + ") AS t(difficulty_tier))"


@query(f"WITH {ENRICHED} SELECT t.difficulty_tier, count(e.puzzle_id) AS n FROM {_TIERS} t LEFT JOIN e USING (difficulty_tier) GROUP BY 1", PZ)
def k3_split_by_tier(v):
    return P.counts_on(P.enrich(v("puzzles")), tuple(t for t, _, _ in TIERS), "difficulty_tier").select("difficulty_tier", "n")


@query("""WITH x AS (SELECT player_id, attempt_id, CASE WHEN attempt_id % 4 = 0 THEN 'General' ELSE category END AS category FROM attempts) SELECT player_id, string_agg(category, '/' ORDER BY attempt_id) AS labels FROM x GROUP BY 1""", AT)
def k8_relabel_writeback(v):
    a = v("attempts").select("player_id", "attempt_id", "category")
    new = a.where("attempt_id % 4 = 0").select("player_id", "attempt_id", F.lit("General").alias("label"))
    flat = a.join(new, ["player_id", "attempt_id"], "left").withColumn("category", F.coalesce("label", "category"))
    nested = flat.groupBy("player_id").agg(F.array_sort(F.collect_list(F.struct("attempt_id", "category"))).alias("history"))
    return nested.select("player_id", F.array_join("history.category", "/").alias("labels"))


def _within(v):
    return v("players").select("player_id", (F.col("rating") - 100).alias("low"), (F.col("rating") + 100).alias("high"))


@query("SELECT DISTINCT p.player_id, z.puzzle_id FROM players p JOIN puzzles z ON z.rating BETWEEN p.rating - 100 AND p.rating + 100 ANTI JOIN attempts a ON a.player_id = p.player_id AND a.puzzle_id = z.puzzle_id", ("players", "puzzles", "attempts"))
def f10_j8_unseen_in_range(v):
    return RC.unseen_pairs(_within(v), v("puzzles").select("puzzle_id", "rating"), v("attempts"))


@query("""WITH z AS (SELECT puzzle_id, coalesce(CASE WHEN seq % 13 > 0 THEN rating END, 1200) AS rating FROM puzzles), h AS (SELECT p.player_id, count(*) AS n FROM players p JOIN z ON z.rating BETWEEN p.rating - 100 AND p.rating + 100 GROUP BY 1),
s AS (SELECT p.player_id, count(DISTINCT z.puzzle_id) AS k FROM players p JOIN attempts a USING (player_id) JOIN z ON z.puzzle_id = a.puzzle_id AND z.rating BETWEEN p.rating - 100 AND p.rating + 100 GROUP BY 1)
SELECT player_id, coalesce(n, 0) - coalesce(k, 0) AS unseen FROM players LEFT JOIN h USING (player_id) LEFT JOIN s USING (player_id)""", ("players", "puzzles", "attempts"))
def f10_unseen_counts(v):
    return RC.unseen_in_range(_within(v), v("puzzles").select("puzzle_id", F.when(F.col("seq") % 13 > 0, F.col("rating")).alias("rating")), v("attempts"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE a.k IS NULL OR b.k IS NULL) AS missing, count(*) FILTER (WHERE a.x <> b.x) AS differ FROM (SELECT attempt_id AS k, solved AS x FROM attempts WHERE attempt_id % 10 <> 1) a FULL JOIN (SELECT attempt_id AS k, solved AND attempt_id % 7 <> 0 AS x FROM attempts WHERE attempt_id % 10 <> 2) b ON a.k = b.k", AT)
def j12_row_alignment_check(v):
    a = v("attempts").where("attempt_id % 10 <> 1").select(F.col("attempt_id").alias("k"), F.col("solved").alias("x"))
    b = v("attempts").where("attempt_id % 10 <> 2").select(F.col("attempt_id").alias("j"), (F.col("solved") & (F.col("attempt_id") % 7 != 0)).alias("y"))
    return a.join(b, F.col("k") == F.col("j"), "full").agg(F.count("*").alias("n"), F.count_if(F.col("k").isNull() | F.col("j").isNull()).alias("missing"), F.count_if(F.col("x") != F.col("y")).alias("differ"))


@query(f"""WITH {COUNTS}, k AS (SELECT player_id, category, count(*) AS n FROM g WHERE severity IS NOT NULL GROUP BY 1, 2), t AS (SELECT *, greatest(opening_errors + middlegame_errors + endgame_errors, 1)::DOUBLE AS e FROM c),
a AS (SELECT *, CASE WHEN avg_wp_loss <= 0 AND avg_cp_loss <= 0 THEN 100.0 ELSE greatest(0, least(100, 103.1668::DOUBLE * exp(-0.04354::DOUBLE * CASE WHEN avg_wp_loss <= 0 THEN avg_cp_loss * 0.092::DOUBLE ELSE avg_wp_loss END) - 3.1669::DOUBLE)) END / 100 AS acc FROM t)
SELECT a.player_id, round(middlegame_errors / e, 6) AS middlegame_rate, round(endgame_errors / e, 6) AS endgame_rate, round(blunders / games::DOUBLE, 6) AS blunders_pg, round(mistakes / games::DOUBLE, 6) AS mistakes_pg, round(inaccuracys / games::DOUBLE, 6) AS inaccuracies_pg, round(acc, 6)::DOUBLE AS accuracy, round(ln(1 + games), 6) AS games_log,
{", ".join(f"round(coalesce(max(n) FILTER (WHERE category = '{x}'), 0) / e, 6) AS {PR.slug(x)}" for x in ARMS)} FROM a LEFT JOIN k USING (player_id) GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY a.player_id, e, middlegame_errors, endgame_errors, blunders, mistakes, inaccuracys, games, acc"), ("games", "positions", "arms"))
def a20_weakness_features(v):
    out = PR.weakness_features(PR.counters(v("games"), PR.graded(v("positions"))))
    return out.select("player_id", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


def _group(names):
    return "(" + ", ".join(f"'{x}'" for x in names) + ")"


@query(f"""WITH {GRADED}, p AS (SELECT game_id, avg(wp_loss) AS wp, avg(cp_loss) AS cp, count(*) FILTER (WHERE severity = 'blunder') AS blunder, count(*) FILTER (WHERE severity = 'mistake') AS mistake, count(*) FILTER (WHERE severity = 'inaccuracy') AS inaccuracy,
  count(*) FILTER (WHERE severity IS NOT NULL AND phase = 'opening') AS o, count(*) FILTER (WHERE severity IS NOT NULL AND phase = 'middlegame') AS m, count(*) FILTER (WHERE severity IS NOT NULL AND phase = 'endgame') AS e, count(severity) AS errors, count(*) FILTER (WHERE critical) AS n_all, count(*) FILTER (WHERE critical AND hit) AS h_all,
  {", ".join(f"count(*) FILTER (WHERE critical AND category IN {_group(c)}) AS n_{g}, count(*) FILTER (WHERE critical AND hit AND category IN {_group(c)}) AS h_{g}" for g, c in PR.GROUPS.items())} FROM g GROUP BY 1),
r AS (SELECT player_id, num_moves, won, time_class, coalesce(wp, 0) AS wp, coalesce(cp, 0) AS cp, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("blunder", "mistake", "inaccuracy", "o", "m", "e", "errors", "n_all", "h_all", *(f"{x}_{g}" for g in PR.GROUPS for x in "nh")))} FROM games LEFT JOIN p USING (game_id)),
s AS (SELECT player_id, count(*)::DOUBLE AS n, avg(wp) AS mean_wp_loss, median(wp) AS median_wp_loss, avg(least(cp, 300)) AS mean_cp_loss, sum(blunder) AS b, sum(mistake) AS mi, sum(inaccuracy) AS ina, sum(o) AS o, sum(m) AS m, sum(e) AS e, greatest(sum(errors), 1)::DOUBLE AS er, sum(n_all) AS n_all, sum(h_all) / greatest(sum(n_all), 1)::DOUBLE AS overall,
  {", ".join(f"sum(n_{g}) AS n_{g}, sum(h_{g}) AS h_{g}" for g in PR.GROUPS)}, avg(num_moves) AS mean_moves, avg((won IS TRUE)::INT) AS win_rate, avg((time_class = 'blitz')::INT) AS share_blitz FROM r GROUP BY 1)
SELECT player_id, round(mean_wp_loss + 1e-8, 5)::DOUBLE AS mean_wp_loss, round(median_wp_loss + 1e-8, 5)::DOUBLE AS median_wp_loss, round(mean_cp_loss + 1e-8, 5)::DOUBLE AS mean_cp_loss, round(b / n + 1e-8, 5) AS blunders_pg, round(mi / n + 1e-8, 5) AS mistakes_pg, round(ina / n + 1e-8, 5) AS inaccuracies_pg, round(o / er + 1e-8, 5) AS err_share_opening, round(m / er + 1e-8, 5) AS err_share_middlegame, round(e / er + 1e-8, 5) AS err_share_endgame, round(n_all / n + 1e-8, 5) AS opportunities_pg,
  round(overall + 1e-8, 5) AS hit_rate_all, {", ".join(f"round((h_{g} + 5 * overall) / (n_{g} + 5) + 1e-8, 5) AS hit_rate_{g}" for g in PR.GROUPS)}, round(mean_moves + 1e-8, 5) AS mean_moves, round(win_rate + 1e-8, 5) AS win_rate, round(share_blitz + 1e-8, 5) AS share_blitz FROM s""", ("games", "positions", "arms"))
def a19_player_features(v):
    out = PR.player_features(v("games").select("player_id", "game_id", "num_moves", "won", "time_class"), PR.graded(v("moves")))
    # Averages end in another last bit for another order; a little more keeps the halves among them, exact in binary, from rounding either way.
    return out.select("player_id", *[F.round(F.col(c) + 1e-8, 5).alias(c) for c in PR.PLAYER_FEATURES])


@query("""WITH l AS (SELECT game_id, (l_suppkey % 3)::INT AS level, ply_no, least(0.99, greatest(0.01, (l_partkey % 97) / 97.0))::DOUBLE AS p, l_partkey FROM positions)
SELECT game_id, level, round(sum(ln(p)), 5) AS total, round(ln(arg_min(p, (ply_no, l_partkey, p))), 5) AS first, count(*) AS n FROM l GROUP BY 1, 2""", PV)
def a35_line_logprob(v):
    p = F.least(F.lit(0.99), F.greatest(F.lit(0.01), (F.col("l_partkey") % 97) / 97.0))
    l = v("moves").select("game_id", (F.col("l_suppkey") % 3).cast("int").alias("level"), "ply_no", p.alias("p"), "l_partkey")
    return l.groupBy("game_id", "level").agg(F.round(F.sum(F.log("p")), 5).alias("total"), F.round(F.log(F.min_by("p", F.struct("ply_no", "l_partkey", "p"))), 5).alias("first"), F.count("*").alias("n"))


@query("""WITH c AS (SELECT player_id, category, sum(1 - solved::INT) AS misses, count(*) AS n FROM attempts GROUP BY 1, 2), p AS (SELECT *, (misses + 1) / (n + 2)::DOUBLE AS p FROM c)
SELECT category, round(sum(-(misses * ln(p) + (n - misses) * ln(1 - p))) / sum(n), 6) AS log_loss, round(sum(misses * (1 - p) * (1 - p) + (n - misses) * p * p) / sum(n), 6) AS brier FROM p GROUP BY 1""", AT)
def m2_grouped_scores(v):
    c = v("attempts").groupBy("player_id", "category").agg(F.sum(1 - F.col("solved").cast("int")).alias("m"), F.count("*").alias("n")).withColumn("p", (F.col("m") + 1) / (F.col("n") + 2))
    m, n, p = F.col("m"), F.col("n"), F.col("p")
    return c.groupBy("category").agg(F.round(F.sum(-(m * F.log(p) + (n - m) * F.log(1 - p))) / F.sum("n"), 6).alias("log_loss"), F.round(F.sum(m * (1 - p) ** 2 + (n - m) * p**2) / F.sum("n"), 6).alias("brier"))


@query(f"""WITH {PRED}, s AS (SELECT model, p, sum(y)::DOUBLE AS pos, count(*) AS n FROM pred GROUP BY 1, 2), c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS k FROM s WINDOW w AS (PARTITION BY model ORDER BY p DESC))
SELECT model, round(sum(pos * tp / k) / sum(pos), 6) AS ap FROM c GROUP BY 1""")
def m10_average_precision(v):
    return M.average_precision(_pred(v), ("model",)).select("model", F.round("ap", 6).alias("ap"))


@query(f"WITH {PRED} SELECT model, round(sqrt(greatest(1, avg((mu - t) * (mu - t) - 25))), 6)::DOUBLE AS sd FROM pred GROUP BY 1")
def m18_baseline_with_sd(v):
    e = F.col("mu") - F.col("t")
    return _pred(v).groupBy("model").agg(F.round(F.sqrt(F.greatest(F.lit(1.0), F.avg(e * e - 25))), 6).alias("sd"))


@query("""WITH p AS (SELECT avg(best_cp) FILTER (WHERE l_partkey % 3 = 0) AS low, avg(best_cp) FILTER (WHERE l_partkey % 3 = 1) AS mid, avg(best_cp) FILTER (WHERE l_partkey % 3 = 2) AS high FROM positions) SELECT round(CASE WHEN high - low > 0 THEN (mid - low) / (high - low) END, 6) AS gap FROM p""", PV)
def m20_gap_closed(v):
    of = lambda k: F.avg(F.when(F.col("l_partkey") % 3 == k, F.col("best_cp")))
    p = v("moves").agg(of(0).alias("low"), of(1).alias("mid"), of(2).alias("high"))
    return p.select(F.round(F.when(F.col("high") > F.col("low"), (F.col("mid") - F.col("low")) / (F.col("high") - F.col("low"))), 6).alias("gap"))


@query("SELECT puzzle_id, CASE WHEN a >= b AND a >= c THEN 'A' WHEN b >= c THEN 'B' ELSE 'C' END AS label, round(greatest(a, b, c) / (a + b + c), 6) AS confidence, round(a / (a + b + c) * 400 + 1500, 5) AS rating FROM (SELECT puzzle_id, 1 + seq % 7::DOUBLE AS a, 1 + seq % 5::DOUBLE AS b, 1 + seq % 3::DOUBLE AS c FROM puzzles)", PZ)
def p49_prediction_columns(v):
    s = F.col("seq")
    q = v("puzzles").select("puzzle_id", F.array(*[1 + (s % k).cast("double") for k in (7, 5, 3)]).alias("raw"))
    q = q.withColumn("p", F.transform("raw", lambda x: x / F.aggregate("raw", F.lit(0.0), lambda a, y: a + y)))
    best = F.array_position("raw", F.array_max("raw")).cast("int")
    return q.select("puzzle_id", F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), best).alias("label"), F.round(F.array_max("p"), 6).alias("confidence"), F.round(F.col("p")[0] * 400 + 1500, 5).alias("rating"))


@query("""WITH l AS (SELECT p.puzzle_id, least(1900, greatest(1100, 100 * ceil((p.rating - 50) / 100.0)))::INT AS level, seq FROM puzzles p WHERE p.rating IS NOT NULL AND seq % 9 <> 0)
SELECT puzzle_id, level, round(((seq * 13 + level) % 97) / 97.0::DOUBLE, 6) AS p FROM l""", PZ)
def r19_annotate_find_probability(v):
    z = v("puzzles").where("rating is not null and seq % 9 <> 0").select("puzzle_id", "seq", G.nearest_level(F.col("rating")).alias("level"))
    levels = v("puzzles").select("puzzle_id", F.explode(F.sequence(F.lit(1100), F.lit(1900), F.lit(100))).alias("level"), "seq").select("puzzle_id", "level", (((F.col("seq") * 13 + F.col("level")) % 97) / 97.0).alias("p"))
    return z.join(levels, ["puzzle_id", "level"]).select("puzzle_id", "level", F.round("p", 6).alias("p"))


@query("SELECT player_id, round(1500 + (400 / ln(10)) * (z - ln(0.65::DOUBLE / 0.35) / (1 / sqrt(1 + 3 * 0.2::DOUBLE / (pi() * pi())))), 4) AS target FROM (SELECT player_id, (rating - 1500) / (400 / ln(10)) AS z FROM players)", ("players",))
def r7_r8_target_rating(v):
    z = G.rating_to_logit(F.col("rating")) - G.logit(F.lit(0.65)) / G.kappa(F.lit(0.2))
    return v("players").select("player_id", F.round(G.logit_to_rating(z), 4).alias("target"))


@query(f"""WITH {PRED} SELECT model, CASE WHEN doc_id % 3 = 0 THEN 'val' ELSE 'test' END AS split, count(*) AS n, round(avg((p - y) * (p - y)), 6) AS brier FROM pred GROUP BY 1, 2""")
def a36_model_cards(v):
    rows = _pred(v).withColumn("split", F.when(F.col("doc_id") % 3 == 0, "val").otherwise("test"))
    return M.proper_scores(rows, ("model", "split")).select("model", "split", "n", F.round("brier", 6).alias("brier"))
