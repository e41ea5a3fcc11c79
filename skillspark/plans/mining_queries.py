"""Queries over mined puzzles, game filters and edits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import mining as O
from ..operators.metrics import running
from .registry import query

PV = ("positions", "arms")
KEY = ("game_id", "ply_no", "l_partkey", "l_suppkey")


@query("SELECT game_id, ply_no, l_partkey, l_suppkey, best_cp - after_cp AS eval_drop FROM positions WHERE abs(best_cp) <= 800 AND (second_cp IS NULL OR best_cp - second_cp >= 100) AND best_cp - after_cp >= 150", PV)
def f11_mine_gates(v):
    return O.candidate_gates(v("moves")).select(*KEY, "eval_drop")


LINES = "lines AS (SELECT game_id AS line_id, ply_no - 1 AS ply, min(best_cp - second_cp) AS gap FROM positions GROUP BY 1, 2)"


def _lines(v):
    return v("moves").groupBy(F.col("game_id").alias("line_id"), (F.col("ply_no") - 1).alias("ply")).agg(F.min(F.col("best_cp") - F.col("second_cp")).alias("gap"))


@query(f"""WITH {LINES}, h AS (SELECT *, CASE WHEN ply % 2 = 1 THEN coalesce(gap >= 100, true) ELSE coalesce(gap >= 80, true) END AS holds FROM lines WHERE ply < 6),
w AS (SELECT *, bool_and(holds) OVER (PARTITION BY line_id ORDER BY ply) AS whole FROM h),
c AS (SELECT line_id, count(*) FILTER (WHERE whole) AS n, min(ply) FILTER (WHERE NOT whole) AS broken FROM w GROUP BY 1)
SELECT line_id, n - CASE WHEN broken % 2 = 1 AND n > 0 THEN 1 ELSE 0 END AS n_plies FROM c""", PV)
def w10_continuation_gate(v):
    return O.forced_prefix(_lines(v))


@query(f"""WITH {LINES}, h AS (SELECT *, line_id % 5 <> ply AND coalesce(gap >= 100, true) AS good FROM lines), w AS (SELECT *, bool_and(good) OVER (PARTITION BY line_id ORDER BY ply) AS whole FROM h),
c AS (SELECT line_id AS puzzle_id, count(*) AS n_moves, count(*) FILTER (WHERE whole) AS kept FROM w GROUP BY 1)
SELECT *, CASE WHEN kept = 0 THEN 'retired' WHEN kept < n_moves THEN 'cut' ELSE 'unchanged' END AS status FROM c""", PV)
def w11_uniqueness_recheck(v):
    moves = _lines(v).select(F.col("line_id").alias("puzzle_id"), F.col("ply").alias("move_no"), (F.col("line_id") % 5 != F.col("ply")).alias("first_choice"), "gap")
    return O.cut_ambiguous(moves)


@query(f"""WITH {LINES}, h AS (SELECT *, line_id % 5 <> ply AND coalesce(gap >= 100, true) AS good FROM lines), w AS (SELECT *, bool_and(good) OVER (PARTITION BY line_id ORDER BY ply) AS whole FROM h),
c AS (SELECT line_id, count(*) AS n_moves, count(*) FILTER (WHERE whole) AS kept FROM w GROUP BY 1)
SELECT line_id % 7 AS player, count(*) FILTER (WHERE kept = n_moves) AS unchanged, count(*) FILTER (WHERE kept > 0 AND kept < n_moves) AS cut, count(*) FILTER (WHERE kept = 0) AS retired FROM c GROUP BY ROLLUP (line_id % 7)""", PV)
def a31_uniqueness_totals(v):
    out = w11_uniqueness_recheck(v)
    is_ = lambda s: F.count_if(F.col("status") == s).alias(s)
    return out.withColumn("player", F.col("puzzle_id") % 7).rollup("player").agg(is_("unchanged"), is_("cut"), is_("retired"))


MINED = """mined AS (SELECT game_id * 100000 + l_partkey * 10 + ply_no AS seq, game_id, category, CONCAT('f', CAST(l_partkey % 500 AS STRING)) AS fen FROM positions WHERE best_cp - after_cp >= 100)"""


@query(f"""WITH {MINED}, m AS (SELECT seq, any_value(game_id) AS game_id, any_value(category) AS category, any_value(fen) AS fen FROM mined GROUP BY seq), g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY seq) AS rn FROM m) WHERE rn <= 2),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fen ORDER BY seq) AS k FROM g) WHERE k = 1)
SELECT seq, category FROM d ORDER BY category NOT IN ('Fork', 'Pin'), seq LIMIT 60""", PV)
def w9_t3_mining_caps(v):
    p = v("moves").where("best_cp - after_cp >= 100").select((F.col("game_id") * 100000 + F.col("l_partkey") * 10 + F.col("ply_no")).alias("seq"), "game_id", "category", F.concat(F.lit("f"), (F.col("l_partkey") % 500).cast("string")).alias("fen"))
    return O.caps(p.dropDuplicates(["seq"]), 60, 2, ("Fork", "Pin")).select("seq", "category")


QUALITY = """q AS (SELECT game_id, ply_no, l_partkey, l_suppkey, best_cp > 0 AS engine_agrees, best_cp - second_cp AS clarity_cp, ply_no % 5 AS solution_moves, best_cp > 700 AS trivial, best_cp - 300 AS rating_gap FROM positions WHERE second_cp IS NOT NULL)"""


@query(f"""WITH {QUALITY}, s AS (SELECT *, CASE WHEN engine_agrees THEN 0.30 ELSE 0 END + CASE WHEN clarity_cp >= 150 THEN 0.25 WHEN clarity_cp >= 80 THEN 0.12 ELSE 0 END
 + CASE WHEN solution_moves >= 3 THEN 0.20 ELSE 0 END + CASE WHEN NOT trivial THEN 0.15 ELSE 0 END + CASE WHEN abs(rating_gap) <= 300 THEN 0.10 ELSE 0 END AS s, l_partkey % 7 AS n_moves, l_suppkey % 11 <> 0 AS legal FROM q)
SELECT game_id, ply_no, l_partkey, l_suppkey, CASE WHEN n_moves < 2 OR NOT legal THEN 0 ELSE round(s, 4)::DOUBLE END AS score, n_moves >= 2 AND legal AND round(s, 9) >= 0.60 AS passed,
  CASE WHEN n_moves < 2 THEN 'fewer than 2 moves' WHEN NOT legal THEN 'illegal first move' ELSE concat_ws('; ', CASE WHEN clarity_cp < 150 THEN 'unclear' END, CASE WHEN NOT engine_agrees THEN 'engine disagrees' END, CASE WHEN solution_moves < 3 THEN 'too shallow' END, CASE WHEN trivial THEN 'trivial' END, CASE WHEN abs(rating_gap) > 300 THEN 'off difficulty' END) END AS issues FROM s""", PV)
def p44_quality_score(v):
    b = F.col("best_cp")
    q = v("moves").where("second_cp is not null").select(
        *KEY, (b > 0).alias("engine_agrees"), (b - F.col("second_cp")).alias("clarity_cp"), (F.col("ply_no") % 5).alias("solution_moves"), (b > 700).alias("trivial"), (b - 300).alias("rating_gap"),
        (F.col("l_partkey") % 7).alias("n_moves"), (F.col("l_suppkey") % 11 != 0).alias("first_legal"),
    )
    return O.quality_score(q).select(*KEY, F.round("score", 4).alias("score"), "passed", F.array_join("issues", "; ").alias("issues"))


@query("""WITH m AS (SELECT game_id AS line_id, ply_no - 1 AS move_no, category, arm_id, best_cp > 850 AS mate, l_suppkey % 3 = 0 AS is_key FROM positions JOIN arms USING (category)),
b AS (SELECT line_id, arg_min(category, (arm_id, category)) AS motif FROM m WHERE move_no < 4 AND (category <> 'Quiet Move' OR is_key) GROUP BY 1), w AS (SELECT line_id, bool_or(mate) AS mate FROM m GROUP BY 1)
SELECT line_id, CASE WHEN mate THEN 'Mating Pattern' ELSE coalesce(motif, 'Endgame') END AS label FROM w LEFT JOIN b USING (line_id)""", PV)
def p11_resolve_line_label(v):
    arms = v("arms").select("category", F.col("arm_id").alias("motif_rank"))
    m = v("moves").join(F.broadcast(arms), "category").select(F.col("game_id").alias("line_id"), (F.col("ply_no") - 1).alias("move_no"), F.col("category").alias("motif"), "motif_rank", (F.col("best_cp") > 850).alias("is_mate"), (F.col("l_suppkey") % 3 == 0).alias("is_key"), F.lit("Endgame").alias("endgame"))
    return O.resolve_label(m)


@query("SELECT player_id, count(*) AS n FROM games GROUP BY 1 HAVING count(*) >= 15", ("games",))
def f9_min_games(v):
    return v("games").groupBy("player_id").agg(F.count("*").alias("n")).where("n >= 15")


@query("SELECT a.puzzle_id, a.attempt_id, coalesce(f.fitted, a.rating)::INT AS rating FROM attempts a LEFT JOIN (SELECT puzzle_id, rating + 25 AS fitted FROM puzzles WHERE seq % 2 = 0) f USING (puzzle_id)", ("attempts", "puzzles"))
def j10_j13_fitted_rating(v):
    fitted = v("puzzles").where("seq % 2 = 0").select("puzzle_id", (F.col("rating") + 25).alias("fitted"))
    return v("attempts").join(fitted, "puzzle_id", "left").select("puzzle_id", "attempt_id", F.coalesce("fitted", "rating").cast("int").alias("rating"))


@query("""WITH e AS (SELECT attempt_id AS seq, player_id, puzzle_id, CASE WHEN attempt_id % 5 = 0 THEN 'delete' ELSE 'feedback' END AS action, CASE attempt_id % 3 WHEN 0 THEN 'liked' WHEN 1 THEN 'disliked' END AS feedback FROM attempts WHERE attempt_id % 4 = 0),
s AS (SELECT DISTINCT player_id, puzzle_id, 'old' AS feedback FROM attempts), l AS (SELECT player_id, puzzle_id, arg_max(action, seq) AS action, max((seq, feedback)) AS f FROM e GROUP BY 1, 2)
SELECT player_id, puzzle_id, CASE WHEN action = 'feedback' THEN f[2] ELSE feedback END AS feedback FROM s LEFT JOIN l USING (player_id, puzzle_id) WHERE action IS NULL OR action <> 'delete'""", ("attempts",))
def k10_apply_puzzle_edits(v):
    from ..sources.writers import apply_edits

    a = v("attempts")
    m = F.col("attempt_id")
    e = a.where(m % 4 == 0).select(m.alias("seq"), "player_id", "puzzle_id", F.when(m % 5 == 0, "delete").otherwise("feedback").alias("action"), F.when(m % 3 == 0, "liked").when(m % 3 == 1, "disliked").alias("feedback"))
    return apply_edits(a.select("player_id", "puzzle_id").distinct().withColumn("feedback", F.lit("old")), e)


@query("""WITH e AS (SELECT attempt_id AS seq, player_id, puzzle_id, CASE WHEN attempt_id % 5 = 0 THEN 'delete' ELSE 'feedback' END AS action FROM attempts WHERE attempt_id % 4 = 0), s AS (SELECT DISTINCT player_id, puzzle_id FROM attempts WHERE attempt_id % 3 = 0), d AS (SELECT player_id, puzzle_id, min(seq) AS gone FROM e WHERE action = 'delete' GROUP BY 1, 2)
SELECT e.player_id, e.puzzle_id, seq, action, 'unknown puzzle' AS error FROM e LEFT JOIN s ON s.player_id = e.player_id AND s.puzzle_id = e.puzzle_id LEFT JOIN d ON d.player_id = e.player_id AND d.puzzle_id = e.puzzle_id WHERE s.player_id IS NULL OR seq > gone""", ("attempts",))
def k10_edit_errors(v):
    from ..sources.writers import edit_errors

    a = v("attempts")
    m = F.col("attempt_id")
    e = a.where(m % 4 == 0).select(m.alias("seq"), "player_id", "puzzle_id", F.when(m % 5 == 0, "delete").otherwise("feedback").alias("action"), F.lit(None).cast("string").alias("feedback"))
    return edit_errors(a.where(m % 3 == 0).select("player_id", "puzzle_id").distinct(), e)


@query("SELECT category, count(*) AS n, round(100.0 * count(*) / (sum(count(*)) OVER ()), 4)::DOUBLE AS pct FROM attempts WHERE starts_with(puzzle_id, 'gen_') GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5", ("attempts",))
def a12_missed_tactics(v):
    n = v("attempts").where(F.col("puzzle_id").startswith("gen_")).groupBy("category").agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4)).orderBy(F.desc("n"), "category").limit(5)


@query("""WITH o AS (SELECT game_id, 'white' AS side, player_id AS source, (player_id * 7 + game_id) % 50 AS opponent FROM games UNION ALL SELECT game_id, 'black', player_id, (player_id * 11 + game_id) % 50 FROM games),
d AS (SELECT DISTINCT source, opponent FROM o WHERE source <> opponent) SELECT source, opponent FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(source::VARCHAR || '-' || opponent::VARCHAR), opponent) AS rn FROM d) WHERE rn <= 4""", ("games",))
def j9_opponent_snowball(v):
    p, g = F.col("player_id"), F.col("game_id")
    sides = F.array(*[F.struct(F.lit(s).alias("side"), ((p * k + g) % 50).alias("opponent")) for s, k in (("white", 7), ("black", 11))])
    d = v("games").select(p.alias("source"), F.explode(sides).alias("x")).select("source", "x.opponent").where("source <> opponent").distinct()
    h = F.md5(F.concat(F.col("source").cast("string"), F.lit("-"), F.col("opponent").cast("string")).cast("binary"))
    w = Window.partitionBy("source").orderBy(h, "opponent")
    return d.withColumn("rn", F.row_number().over(w)).where("rn <= 4").select("source", "opponent")


@query("""WITH b AS (SELECT CASE WHEN rating < 1000 THEN 0 WHEN rating < 1400 THEN 1 WHEN rating < 1800 THEN 2 WHEN rating < 2200 THEN 3 ELSE 4 END AS band, player_id FROM players), i AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY player_id) AS rn FROM b)
SELECT player_id, band, (row_number() OVER (ORDER BY rn, band))::INT AS place FROM i""", ("players",))
def w13_band_interleave(v):
    from ..functions.games import rating_band

    b = v("players").select("player_id", F.coalesce(rating_band(F.col("rating")), F.lit(4)).alias("band"))
    # A band's players are ranked in ranges of ids, as there are five bands only.
    b = running(b.withColumn("one", F.lit(1).cast("long")), ("band",), "player_id", {"earlier": "one"}).select("player_id", "band", (F.col("earlier") + 1).alias("rn"))
    # Place = all of earlier rounds, and bands before this one in this round: from the bands' sizes, five numbers.
    sizes = b.groupBy("band").agg(F.count("*").alias("size")).agg(F.map_from_entries(F.collect_list(F.struct("band", "size"))).alias("sizes"))
    n = F.col("rn")
    earlier = F.aggregate(F.map_entries("sizes"), F.lit(0).cast("long"), lambda acc, e: acc + F.least(e["value"], n - 1) + F.when((e["key"] < F.col("band")) & (e["value"] >= n), 1).otherwise(0))
    return b.crossJoin(F.broadcast(sizes)).select("player_id", "band", (earlier + 1).cast("int").alias("place"))


@query("""WITH d AS (SELECT c.player_id, avg(a.solved::INT) AS x, avg(c.wl) AS y FROM attempts a JOIN (SELECT player_id, count(*) FILTER (WHERE won) / count(*)::DOUBLE AS wl FROM games GROUP BY 1) c USING (player_id) GROUP BY 1)
SELECT count(*) AS n, round(avg(y - x), 6) AS diff, round(stddev_samp(y - x), 6) AS sd, round(avg(y - x) / stddev_samp(y - x), 6) AS dz FROM d""", ("attempts", "games"))
def m13_paired_summary(v):
    x = v("attempts").groupBy("player_id").agg(F.avg(F.col("solved").cast("int")).alias("x"))
    y = v("games").groupBy("player_id").agg((F.count_if("won") / F.count("*")).alias("y"))
    d = x.join(y, "player_id").withColumn("d", F.col("y") - F.col("x"))
    return d.agg(F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("diff"), F.round(F.stddev_samp("d"), 6).alias("sd"), F.round(F.avg("d") / F.stddev_samp("d"), 6).alias("dz"))


@query("""WITH r AS (SELECT player_id, category, avg(solved::INT) AS rate FROM attempts GROUP BY 1, 2 HAVING count(*) >= 2),
p AS (SELECT a.category AS a, b.category AS b, count(*) AS n, covar_samp(a.rate, b.rate) AS c, stddev_samp(a.rate) * stddev_samp(b.rate) AS s FROM r a JOIN r b ON a.player_id = b.player_id AND a.category < b.category GROUP BY 1, 2)
SELECT a, b, n, round(c / nullif(s, 0), 6) AS r FROM p WHERE n >= 5""", ("attempts",))
def a29_family_correlation(v):
    r = v("attempts").groupBy("player_id", "category").agg(F.count("*").alias("k"), F.avg(F.col("solved").cast("int")).alias("rate")).where("k >= 2")
    x, y = r.select("player_id", F.col("category").alias("a"), F.col("rate").alias("x")), r.select("player_id", F.col("category").alias("b"), F.col("rate").alias("y"))
    return x.join(y, "player_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.round(M.correlation(F.col("x"), F.col("y")), 6).alias("r")).where("n >= 5")
