"""Queries over learned models and further statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import models as O
from .attempt_queries import PRED, _pred
from .registry import query

A = ("attempts",)
COUNTS = "c AS (SELECT player_id, category, sum(1 - solved::INT) AS misses, count(*) AS n FROM attempts GROUP BY 1, 2)"
RATES = f"""{COUNTS}, x AS (SELECT *, (SELECT sum(misses) / sum(n)::DOUBLE FROM c) AS g FROM c),
b AS (SELECT *, (sum(misses) OVER (PARTITION BY category) + 2 * g) / (sum(n) OVER (PARTITION BY category) + 2) AS cat, (sum(misses) OVER (PARTITION BY player_id) + 4 * g) / (sum(n) OVER (PARTITION BY player_id) + 4) AS player FROM x)"""


def _counts(v):
    return v("attempts").groupBy("player_id", "category").agg(F.sum(1 - F.col("solved").cast("int")).alias("misses"), F.count("*").alias("n"))


@query(f"WITH {RATES} SELECT player_id, category, round(g, 9) AS g, round(cat, 9) AS cat, round(player, 9) AS player FROM b", A)
def a18_l3_base_rates(v):
    return O.base_rates(_counts(v)).select("player_id", "category", *[F.round(c, 9).alias(c) for c in ("g", "cat", "player")])


@query(f"""WITH {RATES}, t AS (SELECT player_id, sum(misses) AS m, sum(n) AS k FROM b GROUP BY 1), e AS (SELECT b.*, CASE WHEN n >= 3 THEN (n - misses + 8 * (1 - m / k::DOUBLE)) / (n + 8) END AS rate, 1 - m / k::DOUBLE AS overall FROM b JOIN t USING (player_id))
SELECT player_id, category, x.model, round(x.p, 9) AS p FROM (SELECT player_id, category, unnest([{{'model': 'global', 'p': g}}, {{'model': 'category', 'p': cat}}, {{'model': 'player', 'p': player}}, {{'model': 'empirical', 'p': 1 - coalesce(rate, nullif(overall, 0), 0.5)}}]) AS x FROM e)""", A)
def l3_baselines(v):
    """Rates of categories with three attempts are shrunk to the player's own with a strength of 8."""
    rows = O.base_rates(_counts(v))
    own = rows.groupBy("player_id").agg((1 - F.sum("misses") / F.sum("n")).alias("overall"))
    rate = F.when(F.col("n") >= 3, (F.col("n") - F.col("misses") + 8 * F.col("overall")) / (F.col("n") + 8))
    return O.baselines(rows.join(own, "player_id").withColumn("rate", rate)).select("player_id", "category", "model", F.round("p", 9).alias("p"))


def _lg(x):
    return f"ln(least(0.98, greatest(0.02, {x}))::DOUBLE / (1 - least(0.98, greatest(0.02, {x}))::DOUBLE))"


@query(f"""WITH h AS (SELECT player_id, category, solved, (row_number() OVER (PARTITION BY player_id ORDER BY ts, attempt_id) - 1) % 2 AS half FROM attempts), c AS (SELECT player_id, category, sum(1 - solved::INT) AS misses, count(*) AS n FROM h WHERE half = 0 GROUP BY 1, 2), e AS (SELECT player_id, category, sum(1 - solved::INT) AS test_misses, count(*) AS test_n FROM h WHERE half = 1 GROUP BY 1, 2),
x AS (SELECT *, (SELECT sum(misses) / sum(n)::DOUBLE FROM c) AS g FROM c), b AS (SELECT *, (sum(misses) OVER (PARTITION BY category) + 2 * g) / (sum(n) OVER (PARTITION BY category) + 2) AS cat, (sum(misses) OVER (PARTITION BY player_id) + 4 * g) / (sum(n) OVER (PARTITION BY player_id) + 4) AS player FROM x),
t AS (SELECT b.*, test_misses, test_n, s, 1 / (1 + exp(-({_lg('player')} + {_lg('cat')} - {_lg('g')}))) AS prior FROM b JOIN e USING (player_id, category) CROSS JOIN (SELECT unnest([1, 2, 4, 8, 16, 32, 64, 128, 256, 512])::DOUBLE AS s)),
p AS (SELECT *, least(greatest((misses + s * prior) / (n + s), 1e-4), 1 - 1e-4) AS p FROM t), l AS (SELECT player_id % 3 AS fold, s, sum(-(test_misses * ln(p) + (test_n - test_misses) * ln(1 - p))) AS loss, sum(test_n) AS n FROM p GROUP BY 1, 2),
o AS (SELECT *, (sum(loss) OVER (PARTITION BY s) - loss) / (sum(n) OVER (PARTITION BY s) - n) AS others FROM l) SELECT fold, s, round(loss / n, 6) AS log_loss FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY round(others, 9), s) AS rn FROM o) WHERE rn = 1""", A)
def l2_hierarchical_eb(v):
    w = Window.partitionBy("player_id").orderBy("ts", "attempt_id")
    h = v("attempts").select("player_id", "category", (1 - F.col("solved").cast("int")).alias("miss"), ((F.row_number().over(w) - 1) % 2).alias("half"))
    train = h.where("half = 0").groupBy("player_id", "category").agg(F.sum("miss").alias("misses"), F.count("*").alias("n"))
    test = h.where("half = 1").groupBy("player_id", "category").agg(F.sum("miss").alias("test_misses"), F.count("*").alias("test_n"))
    rated = O.base_rates(train).join(test, ["player_id", "category"]).withColumn("fold", F.col("player_id") % 3)
    return O.strength_by_fold(rated).select("fold", "s", F.round("log_loss", 6).alias("log_loss"))


@query()
def l4_isotonic_calibration(v):
    return O.isotonic(_pred(v).where("model = 'length'").select("doc_id", F.col("p").alias("score"), F.col("y").cast("double").alias("y"), F.lit(1.0).alias("w"))).select("doc_id", F.round("p", 6).alias("p"))


@query()
def l5_miss_forest(v):
    rows = O.base_rates(_counts(v)).withColumns({"rate": F.col("misses") / F.col("n"), "n": F.col("n").cast("double"), "log_n": F.log("n")})
    train, test = rows.where("player_id % 3 <> 0"), rows.where("player_id % 3 = 0")
    return O.miss_forest(train, test, ("cat", "player", "log_n")).select("player_id", "category", F.round("prediction", 4).alias("prediction"))


@query()
def l6_band_classifier(v):
    e = v("embeddings").select("vec_id", "embedding", F.col("label").cast("double").alias("label"))
    return O.classify(e.where("vec_id % 4 <> 0"), e.where("vec_id % 4 = 0"), "embedding", "label").select("vec_id", "label", "prediction")


@query()
def l8_rating_regressor(v):
    g = v("games").groupBy("player_id").agg(F.count("*").cast("double").alias("n"), F.avg("num_moves").alias("moves"), F.avg(F.col("won").cast("double")).alias("won")).na.fill(0.5)
    rows = g.join(v("players").select("player_id", F.col("rating").cast("double").alias("rating")), "player_id")
    return O.regress(rows.where("player_id % 3 <> 0"), rows.where("player_id % 3 = 0"), ("n", "moves", "won"), "rating", "forest").select("player_id", "rating", F.round("prediction", 3).alias("prediction"))


@query()
def l11_difficulty_regression(v):
    rows = v("puzzles").select("puzzle_id", "seq", F.col("rating").cast("double").alias("rating"), F.least(F.length("moves"), F.lit(60)).cast("double").alias("length"), F.col("themes").contains("mate").cast("double").alias("mate")).na.fill(0.0)
    return O.regress(rows.where("seq % 5 <> 0"), rows.where("seq % 5 = 0"), ("length", "mate"), "rating").select("puzzle_id", "rating", F.round("prediction", 3).alias("prediction"))


@query("""WITH g AS (SELECT exp(ln(0.1::DOUBLE) + (ln(10::DOUBLE) - ln(0.1::DOUBLE)) * i / 40) AS t FROM (SELECT unnest(range(0, 41)) AS i)), d AS (SELECT quality AS y, (n_chars % 200 - 100) / 25.0::DOUBLE AS z FROM labels JOIN documents USING (doc_id)),
p AS (SELECT t, y, least(greatest(1 / (1 + exp(-z / t)), 1e-12), 1 - 1e-12) AS p FROM d, g) SELECT round(t, 6) AS t, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS nll FROM p GROUP BY p.t ORDER BY avg(-(y * ln(p) + (1 - y) * ln(1 - p))), p.t LIMIT 1""")
def l13_temperature_fit(v):
    d = v("labels").join(v("documents").select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("y"), ((F.col("n_chars") % 200 - 100) / 25.0).alias("z"))
    return O.temperature(d).select(F.round("t", 6).alias("t"), F.round("nll", 6).alias("nll"))


@query("SELECT puzzle_id, round((rating - avg(rating) OVER ()) / greatest(stddev_pop(rating) OVER (), 0.001), 6)::DOUBLE AS rating_z FROM puzzles", ("puzzles",))
def l14_standardise(v):
    return O.standardise(v("puzzles").select("puzzle_id", "rating"), "rating").select("puzzle_id", F.round("rating_z", 6).alias("rating_z"))


@query(f"""WITH {PRED}, w AS (SELECT doc_id, y, max(p) FILTER (WHERE model = 'length') > 0.75 AS a, max(p) FILTER (WHERE model = 'hash') > 0.5 AS b FROM pred GROUP BY 1, 2)
SELECT count(*) FILTER (WHERE a = (y = 1) AND b <> (y = 1)) AS only_a, count(*) FILTER (WHERE a <> (y = 1) AND b = (y = 1)) AS only_b FROM w""")
def m12_mcnemar(v):
    w = _pred(v).groupBy("doc_id", "y").agg((F.max(F.when(F.col("model") == "length", F.col("p"))) > 0.75).alias("a"), (F.max(F.when(F.col("model") == "hash", F.col("p"))) > 0.5).alias("b"))
    t = F.col("y") == 1
    return w.agg(F.count_if((F.col("a") == t) & (F.col("b") != t)).alias("only_a"), F.count_if((F.col("a") != t) & (F.col("b") == t)).alias("only_b"))


@query(f"""WITH {PRED}, s AS (SELECT y, count(*) AS n, avg(p) AS m, var_samp(p) AS v FROM pred WHERE model = 'length' GROUP BY 1), x AS (SELECT * FROM s WHERE y = 1), z AS (SELECT * FROM s WHERE y = 0)
SELECT round((x.m - z.m) / sqrt(x.v / x.n + z.v / z.n), 6) AS t, round((x.m - z.m) / sqrt(((x.n - 1) * x.v + (z.n - 1) * z.v) / (x.n + z.n - 2)), 6) AS d FROM x, z""")
def m16_welch_d(v):
    of = lambda f, k: f(F.when(F.col("y") == k, F.col("p")))
    p = _pred(v).where("model = 'length'").agg(*[of(f, k).alias(f"{name}{k}") for k in (0, 1) for f, name in ((F.avg, "m"), (F.var_samp, "v"), (F.count, "n"))])
    c = F.col
    t = (c("m1") - c("m0")) / F.sqrt(c("v1") / c("n1") + c("v0") / c("n0"))
    d = (c("m1") - c("m0")) / F.sqrt(((c("n1") - 1) * c("v1") + (c("n0") - 1) * c("v0")) / (c("n1") + c("n0") - 2))
    return p.select(F.round(t, 6).alias("t"), F.round(d, 6).alias("d"))


@query()
def m4_bootstrap_ci(v):
    p = _pred(v).select("model", "doc_id", ((F.col("p") - F.col("y")) ** 2).alias("loss"), F.lit(1.0).alias("one"))
    return M.bootstrap(p, ("model",), "loss", "one", "doc_id", 100)


@query("""WITH r AS (SELECT player_id, ((row_number() OVER (PARTITION BY player_id ORDER BY ts, attempt_id) - 1) % 2)::INT AS half, category, solved FROM attempts),
h AS (SELECT player_id, category, half, count(*) AS n, avg(solved::INT) AS rate FROM r GROUP BY 1, 2, 3), o AS (SELECT player_id, half, avg(solved::INT) AS own FROM r GROUP BY 1, 2),
d AS (SELECT a.category, a.rate - oa.own AS x, b.rate - ob.own AS y FROM h a JOIN h b ON a.player_id = b.player_id AND a.category = b.category AND a.half = 0 AND b.half = 1 JOIN o oa ON oa.player_id = a.player_id AND oa.half = 0 JOIN o ob ON ob.player_id = a.player_id AND ob.half = 1),
c AS (SELECT category, count(*) AS n, covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0) AS r FROM d GROUP BY 1)
SELECT category, n, round(r, 5) AS r, round(2 * r / nullif(1 + r, 0), 5) AS spearman_brown FROM c WHERE n >= 5""", A)
def a27_split_half(v):
    w = Window.partitionBy("player_id").orderBy("ts", "attempt_id")
    r = v("attempts").select("player_id", ((F.row_number().over(w) - 1) % 2).alias("half"), "category", F.col("solved").cast("int").alias("s"))
    own = F.avg("s")
    h = r.groupBy("player_id", "category", "half").agg(own.alias("rate"))
    o = r.groupBy("player_id", "half").agg(own.alias("own"))
    d = h.join(o, ["player_id", "half"]).withColumn("d", F.col("rate") - F.col("own"))
    both = d.groupBy("player_id", "category").pivot("half", [0, 1]).agg(F.first("d")).where("`0` is not null and `1` is not null")
    c = both.groupBy("category").agg(F.count("*").alias("n"), M.correlation(F.col("0"), F.col("1")).alias("r")).where("n >= 5")
    return c.select("category", "n", F.round("r", 5).alias("r"), F.round(F.try_divide(2 * F.col("r"), 1 + F.col("r")), 5).alias("spearman_brown"))
