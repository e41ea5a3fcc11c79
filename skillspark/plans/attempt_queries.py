"""Queries over attempts and predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import games as G
from ..operators import attempts as O
from ..operators import serving as SV
from ..operators import metrics as M
from .profile_queries import ARM_LIST
from .registry import query

AP = ("attempts", "players", "arms")
KNOWN = f"k AS (SELECT * FROM attempts WHERE category IN {ARM_LIST})"


def r(df, *names, n=6):
    return df.withColumns({c: F.round(c, n) for c in names})


@query("SELECT attempt_id FROM attempts WHERE solved IS NOT NULL AND rating <> 0 AND NOT skipped", AP)
def f8_valid_attempts(v):
    return O.valid(v("attempts")).select("attempt_id")


@query("SELECT attempt_id, coalesce(p.rating, 1500)::DOUBLE AS player_rating, round(1 / (1 + pow(10::DOUBLE, (a.rating - coalesce(p.rating, 1500)) / 400.0)), 6) AS p FROM attempts a LEFT JOIN players p USING (player_id)", AP)
def j3_p37_attempts_with_context(v):
    a = O.with_context(v("attempts"), v("players"))
    return r(a.select("attempt_id", "player_rating", G.static_elo(F.col("rating"), F.col("player_rating")).alias("p")), "p")


@query(f"""WITH {KNOWN}, i AS (SELECT *, sum(1 - solved::INT) OVER (PARTITION BY player_id ORDER BY ts, attempt_id) AS island FROM k),
r AS (SELECT player_id, island, count(*) FILTER (WHERE solved) AS run FROM i GROUP BY 1, 2)
SELECT player_id, max_by(run, island) AS current, max(run) AS best FROM r GROUP BY 1""", AP)
def w4_streaks(v):
    return O.streaks(v("attempts"))


@query("SELECT attempt_id, round((1 + coalesce(sum(solved::INT) OVER w, 0)) / (2 + count(*) OVER w)::DOUBLE, 9)::DOUBLE AS base_rate FROM attempts WINDOW w AS (ORDER BY ts, attempt_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", AP)
def w5_running_base_rate(v):
    return r(O.running_base_rate(v("attempts")).select("attempt_id", "base_rate"), "base_rate", n=9)


BETA = """sums AS (SELECT player_id, category, sum(CASE WHEN solved THEN weight ELSE 0 END) AS a, sum(CASE WHEN solved THEN 0 ELSE weight END) AS b, count(*) AS n FROM kw GROUP BY 1, 2)
SELECT g.player_id, g.category, round(1 + coalesce(a, 0), 6)::DOUBLE AS alpha, round(1 + coalesce(b, 0), 6)::DOUBLE AS beta, coalesce(n, 0) AS n FROM (SELECT DISTINCT player_id, a.category FROM k CROSS JOIN (SELECT category FROM arms WHERE arm_id < 23) a) g LEFT JOIN sums USING (player_id, category)"""


@query(f"WITH {KNOWN}, kw AS (SELECT *, 1.0::DOUBLE AS weight FROM k), {BETA}", AP)
def r1_beta_posterior(v):
    return r(O.beta_posterior(v("attempts"), v("arms")).select("player_id", "category", "alpha", "beta", "n"), "alpha", "beta")


@query(f"WITH {KNOWN}, kw AS (SELECT *, pow(0.97::DOUBLE, row_number() OVER (PARTITION BY player_id ORDER BY ts DESC, attempt_id DESC) - 1) AS weight FROM k), {BETA}", AP)
def r2_w12_beta_discounted(v):
    return r(O.beta_posterior(v("attempts"), v("arms"), 0.97).select("player_id", "category", "alpha", "beta", "n"), "alpha", "beta")


@query(f"""WITH {KNOWN}, s AS (SELECT player_id, category, count(*) FILTER (WHERE solved) AS a, count(*) AS n FROM k GROUP BY 1, 2),
g AS (SELECT p.player_id, a.category, arm_id, (1 + coalesce(s.a, 0)) / (2 + coalesce(n, 0))::DOUBLE AS rate FROM (SELECT DISTINCT player_id FROM k) p CROSS JOIN (SELECT * FROM arms WHERE arm_id < 23) a LEFT JOIN s ON s.player_id = p.player_id AND s.category = a.category)
SELECT player_id, category, rank::INT AS rank, round(rate, 4) AS rate FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY rate, arm_id) AS rank FROM g) WHERE rank <= 3""", AP)
def t1_top_weaknesses(v):
    from ..operators.profile import top_weaknesses

    rates = O.beta_posterior(v("attempts"), v("arms")).drop("arm_id")
    return top_weaknesses(rates, v("arms"), 3).select("player_id", "category", F.col("rank").cast("int").alias("rank"), F.round("rate", 4).alias("rate"))


@query("WITH f AS (SELECT player_id, puzzle_id, min((ts, attempt_id)) AS first FROM attempts GROUP BY 1, 2) SELECT player_id, puzzle_id, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY first DESC, puzzle_id) AS place FROM f) WHERE place <= 20", AP)
def w8_seen_history(v):
    return O.seen_history(v("attempts"), 20)


@query("SELECT DISTINCT c.player_id, c.puzzle_id FROM (SELECT player_id, concat('p', ((attempt_id * 11) % 200)::VARCHAR) AS puzzle_id FROM attempts) c ANTI JOIN attempts x ON x.player_id = c.player_id AND x.puzzle_id = c.puzzle_id", AP)
def j5_anti_seen(v):
    a = v("attempts")
    candidates = a.select("player_id", F.concat(F.lit("p"), ((F.col("attempt_id") * 11) % 200).cast("string")).alias("puzzle_id")).distinct()
    return O.unseen(candidates, a)


@query("SELECT player_id, attempt_id, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY ts DESC, attempt_id DESC) AS place FROM attempts) WHERE place <= 20", AP)
def w15_latest_n(v):
    return O.latest(v("attempts"), 20).select("player_id", "attempt_id", "place")


@query("""WITH t AS (SELECT player_id, count(*) AS n, 100.0::DOUBLE * count(*) FILTER (WHERE solved) / count(*) AS accuracy FROM attempts GROUP BY 1),
l AS (SELECT player_id, 100.0::DOUBLE * count(*) FILTER (WHERE solved) / count(*) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY ts DESC, attempt_id DESC) AS place FROM attempts) WHERE place <= 20 GROUP BY 1),
c AS (SELECT player_id, count(*) AS categories FROM (SELECT player_id, category FROM attempts GROUP BY 1, 2 HAVING count(*) >= 3) GROUP BY 1)
SELECT player_id, n, round(accuracy, 6) AS accuracy, round(recent, 6) AS recent, coalesce(categories, 0) AS categories FROM t JOIN l USING (player_id) LEFT JOIN c USING (player_id)""", AP)
def a13_attempt_stats(v):
    return r(O.attempt_stats(v("attempts")), "accuracy", "recent")


@query("""WITH s AS (SELECT attempt_id AS serve_id, player_id, puzzle_id, ts FROM attempts WHERE attempt_id % 3 = 0), x AS (SELECT player_id, puzzle_id, ts, 0 AS is_result, serve_id, NULL::BIGINT AS attempt_id FROM s UNION ALL SELECT player_id, puzzle_id, ts, 1, NULL, attempt_id FROM attempts WHERE attempt_id % 3 <> 1)
SELECT player_id, puzzle_id, attempt_id, CASE WHEN was = 0 THEN by_ END AS serve_id FROM (SELECT *, lag(is_result) OVER w AS was, lag(serve_id) OVER w AS by_ FROM x WINDOW w AS (PARTITION BY player_id, puzzle_id ORDER BY ts, is_result, coalesce(serve_id, attempt_id))) WHERE is_result = 1""", AP)
def j11_served_to_result(v):
    a = v("attempts")
    return O.served_to_result(a.where("attempt_id % 3 = 0").withColumnRenamed("attempt_id", "serve_id"), a.where("attempt_id % 3 <> 1"))


#: Each event follows from the open servings before it; ten may be open here, so that some go.
ONCE = """ev AS (SELECT player_id, puzzle_id, ts, 0 AS is_result, attempt_id AS id FROM attempts WHERE attempt_id % 3 = 0 UNION ALL SELECT player_id, puzzle_id, ts, 1, attempt_id FROM attempts WHERE attempt_id % 3 <> 1),
e AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY ts, is_result, id) AS i FROM ev),
f AS (SELECT player_id, 0::BIGINT AS i, []::STRUCT(p VARCHAR, s BIGINT)[] AS held, 0 AS is_result, NULL::BIGINT AS id, NULL::VARCHAR AS puzzle_id, NULL::BIGINT AS serve_id FROM (SELECT DISTINCT player_id FROM e)
UNION ALL SELECT f.player_id, e.i, CASE WHEN e.is_result = 1 THEN list_filter(held, lambda x: x.p <> e.puzzle_id) WHEN len(list_filter(held, lambda x: x.p = e.puzzle_id)) > 0 THEN list_transform(held, lambda x: {'p': x.p, 's': CASE WHEN x.p = e.puzzle_id THEN e.id ELSE x.s END})
  ELSE list_append(held, {'p': e.puzzle_id, 's': e.id})[-10:] END, e.is_result, e.id, e.puzzle_id, CASE WHEN e.is_result = 1 THEN list_filter(held, lambda x: x.p = e.puzzle_id)[1].s END FROM f JOIN e ON e.player_id = f.player_id AND e.i = f.i + 1)"""


@query(f"WITH RECURSIVE {ONCE} SELECT id AS attempt_id, player_id, puzzle_id, serve_id FROM f WHERE i > 0 AND is_result = 1", AP)
def j11_served_once(v):
    a = v("attempts")
    return SV.served_once(a.where("attempt_id % 3 = 0").withColumnRenamed("attempt_id", "serve_id"), a.where("attempt_id % 3 <> 1"), pending=10)


# Predictions: two models of the labels from the documents' length and id.
PRED = """pred AS (SELECT doc_id, quality AS y, m.model, CASE m.model WHEN 'length' THEN n_chars / (n_chars + 500)::DOUBLE ELSE ((doc_id * 37) % 101) / 101::DOUBLE END AS p,
  n_chars % 400 AS t, (n_chars % 400) * 0.8::DOUBLE + (doc_id % 37) AS mu FROM labels JOIN documents USING (doc_id) CROSS JOIN (SELECT unnest(['length', 'hash']) AS model) m)"""


def _pred(v):
    df = v("labels").join(v("documents").select("doc_id", "n_chars"), "doc_id").withColumn("model", F.explode(F.array(F.lit("length"), F.lit("hash"))))
    p = F.when(F.col("model") == "length", F.col("n_chars") / (F.col("n_chars") + 500)).otherwise((F.col("doc_id") * 37 % 101) / 101)
    t = F.col("n_chars") % 400
    return df.select("doc_id", F.col("quality").alias("y"), "model", p.alias("p"), t.alias("t"), (t * F.lit(0.8) + F.col("doc_id") % 37).alias("mu"))


@query(f"WITH {PRED}, q AS (SELECT *, least(greatest(p, 1e-6), 1 - 1e-6) AS c FROM pred) SELECT model, count(*) AS n, round(avg(-(y * ln(c) + (1 - y) * ln(1 - c))), 6) AS log_loss, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(p), 6) AS mean_p FROM q GROUP BY 1")
def m1_proper_scores(v):
    return r(M.proper_scores(_pred(v), ("model",)), "log_loss", "brier", "mean_p")


@query(f"""WITH {PRED}, b AS (SELECT model, p, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM pred GROUP BY 1, 2), c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b)
SELECT model, round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM c GROUP BY 1""")
def m3_roc_auc(v):
    return r(M.roc_auc(_pred(v), ("model",)), "auc")


@query(f"WITH {PRED} SELECT model, least(floor(p * 5), 4)::INT AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS rate FROM pred GROUP BY 1, 2 HAVING count(*) >= 3")
def m7_calibration_curve(v):
    return r(M.calibration_curve(_pred(v), ("model",)), "mean_p", "rate")


@query(f"WITH {PRED} SELECT model, ceil(p * 10)::INT AS bin, count(*) AS n, round(avg(p), 6) AS confidence, round(avg(y), 6) AS accuracy FROM pred WHERE p > 0 GROUP BY 1, 2")
def m8_reliability_bins(v):
    return r(M.reliability(_pred(v), ("model",)), "confidence", "accuracy")


@query(f"WITH {PRED}, b AS (SELECT model, ceil(p * 15) AS bin, count(*) AS n, avg(p) AS c, avg(y) AS a FROM pred WHERE p > 0 GROUP BY 1, 2) SELECT model, round(sum(n / t.total::DOUBLE * abs(a - c)), 6) AS ece FROM b JOIN (SELECT model, count(*) AS total FROM pred GROUP BY 1) t USING (model) GROUP BY 1")
def m8_ece(v):
    return r(M.expected_calibration_error(_pred(v), ("model",)), "ece")


@query(f"""WITH {PRED}, k AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY t) + (count(*) OVER (PARTITION BY model, t) - 1) / 2.0::DOUBLE AS rt, rank() OVER (PARTITION BY model ORDER BY mu) + (count(*) OVER (PARTITION BY model, mu) - 1) / 2.0::DOUBLE AS rm FROM pred)
SELECT model, count(*) AS n, round(sqrt(avg((mu - t) * (mu - t))), 6) AS rmse, round(avg(abs(mu - t)), 6) AS mae, round(avg(mu - t), 6) AS bias, round(1 - sum((mu - t) * (mu - t)) / (var_pop(t) * count(*)), 6) AS r2, round(corr(t, mu), 6) AS pearson, round(corr(rt, rm), 6) AS spearman FROM k GROUP BY 1""")
def m11_regression_metrics(v):
    return r(M.regression(_pred(v), ("model",), "t", "mu"), "rmse", "mae", "bias", "r2", "pearson", "spearman")


PAIRS = "pairs AS (SELECT p.category AS t, a.category AS p FROM positions p JOIN arms a ON a.arm_id = p.l_suppkey % 24)"
PV = ("positions", "arms")


def _pairs(v):
    other = v("arms").select(F.col("arm_id").alias("id"), F.col("category").alias("p"))
    return v("moves").join(F.broadcast(other), F.col("l_suppkey") % 24 == F.col("id")).select(F.col("category").alias("t"), "p")


@query(f"WITH {PAIRS} SELECT t, p, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY t))::DOUBLE, 6) AS share FROM pairs GROUP BY 1, 2", PV)
def a21_confusion_matrix(v):
    return r(M.confusion(_pairs(v), "t", "p"), "share")


@query(f"""WITH {PAIRS}, a AS (SELECT count(*) AS n, avg((t = p)::INT) AS po FROM pairs), e AS (SELECT sum(x.n * y.n::DOUBLE) AS tp FROM (SELECT t AS l, count(*) AS n FROM pairs GROUP BY 1) x JOIN (SELECT p AS l, count(*) AS n FROM pairs GROUP BY 1) y USING (l))
SELECT n, round(po, 6) AS accuracy, round((po - tp / (n::DOUBLE * n)) / (1 - tp / (n::DOUBLE * n)), 6) AS kappa FROM a, e""", PV)
def a23_agreement(v):
    return r(M.agreement(_pairs(v), "t", "p"), "accuracy", "kappa")


@query(f"""WITH {PAIRS}, x AS (SELECT t AS label, count(*) AS support, count(*) FILTER (WHERE t = p) AS hit FROM pairs GROUP BY 1), y AS (SELECT p AS label, count(*) AS predicted FROM pairs GROUP BY 1)
SELECT label, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted, round(coalesce(hit / nullif(support, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(hit / nullif(predicted, 0)::DOUBLE, 0), 6) AS precision,
round(coalesce(2.0 * hit / nullif(coalesce(support, 0) + coalesce(predicted, 0), 0), 0), 6)::DOUBLE AS f1 FROM x FULL JOIN y USING (label)""", PV)
def a22_m9_per_class_report(v):
    return r(M.classification(_pairs(v), "t", "p"), "recall", "precision", "f1")


@query(f"WITH {PAIRS} SELECT t, p, count(*) AS n FROM pairs WHERE t <> p GROUP BY 1, 2 ORDER BY n DESC, t, p LIMIT 12", PV)
def a24_top_confusions(v):
    return _pairs(v).where("t <> p").groupBy("t", "p").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "t", "p").limit(12)


@query("""WITH x AS (SELECT l_partkey % 5 AS family, l_orderkey, l_linenumber, l_partkey, round(l_discount * 0.4::DOUBLE + 0.0001::DOUBLE * (l_orderkey % 977), 8) AS p FROM lineitem), q AS (SELECT *, (count(*) OVER (PARTITION BY family) - row_number() OVER w + 1) * p AS raw FROM x WINDOW w AS (PARTITION BY family ORDER BY p, l_orderkey, l_linenumber, l_partkey))
SELECT family, l_orderkey, l_linenumber, l_partkey, round(least(1.0, max(raw) OVER (PARTITION BY family ORDER BY p, l_orderkey, l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING)), 6)::DOUBLE AS adjusted FROM q""")
def m15_holm(v):
    p = F.round(F.col("l_discount") * 0.4 + 0.0001 * (F.col("l_orderkey") % 977), 8)
    x = v("lineitem").select((F.col("l_partkey") % 5).alias("family"), "l_orderkey", "l_linenumber", "l_partkey", p.alias("p"))
    return r(M.holm(x, "family", "p").drop("p"), "adjusted")


@query()
def m5_cluster_bootstrap(v):
    hits = v("attempts").groupBy("player_id").agg(F.sum(F.col("solved").cast("int")).alias("k"), F.count("*").alias("n"))
    return M.bootstrap(hits.withColumn("all", F.lit("all")), ("all",), "k", "n", "player_id", 200)


@query("""WITH d AS (SELECT player_id, category, count(*) AS n, avg(solved::INT) AS rate FROM attempts GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT category, count(*) AS players, round(avg(rate), 6) AS mean, round(var_pop(rate), 6) AS spread, round(greatest(0, var_pop(rate) - avg(rate * (1 - rate) / n)), 6)::DOUBLE AS true_spread FROM d GROUP BY 1""", AP)
def a28_effect_spread(v):
    d = v("attempts").groupBy("player_id", "category").agg(F.count("*").alias("n"), F.avg(F.col("solved").cast("int")).alias("rate")).where("n >= 3")
    out = d.groupBy("category").agg(F.count("*").alias("players"), F.avg("rate").alias("mean"), F.var_pop("rate").alias("spread"), F.greatest(F.lit(0.0), F.var_pop("rate") - F.avg(F.col("rate") * (1 - F.col("rate")) / F.col("n"))).alias("true_spread"))
    return r(out, "mean", "spread", "true_spread")


@query("SELECT player_id, fold FROM (SELECT player_id, ((row_number() OVER (ORDER BY md5(player_id::VARCHAR || '-7'), player_id) - 1) % 5)::INT AS fold FROM (SELECT DISTINCT player_id FROM attempts))", AP)
def l1_group_kfold(v):
    from ..operators.cohort import group_folds

    return group_folds(v("attempts"), "player_id", 5, 7)
