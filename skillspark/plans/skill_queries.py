"""Queries over skill models and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import games as G
from ..operators import attempts as A
from ..operators import puzzles as P
from ..operators import ratings as RT
from ..operators import recommend as RC
from ..operators import selection as SE
from ..operators import skill as S
from ..operators.store import Store
from ..taxonomy import ARMS
from .puzzle_queries import E as ENRICHED
from .registry import query

AP = ("attempts", "players", "arms")


def r(df, *names, n=5):
    return df.withColumns({c: F.round(c, n) for c in names})


def fit_sql(attempts: str = "attempts", rd: str = "75.0::DOUBLE") -> str:
    """f: a row for each player and number of attempts so far, with mean, covariance (24 x 24, row by row), and the prediction of the last one. Each step follows from the one before."""
    s, on = "(400 / ln(10))", "CASE WHEN k IS NULL THEN 0 ELSE {} END"
    diagonal = "list_transform(range(576), lambda x: CASE WHEN x % 25 > 0 THEN 0.0 WHEN x = 0 THEN {} ELSE {} END)"
    return f"""o AS (SELECT t.player_id, attempt_id, (t.rating - 1500) / {s} AS z, solved::INT AS y, CASE WHEN arm_id < 23 THEN arm_id END AS k, pow({rd} / {s}, 2) AS noise, row_number() OVER (PARTITION BY t.player_id ORDER BY ts, attempt_id) AS i FROM {attempts} t LEFT JOIN arms USING (category)),
f AS (SELECT player_id, 0::BIGINT AS i, NULL::BIGINT AS attempt_id, NULL::DOUBLE AS predicted, list_transform(range(24), lambda x: CASE WHEN x = 0 AND coalesce(rating, 0) <> 0 THEN (rating - 1500) / {s} ELSE 0.0 END) AS m,
  CASE WHEN coalesce(rating, 0) <> 0 THEN {diagonal.format(f"pow(250 / {s}, 2)", "0.36::DOUBLE")} ELSE {diagonal.format(f"pow(350 / {s}, 2)", "0.36::DOUBLE")} END AS c FROM (SELECT DISTINCT player_id FROM o) LEFT JOIN players USING (player_id)
UNION ALL SELECT player_id, i, attempt_id, predicted, list_transform(list_zip(m, l), lambda x: x[1] + g * (y - p) / (1 + h * q) * x[2]), list_transform(range(576), lambda x: d[x + 1] - h / (1 + h * q) * l[x // 24 + 1] * l[x % 24 + 1])
  FROM (SELECT *, g * g * p * (1 - p) AS h FROM (SELECT *, 1 / (1 + exp(-w / sqrt(1 + 3 * (q + noise) / (pi() * pi())))) AS predicted, 1 / (1 + exp(-g * w)) AS p
  FROM (SELECT *, l[1] + {on.format("l[k + 2]")} AS q, m[1] + {on.format("m[k + 2]")} - z AS w, 1 / sqrt(1 + 3 * noise / (pi() * pi())) AS g
  FROM (SELECT *, list_transform(range(24), lambda x: d[x * 24 + 1] + {on.format("d[x * 24 + k + 2]")}) AS l
  FROM (SELECT f.player_id, o.i, o.attempt_id, o.z, o.y, o.k, o.noise, f.m, list_transform(range(576), lambda x: c[x + 1] + CASE WHEN x % 25 > 0 THEN 0 WHEN x = 0 THEN 0.0004::DOUBLE ELSE 0.0016::DOUBLE END) AS d FROM f JOIN o ON o.player_id = f.player_id AND o.i = f.i + 1))))))"""


#: The state after a player's last attempt.
LAST = "e AS (SELECT player_id, i AS n, m, c FROM f QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY i DESC) = 1)"


@query(f"WITH RECURSIVE {fit_sql()} SELECT attempt_id, player_id, round(predicted, 5) AS predicted FROM f WHERE i > 0", AP)
def r5_irt_fit(v):
    return r(S.fit_skill(v("attempts"), v("players"))[0], "predicted")


#: The fit without known ratings.
UNSEEDED = fit_sql().replace("LEFT JOIN players USING (player_id)", "CROSS JOIN (SELECT NULL::INT AS rating)")


@query(f"""WITH RECURSIVE {UNSEEDED}, {LAST}
SELECT player_id, n, category, round(1500 + 400 / ln(10) * (m[1] + m[arm_id + 2]), 5) AS category_rating, round(1 / (1 + exp(-m[arm_id + 2] / sqrt(1 + 3 * c[(arm_id + 1) * 25 + 1] / (pi() * pi())))), 5) AS strength FROM e, arms WHERE arm_id < 23""", AP)
def r9_skill_states(v):
    states = S.fit_skill(v("attempts"))[1]
    arms = v("arms").where("arm_id < 23").select((F.col("arm_id") + 1).alias("pos"), "category")
    long = states.select("player_id", "n", F.col("mean")[0].alias("theta"), F.posexplode(F.arrays_zip("mean", "sd")).alias("pos", "x"))
    out = long.join(F.broadcast(arms), "pos")
    return r(out.select("player_id", "n", "category", G.logit_to_rating(F.col("theta") + F.col("x.mean")).alias("category_rating"), G.sigmoid(G.kappa(F.col("x.sd") ** 2) * F.col("x.mean")).alias("strength")), "category_rating", "strength")


K2 = "(1 / sqrt(1 + 3 * pow(75.0::DOUBLE / (400 / ln(10)), 2) / (pi() * pi())))"


@query(f"""WITH RECURSIVE o AS (SELECT player_id, (rating - 1500) / (400 / ln(10)) AS z, solved::INT AS y, row_number() OVER (PARTITION BY player_id ORDER BY ts, attempt_id) AS i FROM attempts),
f AS (SELECT player_id, 0::BIGINT AS i, 0.0::DOUBLE AS m, pow(350 / (400 / ln(10)), 2) AS v FROM (SELECT DISTINCT player_id FROM attempts)
UNION ALL SELECT player_id, i, m + k * (y - p) / (1 + h * q) * q, q - h / (1 + h * q) * q * q FROM (SELECT *, k * k * p * (1 - p) AS h FROM (SELECT o.player_id, o.i, o.y, f.m, f.v + 0.0004 AS q, {K2} AS k, 1 / (1 + exp(-{K2} * (f.m - o.z))) AS p FROM f JOIN o ON o.player_id = f.player_id AND o.i = f.i + 1)))
SELECT player_id, round(m, 5) AS theta, round(v, 5) AS variance FROM f QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY i DESC) = 1""", AP)
def r6_irt_theta_fit(v):
    return r(S.fit_ability(v("attempts")), "theta", "variance")


#: The volatility by the steps of operators.ratings: halving between the same ends.
PERIOD = """WITH RECURSIVE g AS (SELECT player_id AS id, 1 / sqrt(1 + 3 * pow(75.0::DOUBLE / 173.7178, 2) / (pi() * pi())) AS g, (rating - 1500) / 173.7178 AS mu_j, solved::INT AS y FROM attempts WHERE rating IS NOT NULL),
e AS (SELECT id, g, y, 1 / (1 + exp(g * mu_j)) AS e FROM g), s AS (SELECT id, sum(g * g * e * (1 - e)) AS info, sum(g * (y - e)) AS surprise FROM e GROUP BY 1),
b AS (SELECT *, pow(surprise / info, 2) AS sq, 350.0::DOUBLE / 173.7178 AS phi, 1 / info AS v, 2 * ln(0.06::DOUBLE) AS a FROM s), d AS (SELECT *, phi * phi + v AS d FROM b),
f AS (SELECT id, 0 AS i, a - 0.125::DOUBLE AS low, CASE WHEN sq > d THEN a + least(0.25 * sq / (8 * d), greatest(0, ln(sq - d) - a)) ELSE a END AS high FROM d
UNION ALL SELECT id, i + 1, CASE WHEN up THEN m ELSE low END, CASE WHEN up THEN high ELSE m END FROM (SELECT f.*, (low + high) / 2 AS m, exp((low + high) / 2) * (sq - d - exp((low + high) / 2)) / (2 * pow(d + exp((low + high) / 2), 2)) - ((low + high) / 2 - a) / 0.25 > 0 AS up FROM f JOIN d USING (id) WHERE i < 60)),
n AS (SELECT id, exp((low + high) / 4) AS sigma FROM f WHERE i = 60), o AS (SELECT d.*, sigma, 1 / (1 / (phi * phi + sigma * sigma) + info) AS phi2 FROM d JOIN n USING (id))
SELECT id, round(1500 + 173.7178 * phi2 * surprise, 5) AS rating, round(173.7178 * sqrt(phi2), 5) AS rd, round(sigma, 5) AS volatility FROM o"""


@query(PERIOD, AP)
def r13_glicko2_period(v):
    a = v("attempts").where("rating is not null")
    players = a.select("player_id").distinct().select(F.col("player_id").alias("id"), F.lit(1500.0).alias("rating"), F.lit(350.0).alias("rd"), F.lit(0.06).alias("volatility"))
    results = a.select(F.col("player_id").alias("id"), F.col("rating").cast("double").alias("opponent_rating"), F.lit(75.0).alias("opponent_rd"), F.col("solved").cast("double").alias("score"))
    return r(RT.glicko2_period(players, results), "rating", "rd", "volatility")


@query()
def r14_glicko2_replay(v):
    return r(RT.glicko2_replay(v("attempts"), v("players")), "predicted")


@query()
def r14_symmetric_predictions(v):
    return r(RT.glicko2_symmetric(v("attempts"), v("players"))[0], "predicted", n=4)


@query()
def r14_symmetric_ratings(v):
    """The graph here is one component; beyond 5,000 attempts it is replayed in slices."""
    return r(RT.glicko2_symmetric(v("attempts"), v("players"), most=5000)[1], "rating", "rd", "volatility", n=2)


#: The quadrature of operators.selection as rows: 256 midpoints a player.
LOWEST = """k AS (SELECT player_id, category, 1.0::DOUBLE + count(*) FILTER (WHERE solved) AS a, 1.0::DOUBLE + count(*) FILTER (WHERE NOT solved) AS b FROM attempts WHERE category <> 'General' GROUP BY 1, 2),
p AS (SELECT x.player_id, x.category, coalesce(a, 1.0::DOUBLE) AS a, coalesce(b, 1.0::DOUBLE) AS b FROM (SELECT player_id, category FROM (SELECT DISTINCT player_id FROM k) CROSS JOIN (SELECT category FROM arms WHERE {}) c) x LEFT JOIN k USING (player_id, category)),
s AS (SELECT *, a / (a + b) AS mean, sqrt(a * b / (a + b + 1)) / (a + b) AS sd FROM p), r AS (SELECT player_id, greatest(0, min(mean - 10 * sd)) AS low, least(1, min(mean + 10 * sd)) AS high FROM s GROUP BY 1),
g AS (SELECT s.player_id, category, i, exp(lgamma(a + b) - lgamma(a) - lgamma(b) + (a - 1) * ln(low + (i + 0.5::DOUBLE) * (high - low) / 256) + (b - 1) * ln(1 - (low + (i + 0.5::DOUBLE) * (high - low) / 256))) * (high - low) / 256 AS m FROM s JOIN r USING (player_id), range(256) t(i)),
c AS (SELECT *, ln(greatest(1e-300, 1 - coalesce(sum(m) OVER (PARTITION BY player_id, category ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - m / 2)) AS above FROM g), d AS (SELECT *, sum(above) OVER (PARTITION BY player_id, i) AS every FROM c),
q AS (SELECT player_id, category, sum(m * exp(every - above)) AS chance FROM d GROUP BY 1, 2), pr AS (SELECT player_id, category, chance / sum(chance) OVER (PARTITION BY player_id) AS probability FROM q)"""


@query(f"WITH {LOWEST.format('arm_id < 23')} SELECT player_id, category, round(probability, 6) AS probability FROM pr", ("attempts", "arms"))
def r11_selection_probabilities(v):
    return r(SE.selection_probabilities(A.beta_posterior(v("attempts"), v("arms"))), "probability", n=6)


@query(f"""WITH {LOWEST.format('arm_id < 23 AND arm_id % 2 = 0')}, h AS (SELECT *, sum(probability) OVER (PARTITION BY player_id ORDER BY category) AS upto, CAST('0x' || substr(md5(player_id || ':3:7'), 1, 13) AS BIGINT) / pow(2, 52) AS u FROM pr)
SELECT player_id, min(category) AS category, round(arg_min(probability, category), 6) AS propensity FROM h WHERE upto > u GROUP BY 1""", ("attempts", "arms"))
def r10_thompson_draw(v):
    allowed = v("arms").where("arm_id < 23 and arm_id % 2 = 0").select("category")
    return r(SE.thompson_draw(A.beta_posterior(v("attempts"), v("arms")), 3, 7, allowed), "propensity", n=6)


@query()
def r10_skill_draw(v):
    return SE.skill_draw(S.fit_skill(v("attempts"), v("players"))[1], 3, 7, tuple(ARMS[:12]))


OWN = """own AS (SELECT player_id, 'gen_' || g.game_id::VARCHAR AS puzzle_id, min(category) AS category, min(rating) AS rating FROM (SELECT game_id, category, 700 + (game_id * 37) % 1500 AS rating FROM positions WHERE ply_no = 1 AND game_id % 4 = 0) o JOIN games g ON g.game_id = o.game_id GROUP BY 1, 2)"""


#: Draws among all arms, target ratings at 65 %, and the first rung of the ladder with an unseen puzzle, own ones for 40 % of players.
LADDER = f"""{fit_sql()}, {LAST.replace("e AS", "le AS")}, {LOWEST.format("arm_id < 23")}, hh AS (SELECT *, sum(probability) OVER (PARTITION BY player_id ORDER BY category) AS upto, CAST('0x' || substr(md5(player_id || ':3:7'), 1, 13) AS BIGINT) / pow(2, 52) AS u FROM pr),
ch AS (SELECT player_id, min(category) AS category, arg_min(probability, category) AS propensity FROM hh WHERE upto > u GROUP BY 1),
rw AS (SELECT ch.player_id, ch.category, propensity, arm_id, m, le.c AS cov, 1500 + 400 / ln(10) * (m[1] + m[arm_id + 2] - ln(0.65 / 0.35::DOUBLE)) AS wish FROM ch JOIN le USING (player_id) JOIN arms USING (category)), rt AS (SELECT *, CAST(round(wish) AS BIGINT) AS target FROM rw),
{ENRICHED}, {OWN}, rs AS (SELECT DISTINCT player_id, puzzle_id FROM attempts),
rc AS (SELECT rt.player_id, e.puzzle_id, e.rating, e.primary_category AS of_, CASE WHEN e.primary_category = rt.category AND abs(e.rating - target) <= 150 THEN 2 WHEN e.primary_category = rt.category AND abs(e.rating - target) <= 350 THEN 3 WHEN abs(e.rating - target) <= 150 THEN 4 ELSE 5 END AS rung FROM rt, e
UNION ALL SELECT rt.player_id, x.puzzle_id, x.rating, x.category, CASE WHEN x.category = rt.category THEN 0 ELSE 1 END FROM rt JOIN own x ON x.player_id = rt.player_id AND abs(x.rating - target) <= 150 AND (x.category = rt.category OR CAST('0x' || substr(md5(rt.player_id || ':own:0'), 1, 13) AS BIGINT) / pow(2, 52) * 100 < 40)),
ru AS (SELECT rc.* FROM rc ANTI JOIN rs ON rs.player_id = rc.player_id AND rs.puzzle_id = rc.puzzle_id), rr AS (SELECT * FROM ru QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY rung, md5(puzzle_id), puzzle_id) = 1)"""


def _choices(v):
    """A drawn arm of each player with its propensity, skill states, target ratings, and puzzles of the players' own."""
    store = Store(v("attempts").sparkSession)
    draw, _ = store.put(SE.thompson_draw(A.beta_posterior(v("attempts"), v("arms")), 3, 7))
    states, _ = store.put(S.fit_skill(v("attempts"), v("players"))[1])
    first = v("moves").where("ply_no = 1 and game_id % 4 = 0").select("game_id", "category", (700 + F.col("game_id") * 37 % 1500).alias("rating"))
    own = first.join(v("games").select("game_id", "player_id"), "game_id").groupBy("player_id", F.concat(F.lit("gen_"), F.col("game_id").cast("string")).alias("puzzle_id")).agg(F.min("category").alias("category"), F.min("rating").alias("rating"))
    return draw, states, RC.target_rating(states, draw), own


R16 = ("attempts", "players", "arms", "puzzles", "games", "positions")


@query(f"WITH RECURSIVE {LADDER} SELECT player_id, puzzle_id, rung, false AS exhausted FROM rr", R16)
def r16_recommend_next(v):
    draw, _, target, own = _choices(v)
    return RC.recommend(draw.select("player_id", "category"), target, P.enrich(v("puzzles")), v("attempts"), own)


@query(f"""WITH RECURSIVE {LADDER}, z AS (SELECT rr.*, rt.category AS selected, CASE WHEN rung IN (0, 2, 3) THEN rt.category ELSE of_ END AS category, wish, propensity, m, cov, CASE WHEN rung < 2 THEN 300.0::DOUBLE ELSE 75.0::DOUBLE END AS rd FROM rr JOIN rt USING (player_id)),
y AS (SELECT z.*, CASE WHEN a.arm_id < 23 THEN a.arm_id END AS k FROM z LEFT JOIN arms a USING (category)), x AS (SELECT *, m[1] + CASE WHEN k IS NULL THEN 0 ELSE m[k + 2] END AS ability, cov[1] + CASE WHEN k IS NULL THEN 0 ELSE 2 * cov[k + 2] + cov[(k + 1) * 25 + 1] END AS variance FROM y)
SELECT player_id, puzzle_id, CASE WHEN rung < 2 THEN 'own' ELSE 'pool' END AS source, selected, category, category <> selected AS relabelled, round(wish, 4) AS target, round(1 / (1 + exp(-(ability - (rating - 1500) / (400 / ln(10))) / sqrt(1 + 3 * (variance + pow(rd / (400 / ln(10)), 2)) / (pi() * pi())))), 5) AS predicted,
  round(1500 + 400 / ln(10) * ability, 4) AS category_rating, round(400 / ln(10) * sqrt(variance), 4) AS category_rd, round(propensity, 6) AS propensity FROM x""", R16)
def r16_servings(v):
    draw, states, target, own = _choices(v)
    puzzles = P.enrich(v("puzzles"))
    chosen = RC.recommend(draw.select("player_id", "category"), target, puzzles, v("attempts"), own)
    out = RC.servings(chosen, draw, target, puzzles, states, own)
    return out.select("player_id", "puzzle_id", "source", "selected", "category", "relabelled", F.round("target", 4).alias("target"), F.round("predicted", 5).alias("predicted"), F.round("category_rating", 4).alias("category_rating"), F.round("category_rd", 4).alias("category_rd"), F.round("propensity", 6).alias("propensity"))


@query("SELECT DISTINCT player_id, puzzle_id FROM (SELECT player_id, puzzle_id FROM attempts WHERE solved UNION SELECT player_id, puzzle_id FROM attempts WHERE NOT solved)", AP)
def u3_set_union(v):
    a = v("attempts").select("player_id", "puzzle_id", "solved")
    return a.where("solved").drop("solved").union(a.where("not solved").drop("solved")).distinct()


@query("SELECT puzzle_id FROM puzzles WHERE puzzle_id NOT IN (SELECT puzzle_id FROM attempts)", ("puzzles", "attempts"))
def u4_except(v):
    return v("puzzles").select("puzzle_id").exceptAll(v("puzzles").join(v("attempts").select("puzzle_id").distinct(), "puzzle_id", "left_semi").select("puzzle_id"))


@query("SELECT player_id, substring(sha256('salt:' || lower(username)), 1, 12) AS pseudonym FROM players", AP)
def k9_pseudonymise(v):
    return v("players").select("player_id", F.substring(F.sha2(F.concat_ws(":", F.lit("salt"), F.lower("username")), 256), 1, 12).alias("pseudonym"))
