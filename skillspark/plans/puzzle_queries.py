"""Queries over the puzzle table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import puzzles as P
from ..operators import puzzles as O
from ..taxonomy import ARMS, PRIORITY, TAG_CATEGORIES, THEMES, TIERS
from .registry import query

V = ("puzzles",)
TAGS = r"list_filter(regexp_split_to_array(trim(coalesce(themes, '')), '\s+'), lambda s: s <> '')"
MOVES = r"len(list_filter(regexp_split_to_array(trim(coalesce(moves, '')), '\s+'), lambda s: s <> ''))"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


PRIMARY = "CASE " + " ".join(f"WHEN list_has_any(tags, {_list(tags)}) THEN '{c}'" for c, tags in PRIORITY) + " ELSE 'General' END"
TIER = "CASE " + " ".join(f"WHEN rating BETWEEN {a} AND {b} THEN '{t}'" for t, a, b in TIERS) + " ELSE 'Master' END"
TAG_DIM = "SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{c}')" for t, cs in TAG_CATEGORIES.items() for c in cs) + ") AS t(tag, category)"
LENGTH = f"CASE WHEN {MOVES} <= 1 THEN 'oneMove' WHEN {MOVES} <= 3 THEN 'short' WHEN {MOVES} <= 7 THEN 'long' ELSE 'veryLong' END"
E = f"t AS (SELECT *, {TAGS} AS tags FROM puzzles), e AS (SELECT *, {PRIMARY} AS primary_category, {TIER} AS difficulty_tier, {LENGTH} AS move_length FROM t)"
CATS = f"tc AS ({TAG_DIM}), pc AS (SELECT DISTINCT seq, puzzle_id, category FROM (SELECT seq, puzzle_id, unnest({TAGS}) AS tag FROM puzzles) JOIN tc USING (tag))"


@query(f"WITH {E} SELECT puzzle_id, len(tags)::INT AS n_tags, primary_category, difficulty_tier, move_length FROM e", V)
def p1_enrich(v):
    return O.enrich(v("puzzles")).select("puzzle_id", F.size("theme_list").alias("n_tags"), "primary_category", "difficulty_tier", "move_length")


@query(f"WITH {CATS} SELECT puzzle_id, category FROM pc", V)
def p2_categories(v):
    return O.enrich(v("puzzles")).select("puzzle_id", F.explode("categories").alias("category"))


@query(f"WITH {CATS} SELECT category, count(*) AS n FROM pc GROUP BY category", V)
def j1_tag_dimension_join(v):
    tags = v("puzzles").select("puzzle_id", F.explode(P.tokens(F.col("themes"))).alias("tag"))
    dim = tags.sparkSession.createDataFrame([(t, c) for t, cs in TAG_CATEGORIES.items() for c in cs], "tag string, category string")
    return tags.join(F.broadcast(dim), "tag").select("puzzle_id", "category").distinct().groupBy("category").agg(F.count("*").alias("n"))


@query("SELECT puzzle_id, CASE WHEN rating < 1000 THEN 'Beginner' WHEN rating < 1300 THEN 'Easy' WHEN rating < 1600 THEN 'Intermediate' WHEN rating < 1900 THEN 'Advanced' ELSE 'Expert' END AS tier FROM puzzles", V)
def p5_mined_tier(v):
    return v("puzzles").select("puzzle_id", P.mined_tier(F.col("rating")).alias("tier"))


@query(f"""WITH {E}, h AS (SELECT puzzle_id, list_transform({_list(THEMES)}, lambda t: list_contains(tags, t)::INT) AS hot FROM e)
SELECT puzzle_id, array_to_string(hot, '') AS hot, list_sum(hot)::BIGINT AS n FROM h""", V)
def p7_theme_multihot(v):
    hot = v("puzzles").select("puzzle_id", P.theme_multihot(P.tokens(F.col("themes"))).alias("hot"))
    n = F.aggregate("hot", F.lit(0).cast("long"), lambda a, x: a + x)
    return hot.select("puzzle_id", F.array_join(F.transform("hot", lambda x: x.cast("string")), "").alias("hot"), n.alias("n"))


@query("SELECT puzzle_id, CASE WHEN b < 2 THEN 'val' WHEN b < 5 THEN 'test' ELSE 'train' END AS split FROM (SELECT puzzle_id, ('0x' || substring(md5(puzzle_id), 1, 8))::BIGINT % 100 AS b FROM puzzles)", V)
def p43_hash_split(v):
    return v("puzzles").select("puzzle_id", P.hash_split(F.col("puzzle_id")).alias("split"))


@query("SELECT puzzle_id, 'gen_' || substring(md5(fen || replace(moves, ' ', '')), 1, 8) AS gen_id, starts_with(puzzle_id, 'gen_') AS mined FROM puzzles WHERE fen IS NOT NULL", V)
def p26_mined_puzzle_id(v):
    return v("puzzles").where("fen is not null").select("puzzle_id", P.mined_puzzle_id(F.col("fen"), F.col("moves")).alias("gen_id"), F.col("puzzle_id").startswith("gen_").alias("mined"))


@query(f"SELECT puzzle_id, least(greatest(trunc(800 + 0.6::DOUBLE * least(nb_plays - 150, 700) + 150 * ({MOVES} - 2))::INT, 700), 2400) AS mined FROM puzzles", V)
def p38_mined_rating(v):
    return v("puzzles").select("puzzle_id", P.mined_rating(F.col("nb_plays"), F.size(P.tokens(F.col("moves")))).alias("mined"))


@query(f"SELECT puzzle_id, greatest(2 * least(1 + (seq * 2654435761) % 3, ({MOVES} + 1) // 2) - 1, 0)::INT AS plies FROM puzzles", V)
def p29_truncate_line(v):
    return v("puzzles").select("puzzle_id", F.size(P.truncate_line(P.tokens(F.col("moves")), F.col("seq"))).alias("plies"))


@query(f"WITH {E}, {CATS} SELECT puzzle_id, rating FROM e WHERE rating BETWEEN 900 AND 2000 AND popularity >= 20 AND nb_plays >= 100 AND difficulty_tier IN ('Beginner', 'Easy', 'Advanced') AND puzzle_id IN (SELECT puzzle_id FROM pc WHERE category IN ('Fork', 'Endgame'))", V)
def f1_filter_puzzles(v):
    return O.select_puzzles(O.enrich(v("puzzles")), 900, 2000, 20, 100, ("Beginner", "Easy", "Advanced"), ("Fork", "Endgame")).select("puzzle_id", "rating")


DOUBLED = "d AS (SELECT * FROM puzzles UNION ALL SELECT * REPLACE (seq + 1000000 AS seq) FROM puzzles WHERE seq % 50 = 0)"
CLEAN = "c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY puzzle_id ORDER BY seq) AS rn FROM d WHERE fen IS NOT NULL AND moves IS NOT NULL AND rating IS NOT NULL) WHERE rn = 1 AND rating_deviation <= 150 AND nb_plays > 0 AND popularity >= 0 AND trim(moves) <> '')"


def _doubled(v):
    df = v("puzzles")
    return df.unionByName(df.where("seq % 50 = 0").withColumn("seq", F.col("seq") + 1000000))


@query(f"WITH {DOUBLED}, {CLEAN} SELECT puzzle_id, seq, rating FROM c", V)
def f2_clean_puzzles(v):
    return O.clean(_doubled(v)).select("puzzle_id", "seq", "rating")


@query(f"WITH {E} SELECT puzzle_id, primary_category FROM e WHERE rating BETWEEN 600 AND 2400 AND popularity >= 40 AND nb_plays >= 250 AND rating_deviation <= 120 AND {MOVES} >= 3 AND NOT list_has_any(tags, ['equality', 'defensiveMove']) AND primary_category <> 'General'", V)
def f3_quality_gate(v):
    return O.quality_gate(v("puzzles"), popularity=40, deviation=120).select("puzzle_id", "primary_category")


@query("SELECT puzzle_id, themes FROM puzzles WHERE rating BETWEEN 800 AND 1800 AND contains(themes, 'Endgame')", V)
def f4_lookup_puzzles(v):
    return v("puzzles").where(F.col("rating").between(800, 1800) & F.col("themes").contains("Endgame")).select("puzzle_id", "themes")


@query("SELECT puzzle_id, rating FROM puzzles WHERE puzzle_id IN (SELECT puzzle_id FROM attempts)", ("puzzles", "attempts"))
def s3_puzzles_by_id(v):
    return v("puzzles").join(v("attempts").select("puzzle_id").distinct(), "puzzle_id", "left_semi").select("puzzle_id", "rating")


@query("SELECT puzzle_id FROM puzzles ORDER BY seq LIMIT 100", V)
def s4_read_head(v):
    return v("puzzles").orderBy("seq").limit(100).select("puzzle_id")


@query(f"WITH {DOUBLED} SELECT puzzle_id, min(seq) AS seq FROM d GROUP BY puzzle_id", V)
def u2_distinct_by_key(v):
    return O.first_by_key(_doubled(v), "puzzle_id", "seq").select("puzzle_id", "seq")


@query(f"WITH {DOUBLED} SELECT count(*) AS n, count(DISTINCT puzzle_id) AS n_ids FROM d", V)
def u1_union_all(v):
    return _doubled(v).agg(F.count("*").alias("n"), F.countDistinct("puzzle_id").alias("n_ids"))


@query(f"WITH {CATS} SELECT a.category, count(pc.puzzle_id) AS n FROM arms a LEFT JOIN pc ON pc.category = a.category WHERE a.arm_id < 23 GROUP BY a.category", ("puzzles", "arms"))
def k2_split_by_category(v):
    return O.counts_on(O.enrich(v("puzzles")).select(F.explode("categories").alias("category")), ARMS, "category").select("category", "n")


_TIERS = "tiers AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t[0]}')" for i, t in enumerate(TIERS)) + ") AS t(place, difficulty_tier))"


@query(f"WITH {E}, {_TIERS}, n AS (SELECT place::INT AS place, t.difficulty_tier, count(e.puzzle_id) AS n FROM tiers t LEFT JOIN e USING (difficulty_tier) GROUP BY ALL) SELECT *, round(100.0 * n / greatest(sum(n) OVER (), 1), 4)::DOUBLE AS pct FROM n", V)
def a1_dataset_report(v):
    return O.tier_report(O.enrich(v("puzzles"))).withColumn("pct", F.round("pct", 4))


@query(f"WITH {E} SELECT primary_category, count(*) AS n, round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 6) AS share FROM e GROUP BY 1", V)
def a2_category_counts(v):
    return O.category_counts(O.enrich(v("puzzles"))).withColumn("share", F.round("share", 6))


@query(f"WITH {E} SELECT primary_category, count(*) AS n FROM e GROUP BY 1 ORDER BY n DESC, 1 LIMIT 15", V)
def k4_category_summary(v):
    return O.enrich(v("puzzles")).groupBy("primary_category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "primary_category").limit(15)


@query("""SELECT "column", count(x) AS n, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS sd, min(x) AS min, round(quantile_cont(x, 0.05), 4) AS p05, round(quantile_cont(x, 0.5), 4) AS p50, round(quantile_cont(x, 0.95), 4) AS p95, max(x) AS max
FROM (SELECT 'rating' AS "column", rating::DOUBLE AS x FROM puzzles UNION ALL SELECT 'rating_deviation', rating_deviation FROM puzzles UNION ALL SELECT 'popularity', popularity FROM puzzles UNION ALL SELECT 'nb_plays', nb_plays FROM puzzles) GROUP BY 1""", V)
def a3_describe_numeric(v):
    out = O.describe(v("puzzles"), ("rating", "rating_deviation", "popularity", "nb_plays"))
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "sd", "p05", "p50", "p95")})


@query(f"""WITH {CATS}, w AS (SELECT * FROM (VALUES (0, 'Fork'), (1, 'Endgame'), (2, 'Pin')) AS t(target_rank, category)),
r AS (SELECT p.puzzle_id, p.popularity, target_rank, row_number() OVER (PARTITION BY category ORDER BY p.seq) AS rank FROM puzzles p JOIN pc USING (puzzle_id) JOIN w USING (category) WHERE rating BETWEEN 1200 AND 2000)
SELECT puzzle_id, popularity FROM (SELECT *, row_number() OVER (PARTITION BY puzzle_id ORDER BY target_rank, rank) AS rn FROM r WHERE rank <= 50) WHERE rn = 1""", V)
def j2_pool_for_player(v):
    return O.pool_for_player(O.enrich(v("puzzles")), 1600, 400, ("Fork", "Endgame", "Pin")).select("puzzle_id", "popularity")


@query("SELECT puzzle_id, seq FROM puzzles WHERE seq % 3 = 0 UNION ALL SELECT puzzle_id, seq FROM puzzles WHERE seq % 2 = 0 AND seq % 3 <> 0", V)
def k6_merge_new_by_id(v):
    df = v("puzzles").select("puzzle_id", "seq")
    return O.merge_new(df.where("seq % 3 = 0"), df.where("seq % 2 = 0"), "puzzle_id")


@query("SELECT floor(rating / 50)::BIGINT AS bin, count(*) AS n FROM puzzles GROUP BY 1", V)
def a34_histogram(v):
    return v("puzzles").groupBy(F.floor(F.col("rating") / 50).alias("bin")).agg(F.count("*").alias("n"))


@query("WITH r AS (SELECT puzzle_id, rating_deviation, row_number() OVER (PARTITION BY themes ORDER BY md5(puzzle_id), puzzle_id) AS rn FROM puzzles) SELECT puzzle_id, rating_deviation FROM r WHERE rn <= 20", V)
def w6_stratified_sample(v):
    from pyspark.sql import Window

    w = Window.partitionBy("themes").orderBy(F.md5(F.col("puzzle_id").cast("binary")), "puzzle_id")
    return v("puzzles").withColumn("rn", F.row_number().over(w)).where("rn <= 20").select("puzzle_id", "rating_deviation")
