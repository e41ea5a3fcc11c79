"""Views of the test tables as players, games, positions, puzzles and attempts: one SQL text for Spark and DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..taxonomy import ARMS, GENERAL

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")

CATEGORIES = (*ARMS, GENERAL)


def _category(number: str) -> str:
    return f"CASE {number} " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CATEGORIES)) + " END"


VIEWS: dict[str, str] = {
    "arms": "SELECT * FROM (VALUES " + ", ".join(f"({i},'{c}')" for i, c in enumerate(CATEGORIES)) + ") AS t(arm_id, category)",
    "theme_dim": r"""
SELECT * FROM (VALUES (0,'crushing endgame fork short'),
  (1,'mate mateIn1 oneMove'),
  (2,'advantage middlegame short'),
  (3,'endgame rookEndgame long'),
  (4,'pin middlegame'),
  (5,'skewer crushing'),
  (6,'discoveredAttack doubleCheck'),
  (7,'equality endgame pawnEndgame'),
  (8,'deflection capturingDefender sacrifice'),
  (9,'hangingPiece opening'),
  (10,'quietMove zugzwang'),
  (11,'defensiveMove middlegame'),
  (12,'promotion advancedPawn'),
  (13,'enPassant endgame'),
  (14,'kingsideAttack exposedKing'),
  (15,'endgame queenRookEndgame'),
  (16,'unknownTag'),
  (17,'')) AS t(theme_id, themes)
""",
    "fen_dim": r"""
SELECT * FROM (VALUES (0,'rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1'),
  (1,'8/5k2/4p3/8/3P4/4K3/8/8 w - - 0 40'),
  (2,'4r1k1/5ppp/8/8/8/8/5PPP/4R1K1 b - - 3 30'),
  (3,'r1bq1rk1/ppp2ppp/2n2n2/3p4/3P4/2N2N2/PPP2PPP/R1BQ1RK1 w - - 0 9'),
  (4,'6k1/5q2/8/8/8/8/2Q5/6K1 b - - 1 52'),
  (5,'8/2k5/5n2/8/2N5/3K4/6P1/8 w - - 0 45')) AS t(fen_id, fen)
""",
    "players": r"""
SELECT c_custkey AS player_id, c_name AS username,
  400 + CAST(floor((c_acctbal + 1000) / 4) AS INT) AS rating FROM customer
""",
    "games": r"""
SELECT o_orderkey AS game_id, o_custkey AS player_id, o_orderdate AS end_time,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'bullet' WHEN '2-HIGH' THEN 'blitz' WHEN '3-MEDIUM' THEN 'rapid'
       WHEN '5-LOW' THEN 'daily' ELSE 'unknown' END AS time_class,
  CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS won,
  CASE WHEN o_orderkey % 2 = 0 THEN 'white' ELSE 'black' END AS color,
  CONCAT('Family ', CAST(o_orderkey % 13 AS STRING)) AS opening_family,
  CAST(20 + o_orderkey % 41 AS INT) AS num_moves FROM orders
""",
    "moves": f"""
SELECT l_orderkey AS game_id, l_linenumber AS ply_no, {_category("l_partkey % 24")} AS category,
  CASE l_suppkey % 3 WHEN 0 THEN 'opening' WHEN 1 THEN 'middlegame' ELSE 'endgame' END AS phase,
  CAST(floor(l_extendedprice / 100) AS INT) - 500 AS best_cp,
  CAST(floor(l_extendedprice / 100) AS INT) - 500 - (4 * CAST(l_quantity AS INT) - 40) AS after_cp,
  CASE WHEN l_tax = 0 THEN NULL ELSE CAST(floor(l_extendedprice / 100) AS INT) - 500 - 60 * CAST(floor(l_discount * 100 + 0.5) AS INT) END AS second_cp,
  l_returnflag = 'R' AND l_linestatus = 'F' AS recapture, l_partkey, l_suppkey, l_extendedprice FROM lineitem
""",
    "positions": r"""
SELECT m.*, o_custkey AS player_id FROM moves m JOIN orders ON m.game_id = o_orderkey
""",
    "puzzles": r"""
SELECT CONCAT('p', CAST(p_partkey AS STRING)) AS puzzle_id,
  CASE WHEN p_partkey % 97 = 96 THEN NULL ELSE f.fen END AS fen,
  rtrim(repeat('e2e4 ', CAST(p_size % 9 AS INT))) AS moves,
  CAST(400 + (p_partkey * 7919) % 2900 AS INT) AS rating, CAST(40 + p_size * 3 AS INT) AS rating_deviation,
  CAST(100 - (p_partkey * 17) % 41 * 3 AS INT) AS popularity, CAST((p_partkey * p_size * 13) % 5000 AS INT) AS nb_plays,
  t.themes, p_partkey AS seq FROM part JOIN theme_dim t ON t.theme_id = p_partkey % 18 JOIN fen_dim f ON f.fen_id = p_partkey % 6
""",
    "attempts": f"""
SELECT e.event_id AS attempt_id, e.user_id AS player_id, e.ts,
  CONCAT(CASE WHEN e.event_type = 'signup' THEN 'gen_' ELSE 'p' END, CAST((e.event_id * 7) % 200 AS STRING)) AS puzzle_id,
  {_category("(e.event_id * 5 + e.user_id) % 24")} AS category, CAST(400 + ((e.event_id * 7) % 200 * 7919) % 2900 AS INT) AS rating,
  e.value < 35 AS solved, e.event_type = 'error' AS skipped FROM events e
""",
}

#: What each view reads besides tables.
NEEDS = {"positions": ("moves",), "puzzles": ("theme_dim", "fen_dim")}


def with_views(names: tuple[str, ...], query: str) -> str:
    """The query with the named views, and what they read, as common table expressions."""
    order: list[str] = []
    for name in names:
        for x in (*NEEDS.get(name, ()), name):
            if x not in order:
                order.append(x)
    parts = [f"{x} AS ({VIEWS[x].strip()})" for x in order]
    text = query.strip()
    if text[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + ",\n".join([*parts, text[15:]])
    if text[:5].upper() == "WITH ":
        return "WITH " + ",\n".join([*parts, text[5:]])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + text


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table, over the Parquet files under sf_dir."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = with_views((name,), f"SELECT * FROM {name}")
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "orders", "lineitem", "part", "events", "labels", "documents") if f" {t}" in sql}
    for t, df in frames.items():
        sql = sql.replace(f"FROM {t}", "FROM {" + t + "}").replace(f"JOIN {t} ", "JOIN {" + t + "} ")
    return spark.sql(sql, **frames)
