"""Readers and writers on small files of their own."""

import json

from skillspark.sources import readers, writers


def dump(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))


def test_attempts_of_sessions(spark, tmp_path):
    h = {"ts": "2024-05-01T10:00:00Z", "puzzleId": "p1", "category": "Fork", "rating": 1500, "solved": True}
    dump(tmp_path / "s" / "ann.json", {"history": [h, {**h, "ts": "bad"}, {**h, "puzzleId": ""}, {**h, "rating": 0}, {**h, "solved": None}], "estimatedElo": 1700})
    dump(tmp_path / "s" / "b.json", {"username": "Bob", "history": [{**h, "solved": False, "extra": 1}]})
    dump(tmp_path / "s" / "c.json", "{not json")
    rows = sorted((r.username, r.puzzle_id, r.rating, r.solved) for r in readers.attempts(spark, str(tmp_path / "s")).collect())
    assert rows == [("Bob", "p1", 1500.0, False), ("ann", "p1", 1500.0, True)]
    assert [(r.username, r.rating, r.rd) for r in readers.player_seeds(spark, str(tmp_path / "s")).collect()] == [("ann", 1700.0, 200.0)]


def test_game_archives(spark, tmp_path):
    games = [{"pgn": "x", "rated": True, "rules": "chess", "accuracies": {"white": 90.0, "black": 80.0}, "white": {"username": "AnnX"}}, {"pgn": "", "rated": True}, {"pgn": "y", "white": {"username": "Zed"}, "accuracies": {"white": 1.0, "black": 2.0}}]
    dump(tmp_path / "a" / "m.json", {"games": games})
    assert sorted((r.pgn, r.accuracy) for r in readers.game_archives(spark, str(tmp_path / "a"), "ann").collect()) == [("x", 90.0), ("y", 2.0)]


def test_cohort_lines_and_norms(spark, tmp_path):
    o = {"category": "Pin", "hit": True, "wp_loss": 1.0, "phase": "opening", "ply": 9}
    dump(tmp_path / "c" / "p.json", {"id": "p", "band": 1, "rating": 1200, "games": [{"end_time": 5, "opportunities": [o, {**o, "hit": False}]}, {"end_time": 6, "opportunities": []}]})
    assert [(r.game, r.place, r.hit) for r in readers.cohort(spark, str(tmp_path / "c")).orderBy("place").collect()] == [(0, 0, True), (0, 1, False)]
    e = {"category": "Fork", "severity": "blunder", "phase": "endgame", "wp_loss": 31.5}
    dump(tmp_path / "e" / "p.json", {"id": "p", "band": 1, "rating": 1200, "games": [{"end_time": 5, "errors": []}, {"end_time": 6, "errors": [e, {**e, "category": "Pin"}]}, {"end_time": 7}]})
    assert [(r.id, r.game, r.place, r.category, r.wp_loss) for r in readers.cohort_errors(spark, str(tmp_path / "e")).orderBy("place").collect()] == [("p", 1, 0, "Fork", 31.5), ("p", 1, 1, "Pin", 31.5)]
    dump(tmp_path / "l.jsonl", '{"player": "a", "game": 1, "x": 1}\n{"player": "a", "game": 1, "x": 2}\n{"player": "b", "ga')
    assert [(r.player, r.x) for r in readers.json_lines(spark, str(tmp_path / "l.jsonl"), "player string, game int, x int", ("player", "game")).collect()] == [("a", 1)]
    dump(tmp_path / "n.json", {"offsets": {"Fork": 1.0}, "shrink_strength": 4})
    assert [tuple(r) for r in readers.norms(spark, str(tmp_path / "n.json")).collect()] == [("Fork", 1.0, 4.0)]
    dump(tmp_path / "bad.json", "[")
    assert readers.norms(spark, str(tmp_path / "bad.json")).collect() == []


def test_puzzle_csv_and_splits(spark, tmp_path):
    head = "PuzzleId,FEN,Moves,Rating,RatingDeviation,Popularity,NbPlays,Themes,GameUrl,OpeningTags\n"
    dump(tmp_path / "p.csv", head + "a,8/8 w,e2e4 e7e5,1100,80,90,500,fork endgame,http://x,\nb,8/8 w,e2e4,2300,80,90,500,rookEndgame,,\n")
    rich = readers.puzzles_csv(spark, str(tmp_path / "p.csv"))
    assert [r.puzzle_id for r in readers.puzzles_csv(spark, str(tmp_path / "p.csv"), low=1200).collect()] == ["b"] and readers.puzzles_csv(spark, str(tmp_path / "p.csv"), sample=1).count() == 1
    writers.processed(rich, str(tmp_path / "whole"))
    assert readers.puzzles_parquet(spark, str(tmp_path / "whole"), ("puzzle_id", "rating")).columns == ["puzzle_id", "rating"] and readers.puzzles_parquet(spark, str(tmp_path / "whole")).columns == rich.columns
    assert {r.puzzle_id: (r.primary_category, r.difficulty_tier, r.move_length) for r in rich.collect()} == {"a": ("Fork", "Easy", "short"), "b": ("Rook Endgame", "Master", "oneMove")}
    writers.split_by(rich, "categories", str(tmp_path / "out"))
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {"part=Fork", "part=Endgame", "part=Rook_Endgame"}
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.where("part = 'Endgame'").count() == 2


def test_report_and_edits(spark, tmp_path):
    writers.report(spark.createDataFrame([(1, float("nan")), (2, 0.5)], "k int, x double"), str(tmp_path / "r"))
    assert {r.k: r.x for r in spark.read.schema("k int, x double").json(str(tmp_path / "r")).collect()} == {1: None, 2: 0.5}
    stored = spark.createDataFrame([(1, "a", None), (1, "b", "liked"), (1, "c", "liked"), (2, "a", None)], "player_id int, puzzle_id string, feedback string")
    edits = spark.createDataFrame([(1, "a", 1, "feedback", "liked"), (1, "b", 2, "feedback", None), (1, "c", 3, "delete", None), (2, "*", 4, "delete", None)], "player_id int, puzzle_id string, seq int, action string, feedback string")
    assert sorted(tuple(r) for r in writers.apply_edits(stored, edits).select("player_id", "puzzle_id", "feedback").collect()) == [(1, "a", "liked"), (1, "b", None)]


def test_mined_puzzles_and_their_report(spark, tmp_path):
    p = {"PuzzleId": "gen_1", "FEN": "8/8 w", "Moves": "e2e4", "Rating": 1200, "PrimaryCategory": "Fork", "evalDrop": 200}
    dump(tmp_path / "m" / "ann.json", [p, {**p, "PuzzleId": "gen_2"}])
    dump(tmp_path / "m" / "retired" / "ann.json", [{**p, "PuzzleId": "gen_3"}])
    dump(tmp_path / "m" / "bob.json", "{broken")
    rows = readers.mined_puzzles(spark, str(tmp_path / "m"))
    assert sorted((r.username, r.PuzzleId, r.retired) for r in rows.collect()) == [("ann", "gen_1", False), ("ann", "gen_2", False), ("ann", "gen_3", True)]
    writers.report_with_rows(rows.groupBy().count(), rows.select("PuzzleId", "Rating"), str(tmp_path / "rep"))
    assert spark.read.json(str(tmp_path / "rep" / "summary")).collect()[0].summary["count"] == 3
    assert sorted(r.item.PuzzleId for r in spark.read.json(str(tmp_path / "rep" / "items")).collect()) == ["gen_1", "gen_2", "gen_3"]


def test_appended_attempts_leave_out_skipped_ones(spark, tmp_path):
    spark.createDataFrame([(1, False), (2, True), (3, None)], "attempt_id long, skipped boolean").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("attempt_id long, skipped boolean").parquet(str(tmp_path / "in"))
    q = writers.append_attempts(stream, str(tmp_path / "log"), str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.attempt_id for r in spark.read.parquet(str(tmp_path / "log")).collect()) == [1, 3]
