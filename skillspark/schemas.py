"""Explicit schemas of the raw inputs."""

PUZZLES_CSV = "PuzzleId string, FEN string, Moves string, Rating int, RatingDeviation int, Popularity int, NbPlays int, Themes string, GameUrl string, OpeningTags string"

SESSION = (
    "username string, estimatedElo double, bestStreak int, "
    "history array<struct<ts: string, puzzleId: string, category: string, rating: double, solved: boolean, policy: string, selected: string, relabelled: boolean, propensity: double, source: string, predicted: double>>"
)

ARCHIVE = (
    "games array<struct<pgn: string, rated: boolean, rules: string, time_class: string, time_control: string, end_time: long, "
    "accuracies: struct<white: double, black: double>, white: struct<username: string>, black: struct<username: string>>>"
)

COHORT = (
    "id string, band int, rating double, time_class string, "
    "games array<struct<end_time: long, time_class: string, opportunities: array<struct<category: string, hit: boolean, wp_loss: double, phase: string, ply: int>>, errors: array<struct<category: string, severity: string, phase: string, wp_loss: double>>>>"
)

MINED = "PuzzleId string, FEN string, Moves string, Rating int, RatingDeviation int, PrimaryCategory string, evalDrop int, clarityCp int, playerMoves int, generatedBy string, source string"
