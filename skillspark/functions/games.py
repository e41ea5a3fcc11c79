"""Column expressions over games, positions and their evaluations."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Of the published formulas for win chances and accuracy, and of the rating scale.
MATE_CP = 9000.0
WIN_SLOPE = 0.00368208
SCALE = 400 / math.log(10)


def win_percent(cp: Column) -> Column:
    """Win expectation of 0 to 100 from centipawns; null for null."""
    cp = F.least(F.greatest(cp.cast("double"), F.lit(-MATE_CP)), F.lit(MATE_CP))
    return 50.0 + 50.0 * (2.0 / (1.0 + F.exp(-WIN_SLOPE * cp)) - 1.0)


def severity(loss: Column) -> Column:
    return F.when(loss >= 15, "blunder").when(loss >= 10, "mistake").when(loss >= 5, "inaccuracy")


def mate_to_cp(mate: Column, cp: Column) -> Column:
    return F.when(mate > 0, MATE_CP).when(mate <= 0, -MATE_CP).otherwise(cp.cast("double"))


def accuracy_estimate(wp_loss: Column, cp_loss: Column) -> Column:
    x = F.when((wp_loss <= 0) & (cp_loss > 0), cp_loss * 0.092).otherwise(wp_loss)
    return F.when(x <= 0, 100.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 103.1668 * F.exp(-0.04354 * x) - 3.1669)))


def logit(p: Column, low: float = 0.02, high: float = 0.98) -> Column:
    p = F.least(F.lit(high), F.greatest(F.lit(low), p))
    return F.log(p / (1.0 - p))


def sigmoid(z: Column) -> Column:
    return F.when(z >= 0, 1.0 / (1.0 + F.exp(-z))).otherwise(F.exp(z) / (1.0 + F.exp(z)))


def kappa(variance: Column) -> Column:
    return 1.0 / F.sqrt(1.0 + 3.0 * variance / (math.pi**2))


def rating_to_logit(rating: Column) -> Column:
    return (rating - 1500.0) / SCALE


def logit_to_rating(z: Column) -> Column:
    return 1500.0 + SCALE * z


def static_elo(puzzle: Column, player: Column) -> Column:
    return 1.0 / (1.0 + F.pow(F.lit(10.0), (puzzle - F.coalesce(player, F.lit(1500.0))) / 400.0))


def rating_band(rating: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, (low, high) in enumerate(((0, 1000), (1000, 1400), (1400, 1800), (1800, 2200), (2200, 3500))):
        out = F.when((rating >= low) & (rating < high), i).otherwise(out)
    return out


def nearest_level(rating: Column) -> Column:
    """Nearest of 1100 to 1900 in steps of 100, ties to the lower."""
    return F.least(F.lit(1900), F.greatest(F.lit(1100), (100 * F.ceil((rating - 50) / 100)).cast("int")))


def clamp_rating(rating: Column) -> Column:
    return F.least(F.greatest(F.bround(rating).cast("int"), F.lit(400)), F.lit(3200))


def prob_logodds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(5e-5)), F.lit(1 - 1e-4))
    return F.log(p) - F.log1p(-p)


def player_color(white: Column, black: Column, user: Column) -> Column:
    """Exact names first, whatever their case; then whether White's name contains the user's."""
    w, b, u = F.lower(white), F.lower(black), F.lower(user)
    return F.when(w == u, "white").when(b == u, "black").when(w.contains(u), "white").otherwise("black")


def outcome(result: Column, color: Column) -> Column:
    """Whether the player won; null for a draw or an unknown result."""
    return F.when(result == "1-0", color == "white").when(result == "0-1", color == "black")


def time_class(control: Column) -> Column:
    c = F.trim(F.coalesce(control, F.lit("")))
    base, inc = F.split_part(c, F.lit("+"), F.lit(1)), F.split_part(c, F.lit("+"), F.lit(2))
    estimate = base.try_cast("double") + 40.0 * F.when(inc == "", 0.0).otherwise(inc.try_cast("double"))
    return F.when(c.isin("", "-"), "unknown").when(c.contains("/"), "daily").when(estimate.isNull(), "unknown").when(estimate < 180, "bullet").when(estimate < 600, "blitz").otherwise("rapid")


def time_weight(name: Column) -> Column:
    return F.when(name == "bullet", 0.5).when(name == "blitz", 0.85).when(name.isin("rapid", "daily"), 1.0).otherwise(0.85)


def tag(pgn: Column, key: str) -> Column:
    """The value of a [Key "Value"] line, null where there is none."""
    return F.nullif(F.regexp_extract(pgn, f'\\[{key} "([^"]*)"\\]', 1), F.lit(""))


def end_time(pgn: Column) -> Column:
    """Unix seconds (UTC) of the first valid pair of date and time tags."""
    pairs = ((tag(pgn, "EndDate"), tag(pgn, "EndTime")), (tag(pgn, "UTCDate"), tag(pgn, "UTCTime")), (tag(pgn, "Date"), F.lit("00:00:00")))
    return F.coalesce(*[F.unix_timestamp(F.try_to_timestamp(F.concat(d, F.lit(" "), F.substring(t, 1, 8)), F.lit("yyyy.MM.dd HH:mm:ss"))) for d, t in pairs])


def opening_slug(pgn: Column) -> Column:
    url = F.element_at(F.split(F.rtrim(tag(pgn, "ECOUrl"), F.lit("/")), "/"), -1)
    return F.coalesce(F.replace(url, F.lit("-"), F.lit(" ")), tag(pgn, "Opening"), F.lit("Unknown"))


# Names of opening families.
FAMILIES = (
    "Italian Game", "Ruy Lopez", "Sicilian Defense", "French Defense", "Caro Kann", "Kings Indian", "Queens Indian", "Queens Gambit", "Kings Gambit", "English Opening", "Nimzo Indian", "Dutch Defense",
    "Pirc Defense", "Modern Defense", "Grunfeld Defense", "Benoni Defense", "London System", "Catalan Opening", "Scotch Game", "Vienna Game", "Four Knights", "Three Knights", "Two Knights", "Giuoco Piano",
    "King Pawn", "Queens Pawn", "Bogo Indian", "Old Indian",
)


def opening_family(name: Column) -> Column:
    """The family that the name begins with, whatever its case; else its first two words. No family's name begins with another's."""
    known = F.coalesce(*[F.when(F.startswith(F.lower(name), F.lit(x.lower())), x) for x in FAMILIES])
    words = F.filter(F.split(name, r"\s+"), lambda w: w != "")
    return F.coalesce(known, F.when(F.size(words) >= 2, F.array_join(F.slice(words, 1, 2), " ")).otherwise(name))


def opening_first_word(pgn: Column) -> Column:
    """The first word of the opening's address, capitalised; null without one."""
    slug = F.element_at(F.split(F.rtrim(tag(pgn, "ECOUrl"), F.lit("/")), "/"), -1)
    return F.nullif(F.initcap(F.split_part(slug, F.lit("-"), F.lit(1))), F.lit(""))


def player_color_loose(white: Column, black: Column, user: Column) -> Column:
    """The side whose name contains the user's, White's first; null where neither does."""
    u = F.lower(user)
    return F.when(F.lower(white).contains(u), "white").when(F.lower(black).contains(u), "black")


def safe_int(text: Column, default: int | None = None) -> Column:
    """A whole number, or the default where the text is missing or no number."""
    return F.coalesce(F.trim(text).try_cast("int"), F.lit(default).cast("int"))


def clock_seconds(movetext: Column) -> Column:
    """Seconds of each clock comment, in order."""
    parts = F.regexp_extract_all(movetext, F.lit(r"\[%clk (\d+:\d+:\d+(?:\.\d+)?)\]"), 1)
    return F.transform(parts, lambda c: F.split(c, ":")[0].cast("double") * 3600 + F.split(c, ":")[1].cast("double") * 60 + F.split(c, ":")[2].cast("double"))


def ply_count(movetext: Column) -> Column:
    """Tokens of the main line: without comments, variations, move numbers and results."""
    line = F.regexp_replace(F.regexp_replace(movetext, r"\{[^}]*\}", " "), r"\([^()]*\)", " ")
    words = F.filter(F.split(F.trim(line), r"\s+"), lambda t: (t != "") & ~t.rlike(r"^(\d+\.+|1-0|0-1|1/2-1/2|\*|\$\d+)$"))
    return F.size(words)


def termination_class(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.when(t.contains("checkmate"), "checkmate").when(t.contains("resign"), "resignation").when(t.contains("time"), "timeout").otherwise("other")


def board(fen: Column) -> Column:
    return F.split_part(fen, F.lit(" "), F.lit(1))


def pieces(fen: Column, kinds: str) -> Column:
    """How many of the given letters the board has."""
    b = board(fen)
    return F.length(b) - F.length(F.translate(b, kinds, ""))


def material(fen: Column, white: bool, pawns: bool = True) -> Column:
    values = (("p", 1), ("n", 3), ("b", 3), ("r", 5), ("q", 9))
    return sum((pieces(fen, k.upper() if white else k) * n for k, n in values if pawns or k != "p"), F.lit(0))


def game_phase(fen: Column) -> Column:
    n = pieces(fen, "pnbrqkPNBRQK")
    return F.when(n >= 28, "opening").when(n >= 14, "middlegame").otherwise("endgame")


def endgame_label(fen: Column) -> Column:
    """The kind of endgame by the pieces besides kings and pawns; null before the endgame."""
    q, r, b, n = (pieces(fen, k) > 0 for k in ("qQ", "rR", "bB", "nN"))
    return (
        F.when(~(q | r | b | n), "Pawn Endgame").when(r & ~(q | b | n), "Rook Endgame").when(q & ~(b | n), "Queen Endgame").when(b & ~(q | r | n), "Bishop Endgame")
        .when(n & ~(q | r | b), "Knight Endgame").when(game_phase(fen) == "endgame", "Endgame")
    )


def endgame_flags(fen: Column) -> Column:
    """All flags of an endgame that hold, in order."""
    q, r, b, n = (pieces(fen, k) > 0 for k in ("qQ", "rR", "bB", "nN"))
    flags = (("eg_pawn", ~(q | r | b | n)), ("eg_rook", r & ~(q | b | n)), ("eg_queen", q & ~(r | b | n)), ("eg_queen_rook", q & r & ~(b | n)), ("eg_bishop", b & ~(q | r | n)), ("eg_knight", n & ~(q | r | b)), ("no_queens", ~q))
    return F.array_compact(F.array(*[F.when(on, name) for name, on in flags]))


def grade(best: Column, after: Column, second: Column, recapture: Column) -> dict[str, Column]:
    """Columns wp_loss, cp_loss, critical, hit and severity of a move from its evaluations."""
    loss = F.greatest(F.lit(0.0), win_percent(best) - win_percent(after))
    cp = F.least(F.lit(1000), F.greatest(F.lit(0), best - after))
    critical = second.isNotNull() & ~recapture & (win_percent(best) - win_percent(second) >= 10.0)
    return {"wp_loss": loss, "cp_loss": cp, "critical": critical, "hit": loss < 5.0, "severity": severity(loss)}
