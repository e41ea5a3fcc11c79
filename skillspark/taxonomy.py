"""Categories, theme tags and bands that the operators use."""

from __future__ import annotations

# The categories of a skill profile in their order, which breaks ties; General comes last and isn't an arm.
ARMS = (
    "Fork", "Pin", "Skewer", "Discovered Attack", "Hanging Piece", "Sacrifice", "Deflection", "Attraction", "Interference", "Clearance", "Quiet Move", "Zugzwang",
    "X-Ray Attack", "King Safety", "Mating Pattern", "Endgame", "Rook Endgame", "Queen Endgame", "Pawn Endgame", "Bishop Endgame", "Knight Endgame", "Promotion", "En Passant",
)
GENERAL = "General"

# Theme tags that mean a forced mate.
MATES = (
    "mate", "mateIn1", "mateIn2", "mateIn3", "mateIn4", "mateIn5", "smotheredMate", "bodensMate", "arabianMate", "anastasiaMate", "backRankMate", "doubleBishopMate",
    "hookMate", "epauletteMate", "killBoxMate", "dovetailMate", "vukovicMate", "operaMate",
)

# Primary categories from the most to the least specific, with their tags.
PRIORITY = (
    ("Mating Pattern", MATES),
    ("Fork", ("fork",)),
    ("Pin", ("pin",)),
    ("Skewer", ("skewer",)),
    ("Discovered Attack", ("discoveredAttack", "doubleCheck")),
    ("X-Ray Attack", ("xRayAttack",)),
    ("Deflection", ("deflection", "capturingDefender")),
    ("Attraction", ("attraction",)),
    ("Interference", ("interference", "intermezzo")),
    ("Clearance", ("clearance",)),
    ("Hanging Piece", ("hangingPiece", "trappedPiece")),
    ("Sacrifice", ("sacrifice",)),
    ("Promotion", ("promotion", "underPromotion")),
    ("En Passant", ("enPassant",)),
    ("Zugzwang", ("zugzwang",)),
    ("Quiet Move", ("quietMove",)),
    ("King Safety", ("exposedKing", "kingsideAttack", "queensideAttack")),
    ("Rook Endgame", ("rookEndgame",)),
    ("Pawn Endgame", ("pawnEndgame",)),
    ("Queen Endgame", ("queenEndgame", "queenRookEndgame")),
    ("Bishop Endgame", ("bishopEndgame",)),
    ("Knight Endgame", ("knightEndgame",)),
    ("Endgame", ("endgame", "bishopVsKnight")),
)

#: All categories of a tag: those that it decides, its kind of endgame, and its phase.
TAG_CATEGORIES: dict[str, tuple[str, ...]] = {
    **{tag: (category,) for category, tags in PRIORITY for tag in tags},
    **{tag: ("Endgame", category) for category, tags in PRIORITY if category.endswith(" Endgame") for tag in tags},
    "queenRookEndgame": ("Endgame", "Queen Endgame", "Rook Endgame"),
    "castling": ("Castling",),
    "opening": ("Opening",),
    "middlegame": ("Middlegame",),
}

# Rating bands, both ends included, and what doesn't fall into one.
TIERS = (("Beginner", 0, 999), ("Easy", 1000, 1199), ("Intermediate", 1200, 1499), ("Advanced", 1500, 1799), ("Hard", 1800, 1999), ("Expert", 2000, 2199), ("Master", 2200, 9999))
TOP_TIER = "Master"
# Tags of puzzles that aren't served.
UNSERVED = ("equality", "defensiveMove")
# The themes that a classifier predicts; tags of source and length aren't among them.
THEMES = (
    "advancedPawn", "advantage", "anastasiaMate", "arabianMate", "attackingF2F7", "attraction", "backRankMate", "balestraMate", "bishopEndgame", "blindSwineMate", "bodenMate", "capturingDefender", "castling",
    "clearance", "collinearMove", "cornerMate", "crushing", "defensiveMove", "deflection", "discoveredAttack", "discoveredCheck", "doubleBishopMate", "doubleCheck", "dovetailMate", "enPassant", "endgame",
    "epauletteMate", "equality", "exposedKing", "fork", "hangingPiece", "hookMate", "interference", "intermezzo", "killBoxMate", "kingsideAttack", "knightEndgame", "mate", "mateIn1", "mateIn2", "mateIn3",
    "mateIn4", "mateIn5", "middlegame", "morphysMate", "opening", "operaMate", "pawnEndgame", "pillsburysMate", "pin", "promotion", "queenEndgame", "queenRookEndgame", "queensideAttack", "quietMove",
    "rookEndgame", "sacrifice", "skewer", "smotheredMate", "swallowstailMate", "trappedPiece", "triangleMate", "underPromotion", "vukovicMate", "xRayAttack", "zugzwang",
)
