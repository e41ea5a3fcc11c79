"""Column expressions over puzzle rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..taxonomy import GENERAL, PRIORITY, TAG_CATEGORIES, THEMES, TIERS, TOP_TIER


def tokens(text: Column) -> Column:
    """Parts at white space; none for null."""
    return F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), "\\s+"), lambda s: s != "")


def strings(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def categories_of(tags: Column) -> Column:
    """Categories of all tags, each once, in the order of the tags; unknown tags have none."""
    known = F.create_map(*[x for tag, c in TAG_CATEGORIES.items() for x in (F.lit(tag), strings(c))])
    return F.array_distinct(F.flatten(F.transform(tags, lambda t: F.coalesce(F.try_element_at(known, t), strings(())))))


def primary_category(tags: Column) -> Column:
    """The most specific category that one of the tags decides."""
    out = F.lit(GENERAL)
    for category, deciding in reversed(PRIORITY):
        out = F.when(F.arrays_overlap(tags, strings(deciding)), category).otherwise(out)
    return out


def difficulty_tier(rating: Column) -> Column:
    out = F.lit(TOP_TIER)
    for name, low, high in TIERS:
        out = F.when(rating.between(low, high), name).otherwise(out)
    return out


def mined_tier(rating: Column) -> Column:
    """Five bands of mined puzzles, apart from those of the pool."""
    return F.when(rating < 1000, "Beginner").when(rating < 1300, "Easy").when(rating < 1600, "Intermediate").when(rating < 1900, "Advanced").otherwise("Expert")


def move_length(moves: Column) -> Column:
    n = F.size(tokens(moves))
    return F.when(n <= 1, "oneMove").when(n <= 3, "short").when(n <= 7, "long").otherwise("veryLong")


def theme_multihot(tags: Column, themes: tuple[str, ...] = THEMES) -> Column:
    """A 0 or 1 for each theme of the vocabulary; other tags count nothing."""
    return F.transform(strings(themes), lambda t: F.array_contains(tags, t).cast("int"))


def json_safe(x: Column) -> Column:
    """Null for what JSON can't hold."""
    return F.when(~(F.isnan(x) | x.isin(float("inf"), float("-inf"))), x)


def hash_split(identifier: Column) -> Column:
    """2 % val, 3 % test, the rest train, by the identifier's md5."""
    bucket = F.conv(F.substring(F.md5(identifier.cast("binary")), 1, 8), 16, 10).cast("long") % 100
    return F.when(bucket < 2, "val").when(bucket < 5, "test").otherwise("train")


def mined_puzzle_id(fen: Column, moves: Column) -> Column:
    return F.concat(F.lit("gen_"), F.substring(F.md5(F.concat(fen, F.replace(moves, F.lit(" "), F.lit(""))).cast("binary")), 1, 8))


def mined_rating(drop: Column, length: Column) -> Column:
    raw = F.lit(800) + F.lit(0.6) * F.least(drop - 150, F.lit(700)) + F.lit(150) * (length - 2)
    return F.least(F.greatest(raw.cast("int"), F.lit(700)), F.lit(2400))


def truncate_line(moves: Column, row: Column) -> Column:
    """The first 2k - 1 plies, where k, 1 to 3, follows from the row's number and isn't above the solver's moves."""
    n = F.size(moves)
    k = F.least(1 + F.pmod(row * F.lit(2654435761).cast("long"), F.lit(3)), F.floor((n + 1) / 2))
    return F.slice(moves, 1, F.greatest(2 * k - 1, F.lit(0)).cast("int"))
