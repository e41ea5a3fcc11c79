"""Benchmark passages in documents, also with other numbers, names and units, by template canonicalisation.

Words become template tokens: a literal (its lower-case core without punctuation at the ends), or a slot: a typed placeholder for a
number, a unit after a number, or a name (a capitalised word that doesn't begin a sentence). A capitalised word that
begins a sentence may be either and is left out on both sides. A window is `width` literals in sequence with the slots between
them, however many these are, so that questions that consist of slots for the most part have windows too. Windows are hashed and
joined with those of the benchmark; a pair of windows counts if the values in its slots correspond one to one, so that a
question asked again with other values is caught and a chance likeness of slots is not. Items of fewer literals are
sought whole, with the slots at their ends.

Text is read in two ways: as it is written, and in lower case, where no word is a name or left out and all of them are literals. The second
finds what has been asked again in other letter case, with other numbers and units as well. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import need

#: Literals of a window, and of the shortest items that are sought.
WIDTH, LEAST = 8, 4
#: Benchmarks of more windows than this aren't broadcast.
MOST_BROADCAST = 2_000_000
# Unit names that count as units after a number.
UNITS = (
    "%", "percent", "mm", "cm", "m", "km", "in", "inch", "inches", "ft", "foot", "feet", "yd", "yards", "mi", "mile", "miles", "mg", "g", "kg", "gram", "grams",
    "oz", "lb", "lbs", "pound", "pounds", "ton", "tons", "ml", "l", "litre", "litres", "liter", "liters", "gallon", "gallons", "ms", "s", "sec", "second", "seconds", "min",
    "minute", "minutes", "h", "hr", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "dollar", "dollars", "cent", "cents", "euro",
    "euros", "usd", "eur", "c", "f", "k", "w", "kw", "kwh", "v", "a", "hz", "khz", "mhz", "ghz", "b", "kb", "mb", "gb", "tb", "mph", "kph",
)
_WS = "\\x20\\x09-\\x0D"
_ALNUM = "\\p{L}\\p{N}"
# \x01 begins a slot, \x02 its value, \x03 ends it. Each pattern begins with the character to look for and only then looks back, which most characters fail at once.
_NAME = f"\\p{{Lu}}(?<=[^.!?:{_WS}][{_WS}]\\p{{Lu}})[{_ALNUM}]*+"
_HEAD = f"\\p{{Lu}}(?<=(?:^|[.!?:][{_WS}]{{1,3}})\\p{{Lu}})[{_ALNUM}]*+"
_NUMBER = f"[0-9](?<![{_ALNUM}][0-9])[0-9]*+(?:[.,:/\x02-][0-9]++)*+(?![{_ALNUM}])"
_UNIT = "(?i)(\x01num[0-9\x02]*+\x03 )(" + "|".join(sorted(UNITS, key=len, reverse=True)) + f")(?![{_ALNUM}])"
_SLOT = "\x01[^\x03]*\x03"


def _tokens(text: Column, values: bool = False, cased: bool = True) -> Column:
    """The literals of a text, read as it is written or in lower case, each after the slots that stand between it and the literal before; after the last slots an empty one.

    With values, \x02 and the value follow each slot's kind; there are as many literals either way.
    """
    value = "\x02$0" if values else ""
    text = F.regexp_replace(text if cased else F.lower(text), "[\x01\x02\x03]", " ")
    if values:  # keeps the parts of a number in one token
        text = F.regexp_replace(text, "(?<=[0-9])[.,:/-](?=[0-9])", "\x02")
    if cased:
        text = F.regexp_replace(text, _NAME, f"\x01name{value}\x03")
        text = F.regexp_replace(text, _HEAD, " ")
    text = F.regexp_replace(text, _NUMBER, f"\x01num{value}\x03")
    text = F.regexp_replace(text, _UNIT, "$1\x01unit" + ("\x02$2" if values else "") + "\x03")
    text = F.regexp_replace(F.lower(text), f"\x03[^{_ALNUM}\x01]+", "\x03")  # slots go to the literal that follows
    return F.array_remove(F.split(text, f"[^{_ALNUM}\x01\x02\x03]+"), "")


def _literal(token: Column) -> Column:
    return F.substring_index(token, "\x03", -1)


def _kinds(tokens: Column) -> Column:
    """Tokens without the values of their slots."""
    return F.transform(tokens, lambda t: F.regexp_replace(t, "\x02[^\x03]*\x03", "\x03"))


def _slots(tokens: Column) -> Column:
    """The slots of tokens, with kind and value."""
    return F.regexp_extract_all(F.array_join(tokens, ""), F.lit(f"({_SLOT})"), 1)


def _consistent(a: Column, b: Column) -> Column:
    """Whether slots have the same kinds and their values correspond one to one."""
    both = F.size(F.array_distinct(F.arrays_zip(a.alias("a"), b.alias("b"))))
    return _kinds(a).eqNullSafe(_kinds(b)) & (both == F.size(F.array_distinct(a))) & (both == F.size(F.array_distinct(b)))


def _windows(df: DataFrame, keys: list[str], width: int) -> DataFrame:
    """keys, pos, h: a row for each window of `width` literals; the slots before its first literal aren't part of it."""
    # No filter on these arrays, and none inferred from an inner explode: pushed down, it would work them out again.
    df = df.select(*keys, F.transform("tokens", lambda t: F.xxhash64(_literal(t))).alias("h"), F.transform("tokens", lambda t: F.xxhash64(t)).alias("run"))
    done, step, left = 1, 1, width - 1
    while left:  # the first literal, and then runs of 1, 2, 4 ... tokens as width - 1 needs them
        if left & 1:
            df = df.withColumn("h", F.zip_with("h", F.slice("run", done + 1, F.greatest(F.size("run"), F.lit(1))), lambda a, b: F.xxhash64(a, b)))
            done += step
        left >>= 1
        if left:
            df = df.withColumn("run", F.zip_with("run", F.slice("run", step + 1, F.greatest(F.size("run"), F.lit(1))), lambda a, b: F.xxhash64(a, b)))
            step *= 2
    # Runs across the end of the text are null or short there, and no window begins so late.
    return df.select(*keys, F.posexplode_outer(F.slice("h", 1, F.greatest(F.size("h") - (width - 1), F.lit(0)))).alias("pos", "h"))


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    df = need(df, id_col, text_col).where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col), F.lit(11)).alias("key"))


def _pairs(docs: DataFrame, benchmark: DataFrame, *how) -> DataFrame:
    """_read in both ways, with the way as the column cased: 1 as written, 0 in lower case."""
    return _read(docs, benchmark, *how, True).withColumn("cased", F.lit(1)).unionByName(_read(docs, benchmark, *how, False).withColumn("cased", F.lit(0)))


def _read(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, width: int, least: int, cased: bool) -> DataFrame:
    """(id, key, item, pos, exact): the places of documents where a window of an item stands; key is the hash of the document's text."""
    items = _texts(benchmark, item_col, item_text).select("id", "text").distinct().select(F.col("id").alias("item"), _tokens(F.col("text"), True, cased).alias("full"))
    items = items.select("item", "full", (F.size("full") - F.when(_literal(F.try_element_at("full", F.lit(-1))) == "", 1).otherwise(0)).alias("n")).where(F.col("n") >= least)
    # An item's windows have `width` literals, or all that it has: the short widths are at most width - least in number.
    items = items.select("item", "full", "n", F.least("n", F.lit(width)).alias("w"), F.slice(_kinds(F.col("full")), 1, F.col("n")).alias("tokens"))
    widths = [r.w for r in items.select("w").distinct().orderBy("w").collect()]
    texts = _texts(docs, id_col, text_col)
    ours, theirs = None, None
    tokens = texts.select("id", "key", _tokens(F.col("text"), False, cased).alias("tokens"))
    for w in widths or [width]:
        found = _windows(items.where(F.col("w") == w), ["item", "full", "n"], w).where("h is not null").withColumn("w", F.lit(w))
        ours = found if ours is None else ours.unionByName(found)
        wanted = found.select("h").distinct()
        # The benchmark's size is counted before anything of it is broadcast; a larger one is joined by a shuffle.
        if wanted.count() <= MOST_BROADCAST:
            wanted = F.broadcast(wanted)
        places = _windows(tokens, ["id", "key"], w).join(wanted, "h", "left_semi").select("id", "key", F.struct("pos", "h", F.lit(w).alias("w")).alias("place"))
        theirs = places if theirs is None else theirs.unionByName(places)
    whole = F.col("n") < width  # such an item has one window, all its literals; the slots before and after them count as well
    ours = ours.select(
        "item", "h", "w", F.slice("full", F.col("pos") + 1, F.col("w")).alias("window"),
        F.when(whole, _slots(F.slice("full", F.col("pos") + 1, 1))).otherwise(F.array().cast("array<string>")).alias("lead"),
        F.when(whole & (F.size("full") > F.col("n")), _slots(F.slice("full", F.col("n") + 1, 1))).otherwise(F.array().cast("array<string>")).alias("trail"),
    )
    inner = lambda window: F.concat(F.array(_literal(F.try_element_at(window, F.lit(1)))), F.slice(window, 2, F.greatest(F.size(window) - 1, F.lit(0))))
    ours = ours.withColumn("window", inner(F.col("window"))).distinct()
    hit = texts.join(theirs.groupBy("id", "key").agg(F.collect_set("place").alias("places")), ["id", "key"]).dropDuplicates(["id", "key"])
    hit = hit.select("id", "key", _tokens(F.col("text"), True, cased).alias("full"), "places").select("id", "key", "full", F.explode("places").alias("place"))
    hit = hit.select(
        "id", "key", "place.pos", "place.h", "place.w", inner(F.slice("full", F.col("place.pos") + 1, F.col("place.w"))).alias("text_window"),
        _slots(F.slice("full", F.col("place.pos") + 1, 1)).alias("before"), _slots(F.slice("full", F.col("place.pos") + 1 + F.col("place.w"), 1)).alias("after"),
    )
    pairs = hit.join(ours, ["h", "w"]).where(_kinds(F.col("text_window")).eqNullSafe(_kinds(F.col("window"))) & (F.size("before") >= F.size("lead")) & (F.size("after") >= F.size("trail")))
    before = F.slice("before", F.size("before") - F.size("lead") + 1, F.size("lead"))
    slots = F.concat(before, _slots(F.col("text_window")), F.slice("after", 1, F.size("trail")))
    pairs = pairs.select("id", "key", "item", "pos", slots.alias("slots"), F.concat("lead", _slots(F.col("window")), "trail").alias("item_slots"))
    return pairs.where(_consistent(F.col("slots"), F.col("item_slots"))).groupBy("id", "key", "item", "pos").agg(F.max(F.col("slots") == F.col("item_slots")).alias("exact"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH, least: int = LEAST) -> DataFrame:
    """(id, item_id, n_windows, n_exact): the pairs of a document and a benchmark item that share a window.

    A window is `width` literals in sequence and the slots between them; items with fewer literals, but `least` of them, are sought
    whole. n_windows counts the places in the document where a window matches with consistent slots, n_exact those with equal values
    in all slots; both are of the text as it is written or, where that has none, of the text in lower case. Rows of docs or benchmark with a null id or text, and empty texts, match nothing; repeated rows count
    once, rows with one id and several texts together. Whole texts are searched, however long; empty tables give no rows.
    """
    pairs = _pairs(docs, benchmark, id_col, text_col, item_col, item_text, width, least)
    counts = pairs.groupBy("id", "item", "cased").agg(F.count("*").alias("n_windows"), F.count_if("exact").alias("n_exact"))
    best = counts.groupBy("id", "item").agg(F.max(F.struct("cased", "n_windows", "n_exact")).alias("x"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "x.n_windows", "x.n_exact")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH, least: int = LEAST) -> DataFrame:
    """The rows of docs that share no window with the benchmark, with all their columns; rows with a null id or text stay, and so does a clean row that has its id in common with another."""
    found = _pairs(docs, benchmark, id_col, text_col, item_col, item_text, width, least).select("id", "key").distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`"), F.lit(11)).alias("key"), row)
    return rows.join(found, ["id", "key"], "left_anti").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
