"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions only.

A source's documents are shuffled anew for each pass over them and laid end to end; that stream is cut into blocks of equal numbers of words.
A source with a target of t words gets ceil(t / block) slots. The slots of all sources together are a line of whole numbers on which each source has a run
as long as its number of slots. Slot i of the mix falls on the i-th van der Corput point (i with its bits turned round), which meets each number of
the line once: so every source gets exactly its slots, and any part of the mix has nearly the wanted shares. A source's slots are ranked in the
order of the mix, and its r-th slot takes the r-th block of its stream, the last one up to the target.

Ranks and offsets are taken in two steps, sums of parts first and places within a part then, so that no source is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, need

WORD = "[^\\x20\\x09-\\x0D]+"
#: A source's weight goes by its place.
WEIGHTS = (1, 2, 3)
#: Slots of a mix, at least, and words of a block, at most.
SLOTS, BLOCK = 1 << 16, 4096
#: Documents of a part of a stream and slots of a part of the mix, on average.
PART = 1 << 14
#: Bytes up to which the table of sources is broadcast; a larger one is shuffled.
SMALL = 8 << 20


def turned(i: Column, bits: int) -> Column:
    """i, below 2^bits, with its bits in reverse order: the van der Corput point of i, times 2^bits."""
    x = i
    for step, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        x = F.shiftright(x, step).bitwiseAND(F.lit(mask)).bitwiseOR(F.shiftleft(x.bitwiseAND(F.lit(mask)), step))
    x = F.shiftrightunsigned(x, 32).bitwiseOR(F.shiftleft(x, 32))
    return F.shiftrightunsigned(x, 64 - bits) if bits else F.lit(0).cast("long")


def _sent(df: DataFrame, sources: DataFrame) -> DataFrame:
    """df, which has a few rows more than sources and no wider ones, to be broadcast if these take SMALL bytes at most."""
    size = sources.agg(F.coalesce(F.sum(F.octet_length("source") + F.lit(64)), F.lit(0)).alias("n")).first().n
    return F.broadcast(df) if size <= SMALL else df


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """(has, source, source_size, weight, target, words): the share of each source of all words, from its size (has, source, source_size).

    Sources by code point, null (has false) last, weigh `weights` in turn. A target stops at `most` times its source's size and what is left goes to the
    others by weight, until none is above: in the order of most * size / weight, sources are full up to a place. words: the target in whole words. The
    windows are over a row for each source.
    """
    place = Window.orderBy(F.desc("has"), "source")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("full", F.lit(most) * F.col("source_size"))
    line = Window.orderBy(F.col("full") / F.col("weight"), F.desc("has"), "source")
    rows = rows.withColumns({
        "rest": F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("full").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "heavy": F.sum("weight").over(line.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    rows = rows.withColumn("stops", wide("full") * F.col("heavy") <= wide("rest") * F.col("weight"))
    # What the sources that don't stop share: the same for all of them.
    open_ = rows.withColumns({
        "rest": F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum(F.when(F.col("stops"), F.col("full"))).over(Window.partitionBy()), F.lit(0)),
        "heavy": F.coalesce(F.sum(F.when(~F.col("stops"), F.col("weight"))).over(Window.partitionBy()), F.lit(1)),
    })
    share = F.col("rest").cast("double") * F.col("weight") / F.col("heavy")
    whole = F.expr("cast(cast(rest as decimal(28,0)) * weight div heavy as long)")
    return open_.select("has", "source", "source_size", "weight", F.when(F.col("stops"), F.col("full").cast("double")).otherwise(share).alias("target"), F.when(F.col("stops"), F.col("full")).otherwise(whole).alias("words"))


def schedule(sources: DataFrame, slots: int, bits: int) -> DataFrame:
    """(has, source, rank, slot): the slots 0 ... 2^bits - 1 of the mix that fall on a source, each with its rank among that source's.

    sources: (has, source, slots), of which there are `slots` together; slots - 1 < 2^bits. Points beyond them stay without a source.
    """
    place = Window.orderBy(F.desc("has"), "source")
    runs = sources.withColumn("end", F.sum("slots").over(place)).withColumn("begin", F.col("end") - F.col("slots"))
    # The line is cut into cells; a source stands in each cell that its run meets, and a point looks in its cell only.
    cell = max(0, bits - 12)
    runs = runs.where("slots > 0").withColumn("cell", F.explode(F.expr(f"sequence(shiftright(begin, {cell}), shiftright(end - 1, {cell}))")))
    points = sources.sparkSession.range(1 << bits).select(F.col("id").alias("slot"), turned(F.col("id"), bits).alias("point")).where(F.col("point") < slots)
    points = points.withColumn("cell", F.shiftright("point", cell))
    met = points.join(_sent(runs.select("cell", "has", "source", "begin", "end"), sources), "cell").where("begin <= point and point < end").select("has", "source", "slot", F.floor(F.col("slot") / PART).alias("part"))
    before = Window.partitionBy("has", "source").orderBy("part")
    parts = met.groupBy("has", "source", "part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(before) - F.col("n"))
    here = Window.partitionBy("has", "source", "part").orderBy("slot")
    ranked = met.withColumn("here", F.row_number().over(here))
    return ranked.join(parts, ["has", "source", "part"]).select("has", "source", (F.col("before") + F.col("here") - 1).alias("rank"), "slot")


def _copies(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(has, source, id, copy, size) of each row: rows with equal source, id and size are numbered, task by task, so that they needn't meet."""
    rows = need(docs, id_col, text_col, source_col).toDF("id", "text", "source")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = rows.select(F.col("source").isNotNull().alias("has"), F.coalesce("source", F.lit("")).alias("source"), "id", size.alias("size"), F.spark_partition_id().alias("task"))
    same = cut(rows.groupBy("has", "source", "id", "size", "task").agg(F.count("*").alias("n")))
    earlier = F.sum("n").over(Window.partitionBy("has", "source", "id", "size").orderBy("task")) - F.col("n")
    return same.withColumn("first", earlier).select("has", "source", "id", "size", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("copy"))


def _laid_out(rows: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """(has, source, id, copy, size, begin, words, number): the documents of each pass that a source's target needs, shuffled, with their first word's place in the source's stream."""
    passes = F.expr("sequence(0L, (words - 1) div source_size)")
    used = sources.where("words > 0").select("has", "source", "source_size", "words", "number")
    rows = rows.where("size > 0").join(_sent(used, sources), ["has", "source"]).withColumn("pass", F.explode(passes))
    code = F.md5(F.concat_ws(":", F.lit(str(seed)), "pass", F.coalesce(F.col("id").cast("string"), F.lit("")), "copy", "size"))
    parts = F.greatest(F.ceil(F.col("number") / PART), F.lit(1)).cast("double")
    # Parts follow each other in the order of the codes: a part is a stretch of them.
    rows = rows.withColumn("code", code).withColumn("part", F.floor(F.conv(F.substring("code", 1, 8), 16, 10).cast("double") / F.lit(2.0**32) * parts))
    key = ["has", "source", "pass", "part"]
    sums = rows.groupBy(*key).agg(F.sum("size").alias("held"))
    sums = sums.withColumn("before", F.sum("held").over(Window.partitionBy("has", "source", "pass").orderBy("part")) - F.col("held")).select(*key, "before")
    within = F.sum("size").over(Window.partitionBy(*key).orderBy("code").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("within", F.coalesce(within, F.lit(0))).join(sums, key)
    begin = F.col("pass") * F.col("source_size") + F.col("before") + F.col("within")
    return rows.select("has", "source", "id", "copy", "size", begin.alias("begin"), "words")


def _sized(rows: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    sizes = rows.groupBy("has", "source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("number"))
    return cut(targets(sizes, weights, most).join(sizes.select("has", "source", "number"), ["has", "source"]))


def _pieces(rows: DataFrame, sources: DataFrame, seed: int, least: int, most_block: int) -> DataFrame:
    spark = rows.sparkSession
    total = sources.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("n")).first().n
    block = max(1, min(most_block, -(-total // least)))
    sources = sources.withColumn("slots", F.expr(f"(words + {block - 1}L) div {block}L"))
    slots = sources.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("n")).first().n
    bits = max(0, slots - 1).bit_length()
    laid = _laid_out(rows, sources, seed).where("begin < words").withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("words")))
    cells = laid.withColumn("rank", F.explode(F.expr(f"sequence(begin div {block}L, (end - 1) div {block}L)")))
    low, high = F.greatest("begin", F.col("rank") * block), F.least("end", (F.col("rank") + 1) * block)
    cells = cells.select("has", "source", "rank", "id", "copy", "size", (low - F.col("begin")).alias("first_word"), (high - low).alias("n_words"))
    return cells.join(schedule(sources, slots, bits), ["has", "source", "rank"]) if slots else cells.withColumn("slot", F.lit(0).cast("long")).limit(0)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: int = 12, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", slots: int = SLOTS, block: int = BLOCK) -> DataFrame:
    """(slot, source, id, copy, first_word, n_words): the mix in pieces of documents; in the order of slot and first_word it is the training stream.

    A slot holds a block of one source, at most `block` words or, for small tables, all words over `slots`. copy numbers the rows of one id, source and size.
    Null and empty texts have no words and no pieces. See `amounts` for the rest.
    """
    rows = _copies(docs, id_col, text_col, source_col)
    pieces = _pieces(rows, _sized(rows, weights, most), seed, slots, block)
    return pieces.select("slot", F.when(F.col("has"), F.col("source")).alias("source"), F.col("id").alias(id_col), "copy", "first_word", "n_words")


def amounts(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: int = 12, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", slots: int = SLOTS, block: int = BLOCK) -> DataFrame:
    """(id, size, source_size, target, taken), a row for each row of docs: how many words the mix takes of it, repeats counted.

    A document's size is its number of words; sources weigh `weights` in turn by code point, a null one last, and share all words; a target stops at `most` times its source's
    size. A source's taken words are its target, in whole words. No document exceeds `most` times its size, as a stream passes each of them once a pass. The shuffle follows
    from ids, sizes and seed, not from the layout, so that reruns agree. Repeated rows, and rows with a null id, each count; those with equal id, source and size may share the number
    taken in either order. Null and empty texts, and sources without words, have size, target and taken 0 where nothing is to be had. An empty table gives no rows.
    """
    rows = _copies(docs, id_col, text_col, source_col)
    sources = _sized(rows, weights, most)
    pieces = _pieces(rows, sources, seed, slots, block)
    key = ["has", "source", "id", "copy", "size"]
    taken = rows.select(*key, F.lit(0).cast("long").alias("n_words")).unionByName(pieces.select(*key, "n_words")).groupBy(*key).agg(F.sum("n_words").alias("taken"))
    return taken.join(_sent(sources, sources), ["has", "source"]).select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")
