"""Removal of passages that occur more than once, by relative Lempel-Ziv parsing.

1. Anchors. Of the k-grams of words in each window of `length` words, the one with the smallest hash is the
   window's anchor; it depends on the window's words alone, so equal windows have equal anchors. Anchors
   that occur once over all documents end here.
2. Index. Each remaining anchor of a document carries the reference block around it as the hashes of the windows
   that it anchors. Equal blocks are summed first; then, for each anchor, the blocks of all documents meet
   and every window is looked up in all of them. A window that starts in two places gets two references to where
   else it starts.
3. Parsing. Each document is factored greedily: from the first window with a reference, the reference that
   reaches furthest is followed while the next window continues it. Of all places where a window starts, the first and the last are
   kept as references, which is enough to know that it starts elsewhere; that look-up in all blocks decides what goes, and the parse
   gives it the form of factors. Windows across the end of a factor have been looked up like all others and begin the next factor.
   Factors have at least `length` words by construction; their words go.

Anchors in more than `hot` places (a license line, say) are spread by the hash of the whole window in place of the
anchor's, so that no task gets all blocks around a frequent k-gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.store import Store
from .common import as_bytes, hashes, mix, need, slices, small_batches, words_of

LENGTH, K, HOT = 35, 8, 10_000
#: Hot anchors that are broadcast at most.
MOST_BROADCAST = 100_000
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def rolling(h: np.ndarray, widths: tuple[int, ...]) -> list[np.ndarray]:
    """For each width, a hash of every run of so many words; equal runs have equal hashes wherever they are."""
    n = len(h)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * _powers(BASE, n), out=sums[1:])
    back = _powers(INVERSE, n)
    return [mix((sums[w:] - sums[: n + 1 - w]) * back[: n + 1 - w]) for w in widths]


def anchors(h: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows, for each window the place of its anchor, and the hashes of all k-grams.

    The anchor is the first of the k-grams whose hash has the smallest upper 40 bits (64 less the bits of a place in very long texts).
    """
    grams, windows = rolling(h, (k, length))
    bits = np.uint64(max(24, len(h).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    width, wide = 1, length - k + 1
    while 2 * width <= wide:  # least of runs of 2, 4, 8 ... and then of two runs that overlap
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(windows)], least[wide - width : wide - width + len(windows)])
    return windows, (least & low).astype(np.int64), grams


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64), pa.int64())


def _anchor_rows(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for big in batches for x in slices(big, "text", 4 << 20)):
            out, at, of = [], [], []
            for i, text in enumerate(as_bytes(batch.column("text"))):
                words = words_of(text)
                if len(words) >= length:
                    _, places, grams = anchors(hashes(words), length, k)
                    places = places[np.r_[True, places[1:] != places[:-1]]]
                    out.append(grams[places])
                    at.append(places)
                    of.append(np.full(len(places), i))
            if out:
                of = pa.array(np.concatenate(of))
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(out)), batch.column("k1").take(of), batch.column("k2").take(of), pa.array(np.concatenate(at).astype(np.int32))], names=["anchor", "k1", "k2", "at"])

    return run


def _block_rows(length: int, k: int):
    """A row for each repeated anchor of a document, or for each of its windows where the anchor is hot (a negative place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for big in batches for x in slices(big, "text", 4 << 20)):
            part, anchor, wins, first, of = [], [], [], [], []
            for i, (text, places) in enumerate(zip(as_bytes(batch.column("text")), batch.column("places"))):
                windows, at, grams = anchors(hashes(words_of(text)), length, k)
                places = places.values.to_numpy(zero_copy_only=False)
                wanted = np.sort(np.where(places < 0, ~places, places))
                is_hot = np.isin(wanted, ~places[places < 0])
                lo, hi = np.searchsorted(at, wanted), np.searchsorted(at, wanted, side="right")
                for a, x, y, hot in zip(wanted, lo, hi, is_hot):
                    for x, y in [(z, z + 1) for z in range(x, y)] if hot else [(x, y)]:
                        part.append(windows[x] if hot else grams[a])
                        anchor.append(grams[a])
                        wins.append(windows[x:y].view(np.int64))
                        first.append(x)
                        of.append(i)
            if part:
                of = pa.array(of)
                flat = pa.array(np.concatenate(wins), pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in wins])].astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([_signed(np.array(part, np.uint64)), _signed(np.array(anchor, np.uint64)), lists, batch.column("k1").take(of), batch.column("k2").take(of), pa.array(np.array(first, np.int32))], names=["part", "anchor", "wins", "k1", "k2", "first"])

    return run


def factors(starts: np.ndarray, refs: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """Greedy factors (first word, words, reference) of a document; refs has two references for each window in starts."""
    n = len(starts)
    if not n:
        return []
    last = np.empty((n, 2), np.int64)  # the last window that follows reference c of window j without a break
    for c in (0, 1):
        breaks = np.flatnonzero((np.diff(starts) != 1) | (np.diff(refs[:, c]) != 1))
        ends = np.r_[breaks, n - 1]
        last[:, c] = ends[np.searchsorted(ends, np.arange(n))]
    best = last.argmax(axis=1)
    out, i = [], 0
    while i < n:
        c = int(best[i])
        j = int(last[i, c])
        out.append((int(starts[i]), int(starts[j] - starts[i]) + length, int(refs[i, c])))
        i = j + 1
    return out


def _parse(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for big in batches for x in slices(big, "text", 4 << 20)):
            n_words, n_removed, kept, spans = [], [], [], []
            for text, k1, k2, found in zip(as_bytes(batch.column("text")), batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("found")):
                words = words_of(text)
                gone = np.zeros(len(words) + 1, np.int64)
                parts: list[tuple[int, int, int]] = []
                if found.is_valid:
                    rows = found.values
                    first = rows.field("first").to_numpy().astype(np.int64)
                    hits = rows.field("hits")
                    first = np.repeat(first, np.diff(hits.offsets.to_numpy()))
                    hits = hits.flatten()
                    mask = hits.field("mask").to_numpy().view(np.uint64)
                    row, i = np.nonzero((mask[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1))
                    start, order = np.unique(first[row] + i, return_index=True)
                    row, i = row[order], i[order]
                    both = np.stack([hits.field("lo").to_numpy()[row] + i, hits.field("hi").to_numpy()[row] + i], axis=1)
                    own = (_own(k1, k2) + start)[:, None]
                    both = np.where(both == own, both[:, ::-1], both)  # the other place where the window starts
                    parts = factors(start, both, length)
                    for a, m, _ in parts:
                        gone[a] += 1
                        gone[a + m] -= 1
                hold = np.cumsum(gone[:-1]) == 0
                n_words.append(len(words))
                n_removed.append(int(len(words) - hold.sum()))
                kept.append(b" ".join([w for w, h in zip(words, hold.tolist()) if h] if parts else words))
                spans.append([{"start": a, "n_words": m, "reference": r} for a, m, r in parts])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("n_words", pa.int32()), ("reference", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, kind)], names=["id", "n_words", "n_removed", "kept", "factors"])

    return run


def _own(k1: int, k2: int) -> int:
    """Where a row's words begin among all references: a hash of the row in the upper bits, the word's place below."""
    return ((k1 ^ k2) & ((1 << 39) - 1)) << 24


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = K, hot: int = HOT) -> DataFrame:
    """(id, n_words, n_removed, kept, factors) for every row of docs.

    Words are runs without ASCII white space, unchanged. A word goes if a window of `length` consecutive words that
    covers it also starts anywhere else, in the same document or another; windows are those of the input. kept has
    the remaining words, joined by one space. Null texts have no words, texts under `length` words lose none.
    Rows are told apart by id and text; of a row that is there twice both lose all their windows, since each window
    starts in both. A null id is a value like others.
    """
    if not 0 < length - k < 64:
        raise ValueError("an anchor has at most 64 windows")
    small_batches(docs.sparkSession)
    rows = need(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(id_col, F.lit(7)).alias("k1"), F.xxhash64(text_col, F.lit(11)).alias("k2"))
    found = need(rows, "k1", "k2", "text").mapInArrow(_anchor_rows(length, k), "anchor long, k1 long, k2 long, at int")
    store = Store(docs.sparkSession)
    again, _ = store.put(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"))
    # Rows of hot anchors are known by these alone, if they are few enough to be broadcast, and are dealt out by place; the others meet their counts by anchor.
    often = again.where(F.col("n") > hot).select("anchor", F.lit(True).alias("often"))
    marked = found.join(F.broadcast(often), "anchor", "left") if often.count() <= MOST_BROADCAST else found.withColumn("often", F.lit(None).cast("boolean"))
    marked = marked.withColumn("key", F.when(F.col("often"), F.xxhash64("k1", "k2", "at")).otherwise(F.col("anchor"))).drop("anchor")
    met = marked.join(again.withColumnRenamed("anchor", "key"), "key", "left").where("often or n is not null")
    places = met.groupBy("k1", "k2").agg(F.collect_set(F.when(F.col("often") | (F.col("n") > hot), -1 - F.col("at")).otherwise(F.col("at"))).alias("places"))
    # Both joins take the same columns of rows, so that its texts are shuffled once.
    places, _ = store.put(places)
    keyed = rows.join(places, ["k1", "k2"]).select("id", "k1", "k2", "text", "places")
    blocks = keyed.mapInArrow(_block_rows(length, k), "part long, anchor long, wins array<long>, k1 long, k2 long, first int")
    blocks = blocks.withColumn("block", F.xxhash64("anchor", "wins"))
    ref = F.shiftleft(F.col("k1").bitwiseXOR(F.col("k2")).bitwiseAND(F.lit((1 << 39) - 1)), 24) + F.col("first")
    index = blocks.groupBy("part", "anchor", "block", "wins").agg(F.count("*").alias("n"), F.min(ref).alias("lo"), F.max(ref).alias("hi"))
    index = index.repartition("part").select("part", "anchor", "block", "n", "lo", "hi", F.posexplode("wins").alias("i", "win"))
    index = index.selectExpr(
        "part", "block", "i",
        "sum(n) over (partition by part, anchor, win) n",
        "min(lo + i) over (partition by part, anchor, win) - i lo",
        "max(hi + i) over (partition by part, anchor, win) - i hi",
    )
    # A block's windows with the same two references are one row: a bit for each window.
    hits = index.where("n > 1").groupBy("part", "block", "lo", "hi").agg(F.expr("bit_or(shiftleft(1L, i))").alias("mask"))
    hits = hits.groupBy("part", "block").agg(F.collect_list(F.struct("lo", "hi", "mask")).alias("hits"))
    per_row = need(blocks, "part", "block", "k1", "k2", "first").join(hits, ["part", "block"]).groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "hits")).alias("found"))
    out = rows.join(per_row, ["k1", "k2"], "left").select("id", "text", "k1", "k2", "found")
    id_type = docs.schema[id_col].dataType.simpleString()
    return out.mapInArrow(_parse(length), f"id {id_type}, n_words long, n_removed long, kept string, factors array<struct<start:int,n_words:int,reference:long>>").withColumnRenamed("id", id_col)
