"""Near duplicates by SimHash fingerprints and Golay-code keys.

A fingerprint of 64 bits is cut into four segments of 16 bits. Fingerprints that differ in at
most 3 bits agree in one segment at least; the other 48 bits, as two halves of 24, then hold a
half with at most one differing bit. So a key is one exact segment together with the index of a
codeword of the perfect Golay code (23, 12) near the first 23 bits of a half. The word x decodes
to a codeword within distance 3; every word at distance 1 from x is within 4 of that codeword.
Each fingerprint is therefore stored under its own codeword (8 keys) and looked up under all
codewords within distance 4 of it (1 or 6 a half), and no pair within 3 bits is lost.

Work is on distinct fingerprints. Keys met by few fingerprints are joined and verified row by
row; keys met by many are cut into blocks, and each pair of blocks gives only a spanning forest of
its links, so that a large group of near copies makes neither all its pairs nor one large task.
Components come from alternating large-star and small-star rounds on the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import components
from ..operators.store import Store
from .common import as_bytes, cut, hashes, mix, need, slices, small_batches, words_of

SEED = 42
#: Keys with more fingerprints than FEW are handled in blocks of about BLOCK fingerprints.
FEW, BLOCK = 256, 1024
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, the generator of the perfect binary Golay code.
GENERATOR = 0b101011100011


def fingerprint(words: list[bytes], width: int = 3) -> int:
    """Bit b is 1 if it is set in over half of the XXH64 values of the shingles, repeats included."""
    if not words:
        return 0
    rows = [b" ".join(x) for x in zip(*(words[i:] for i in range(width)))] if len(words) > width else [b" ".join(words)]
    h = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in rows), np.dtype("<u8"), len(rows))
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 8192):
        ones += np.unpackbits(h[a : a + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp long) for every row. Null and empty texts, and those of white space only, have fingerprint 0."""
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, fp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for big in batches for x in slices(big.rename_columns(["id", "text"]), "text", 4 << 20)):
            fp = [fingerprint(words_of(x and x.lower()), width) for x in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fp, np.uint64).view(np.int64), pa.int64())], names=[id_col, "fp"])

    return need(docs, id_col, text_col).mapInArrow(run, schema)


def _remainder(x: np.ndarray) -> np.ndarray:
    for shift in range(22, 10, -1):
        x = np.where((x >> shift) & 1, x ^ (GENERATOR << (shift - 11)), x)
    return x


@cache
def _leaders() -> tuple[np.ndarray, np.ndarray]:
    """For each of the 2,048 syndromes: the error of weight 3 or less, and the (up to 6) errors of weight 4 or less, -1 where there is none."""
    bits = 1 << np.arange(23, dtype=np.int64)
    weight = [np.zeros(1, np.int64)]
    for _ in range(4):
        weight.append(np.unique((weight[-1][:, None] | bits).ravel()))
    count = lambda x: np.bitwise_count(x).astype(int)
    small = np.unique(np.concatenate(weight[:4]))
    own = np.zeros(2048, np.int64)
    own[_remainder(small)] = small
    near = np.full((2048, 6), -1, np.int64)
    near[:, 0] = own
    four = weight[4][count(weight[4]) == 4]
    syndrome = _remainder(four)
    order = np.argsort(syndrome, kind="stable")
    syndrome, four = syndrome[order], four[order]
    place = np.arange(len(four)) - np.searchsorted(syndrome, syndrome)
    near[syndrome, 1 + place] = four
    return own, near


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (index of the fingerprint, key, whether stored): 8 stored keys a fingerprint, and those to look up."""
    own, near = _leaders()
    fp = fp.astype(np.uint64)
    segments = [((fp >> np.uint64(16 * i)) & np.uint64(0xFFFF)).astype(np.int64) for i in range(4)]
    at, key, stored = [], [], []
    for i in range(4):
        rest = [segments[j] for j in range(4) if j != i]
        whole = rest[0] | rest[1] << 16 | rest[2] << 32
        for half in (0, 1):
            word = whole >> (24 * half) & 0x7FFFFF
            syndrome = _remainder(word)
            table = (i * 2 + half) << 28 | segments[i] << 12
            at.append(np.arange(len(fp)))
            key.append(table | (word ^ own[syndrome]) >> 11)
            stored.append(np.ones(len(fp), bool))
            errors = near[syndrome]
            r, c = np.nonzero(errors >= 0)
            at.append(r)
            key.append(table[r] | (word[r] ^ errors[r, c]) >> 11)
            stored.append(np.zeros(len(r), bool))
    return np.concatenate(at), np.concatenate(key), np.concatenate(stored)


def _keys(fps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column(0)).astype(np.int64)
            at, key, stored = keys_of(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[at]), pa.array(stored)], names=["key", "fp", "stored"])

    return fps.mapInArrow(run, "key long, fp long, stored boolean")


def _apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _spanning(x: np.ndarray, y: np.ndarray, linked: np.ndarray) -> pa.Table:
    """A spanning forest of the links between x and y where `linked` is true."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while (p := parent.setdefault(v, v)) != v:
            parent[v] = v = parent[p]
        return v

    out = []
    for i, j in zip(*np.nonzero(linked)):
        a, b = root(int(x[i])), root(int(y[j]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((int(x[i]), int(y[j])))
    return pa.table([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])


def _differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of each pair; unsigned, as bitwise_count takes absolute values."""
    return np.bitwise_count(x.view(np.uint64)[:, None] ^ y.view(np.uint64)[None, :])


def _forest(rows: pa.Table, most: int) -> pa.Table:
    """Links of a spanning forest between the stored and the looked-up fingerprints of one pair of blocks."""
    fp, stored = rows.column("fp").to_numpy(), rows.column("stored").to_numpy()
    x, y = np.unique(fp[stored]), np.unique(fp[~stored])
    return _spanning(x, y, _differing(x, y) <= most)


def _met(fps: DataFrame, most: int) -> DataFrame:
    """(key, fp, stored, n): the keys under which fingerprints meet, with how many rows each has."""
    if not 0 <= most <= 3:
        raise ValueError("the keys find differences of 3 bits at most")
    # Fingerprints take little room and give many keys, so that they are dealt to all tasks first.
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = _keys(fps.repartition(tasks, "fp"))
    # Most keys have one fingerprint only, and so no partner. Counting before the join keeps a frequent key out of any single task.
    met = keys.groupBy("key").agg(F.count("*").alias("n"), F.count_if("stored").alias("n_stored")).where("n_stored > 0 and n_stored < n and (n > 2 or n_stored = 1)")
    # Spark takes the keys, some 35 a fingerprint, for one row each, and would broadcast them while fingerprints are few enough: both sides are shuffled.
    return cut(keys.join(met.hint("merge"), "key").select("key", "fp", "stored", "n"))


def _close(few: DataFrame, most: int) -> DataFrame:
    """(a, b): the pairs of a stored and a looked-up fingerprint of one key within `most` bits."""
    x = few.where("stored").select("key", F.col("fp").alias("a"))
    y = few.where("not stored").select("key", F.col("fp").alias("b"))
    return x.join(y, (x["key"] == y["key"]) & (F.col("a") != F.col("b")) & (_apart(F.col("a"), F.col("b")) <= most)).select("a", "b")


def _spread(many: DataFrame, column: str) -> DataFrame:
    """Rows of hot keys with the pair of blocks (i, j) that they go to: a stored row meets each looked-up block and the other way round."""
    blocks = F.ceil(F.col("n") / BLOCK)
    rows = many.withColumns({"own": F.pmod(F.xxhash64(column), blocks), "other": F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))})
    return rows.withColumns({"i": F.when(F.col("stored"), F.col("own")).otherwise(F.col("other")), "j": F.when(F.col("stored"), F.col("other")).otherwise(F.col("own"))}).drop("own", "other", "n")


def links(fps: DataFrame, most: int = 3) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that differ in 1 to `most` (3 or fewer) bits.

    Where over FEW fingerprints share a key, a spanning forest of their links stands for all of them; every
    other link is in the result.
    """
    rows = _met(fps, most)
    hot = _spread(rows.where(F.col("n") > FEW), "fp").groupBy("key", "i", "j").applyInArrow(lambda rows: _forest(rows, most), "a long, b long")
    both = _close(rows.where(F.col("n") <= FEW), most).unionByName(hot.where("a <> b"))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, most: int = 3) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id that is reachable over fingerprints at most `most` bits apart, the row's own
    included. Null, empty and blank texts have fingerprint zero, which links like any other. Rows with a null id
    count as texts; component_id is null only where no row of the component has an id. Repeated rows each stay.
    """
    prints = cut(fingerprints(docs, id_col, text_col, width))
    fps = prints.groupBy("fp").agg(F.min(id_col).alias("least"))
    roots = components(links(fps.select("fp"), most))
    named = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = cut(named)
    groups = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(groups, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: One text in SAMPLE is counted to learn which shingles are frequent; at most FREQUENT of them are kept.
SAMPLE, FREQUENT = 32, 500_000
#: Shingle hashes of a sketch (their upper 32 bits), and how many of the least 2 * SKETCH of two texts' together may differ: texts of similarity 0.8 have fewer
#: than half in common with a chance below 1e-8.
SKETCH = 64
#: Differing fingerprint bits beyond which a pair isn't looked at: at similarity 0.8 they are 9.7 on average, with a deviation of 2.9.
WIDE = 27
#: Texts that share a shingle and aren't all linked are a crowd if their pairs are over CROWD^2; TRIES members of its main group are tried by each of the others, of SOME beside it under a shingle and
#: twice as many in each further turn, of which there are TURNS at most.
CROWD, TRIES, SOME, TURNS = 64, 8, 8, 8
#: Bits of the map of the texts whose whole sets are asked for; its size doesn't grow with the documents.
MAP_BITS = 1 << 23


def _shingle_rows(words: np.ndarray, width: int) -> np.ndarray:
    """The hashes of the shingles of `width` words in order; a shorter text is one shingle."""
    n = max(1, len(words) - width + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(width, len(words))):
        out = mix(out + words[i : i + n])
    return out


def _sign_bits(h: np.ndarray) -> int:
    """The SimHash fingerprint of 64-bit hashes: bit b is 1 if over half of them have it."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 8192):
        ones += np.unpackbits(h[a : a + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def _sampled(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for big in batches for x in slices(big, "text", 4 << 20)):
            sets = [np.unique(_shingle_rows(hashes(words_of(text.lower())), width)) for text in as_bytes(batch.column(0))]
            h, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    return run


def _sketched(width: int, similarity: float, frequent):
    """Of each text: its number of distinct shingles, its fingerprint, the first shingles from rare to frequent (`rare` of them not known as frequent), and the least hashes.

    Two sets of that similarity share one of the first n - ceil(similarity * n) + 1 in any order that all rows have in common.
    A text that the task has met already is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, rank = frequent.value
        seen: set[int] = set()
        for batch in (x for big in batches for x in slices(big, "text", 4 << 20)):
            node, size, bits, rare, first, least = [], [], [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                if key in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(key)
                h = np.unique(_shingle_rows(hashes(words_of(text.lower())), width))
                node.append(key)
                size.append(len(h))
                bits.append(_sign_bits(h))
                least.append((h[:SKETCH] >> np.uint64(32)).astype(np.uint32).view(np.int32))
                known = 0
                keep = len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1
                if len(often):
                    at = np.minimum(np.searchsorted(often, h), len(often) - 1)
                    count = np.where(often[at] == h, rank[at], 0)
                    known = max(0, keep - int(np.count_nonzero(count == 0)))
                    h = h[np.argsort(count, kind="stable")]
                first.append(h[:keep].view(np.int64))
                rare.append(keep - known)
            long = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(node, pa.int64()), pa.array(size, pa.int32()), pa.array(bits, pa.int64()), pa.array(rare, pa.int32()), pa.array(first, long), pa.array(least, pa.list_(pa.int32()))],
                names=["node", "n", "fp", "rare", "first", "least"],
            )

    return run


def _wanted(nodes: DataFrame) -> np.ndarray:
    """A map of MAP_BITS bits with those of the nodes (column node) set; a few others fall on the same bits."""
    at = F.pmod("node", F.lit(MAP_BITS))
    words = nodes.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(node, {MAP_BITS}) & 63 as int))")).alias("bits"))
    found = words.toArrow()
    out = np.zeros(MAP_BITS >> 6, np.int64)
    out[np.asarray(found["w"]).astype(np.int64)] = np.asarray(found["bits"])
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool)


def _sets(width: int, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, seen = wanted.value, set()
        for batch in (x for big in batches for x in slices(big.filter(pa.array(there[big.column(0).to_numpy() % MAP_BITS])), "text", 4 << 20)):
            node, sets = [], []
            for key, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                if key in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(key)
                node.append(key)
                sets.append(np.unique(_shingle_rows(hashes(words_of(text.lower())), width)).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])

    return run


def _shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The sorted values that both sorted arrays of distinct values have."""
    both = np.sort(np.concatenate((x, y)), kind="stable")
    return both[1:][both[1:] == both[:-1]]


def _similar_sketches(similarity: float):
    """(a, b, whole, share) of the pairs whose sketches allow the similarity; where the sketches are whole sets they decide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, share, whole = [], [], []
            for x, y, n, m in zip(batch.column("xleast"), batch.column("yleast"), batch.column("xn").to_pylist(), batch.column("yn").to_pylist()):
                x, y = x.values.to_numpy().view(np.uint32), y.values.to_numpy().view(np.uint32)
                both = _shared(x, y)
                if full := n <= SKETCH and m <= SKETCH:
                    part = len(both) / (n + m - len(both))
                    good = len(both) * (1 + similarity) >= similarity * (n + m) - 1e-9
                else:  # of the least hashes of the two together, those that both have
                    union = np.unique(np.concatenate((x, y)))[:SKETCH]
                    part = np.count_nonzero(both <= union[-1]) / len(union)
                    good = part >= similarity - 0.3 and similarity * max(n, m) <= min(n, m) + 1e-9
                keep.append(good)
                share.append(part)
                whole.append(full)
            out = batch.select(["a", "b"]).append_column("whole", pa.array(whole, pa.bool_())).append_column("share", pa.array(share, pa.float64()))
            yield out.filter(pa.array(keep, pa.bool_()))

    return run


def _similar(x: Column, y: Column, similarity: float) -> Column:
    """Whether two sets of hashes (arrays without repeats) have at least that Jaccard similarity."""
    return F.size(F.array_intersect(x, y)) * (1 + similarity) >= similarity * (F.size(x) + F.size(y)) - 1e-9


def _possible(similarity: float, x: Column | None = None, y: Column | None = None) -> Column:
    """Whether sets of n and m shingles that first meet at their places p and q can have the similarity: exact, as each similar pair passes where it first meets.

    Of longer texts those with fingerprints further apart than WIDE bits are left out as well. x and y have n, p and fp; by default they are columns.
    """
    x, y = F.col("x") if x is None else x, F.col("y") if y is None else y
    n, m = x["n"], y["n"]
    return (F.lit(1 + similarity) * F.least(n - x["p"], m - y["p"]) >= F.lit(similarity) * (n + m) - 1e-9) & ((n < 32) | (_apart(x["fp"], y["fp"]) <= WIDE))


def _named(text_col: str) -> Column:
    """A text's node: equal texts are one node."""
    return F.xxhash64(F.col(text_col), F.lit(11))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, node, text) of the rows that can be compared."""
    rows = need(docs, id_col, text_col).where(F.col(id_col).isNotNull() & F.col(text_col).rlike("[^\\x20\\x09-\\x0D]"))
    return rows.select(F.col(id_col).alias("id"), _named(text_col).alias("node"), F.col(text_col).alias("text"))


def near_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(node, root) of every node (see _named) of docs that is linked to another: groups of near copies.

    Candidates come in two ways. SimHash fingerprints of the shingles are joined by their Golay keys (see links), which finds the copies that differ
    in little. That isn't enough at 0.8, where fingerprints differ by some ten bits, so that texts also meet under their
    rarest shingles: those of the similarity share one of the first of each (see _sketched; which shingles are frequent is estimated on a
    sample, but decides the order only). Candidates within WIDE bits and with like sketches are verified by their whole sets. First a text is
    compared with that of its neighbours under all keys whose fingerprint is nearest, then texts of large groups with a few of the group that they aren't
    linked to yet, and at last all pairs are that these links haven't joined, so that a large group of near copies doesn't make all its pairs.
    """
    spark = docs.sparkSession
    small_batches(spark)
    full = _rows(docs, id_col, text_col).select("node", "text")
    counted = full.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(_sampled(width), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = counted.where("n > 1").orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    often, rank = np.asarray(top["h"]).astype(np.int64).view(np.uint64), np.asarray(top["n"]).astype(np.int64)
    order = np.argsort(often)
    frequent = spark.sparkContext.broadcast((often[order], rank[order]))
    store = Store(spark)
    sketches, sketches_path = store.put(full.mapInArrow(_sketched(width, similarity, frequent), "node long, n int, fp long, rare int, first array<long>, least array<int>"))
    info = sketches.groupBy("node").agg(F.any_value("n").alias("n"), F.any_value("fp").alias("fp"))
    keys = sketches.select("node", "rare", F.posexplode("first").alias("p", "h"))
    # Shingles that are known as frequent are shared; of the others, of which none has many texts, those of one text only go.
    here = Window.partitionBy("h")
    shared = keys.where("p < rare").select("h", "node", "p").withColumns({"a": F.min("node").over(here), "b": F.max("node").over(here)}).where("a < b").select("h", "node", "p")
    met, met_path, _ = store.few(shared.unionByName(keys.where("p >= rare").select("h", "node", "p")).join(info, "node"))
    crowded = met.groupBy("h").agg(F.count("*").alias("same")).where(F.col("same") > BLOCK)
    met = met.join(crowded, "h", "left").withColumn("blocks", F.ceil(F.coalesce("same", F.lit(1)) / BLOCK)).drop("same")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a < b) that are similar."""
        least = sketches.groupBy("node").agg(F.any_value("least").alias("least"), F.any_value("n").alias("n"))
        likely = pairs.join(least.toDF("a", "xleast", "xn"), "a").join(least.toDF("b", "yleast", "yn"), "b").mapInArrow(_similar_sketches(similarity), "a long, b long, whole boolean, share double")
        likely, likely_path, _ = store.few(likely)
        rest = likely.where("not whole").select("a", "b")
        asked = rest.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = spark.sparkContext.broadcast(_wanted(asked))
        sets = full.mapInArrow(_sets(width, wanted), "node long, set array<long>").join(asked, "node", "left_semi").groupBy("node").agg(F.any_value("set").alias("set"))
        both = rest.join(sets.toDF("a", "xset"), "a").join(sets.toDF("b", "yset"), "b")
        found, _, _ = store.few(likely.where("whole").select("a", "b").unionByName(both.where(_similar(F.col("xset"), F.col("yset"), similarity)).select("a", "b")))
        store.discard(likely_path)
        return found

    # Fingerprints that the Golay keys link, by a text of each; and the texts of one fingerprint with the first of them.
    hubs = info.groupBy("fp").agg(F.min("node").alias("hub"))
    near = links(hubs.select("fp"), 3)
    pair = lambda x, y, d: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), d.alias("d"))
    golay = near.join(hubs.toDF("a", "x"), "a").join(hubs.toDF("b", "y"), "b").select(*pair("x", "y", _apart(F.col("a"), F.col("b"))), F.lit(False).alias("hub"))
    golay = golay.unionByName(info.join(hubs, "fp").where("node <> hub").select(*pair("hub", "node", F.lit(0)), F.lit(False).alias("hub")))
    # Under a shingle a text meets the one before it, and the first of all.
    line = Window.partitionBy("h", F.pmod(F.xxhash64("node"), "blocks")).orderBy("n", "node")
    mine = F.struct("node", "n", "fp", "p")
    before = met.select(mine.alias("y"), F.lag(mine).over(line).alias("last"), F.first(mine).over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("first")).where("first is not null")
    before = before.select("y", F.explode(F.array(F.struct(F.col("last").alias("x"), F.lit(False).alias("hub")), F.struct(F.col("first").alias("x"), F.lit(True).alias("hub")))).alias("z")).select("y", "z.x", "z.hub")
    before = before.where(_possible(similarity) & (F.col("x.node") != F.col("y.node"))).select(*pair("x.node", "y.node", _apart(F.col("x.fp"), F.col("y.fp"))), "hub")
    # Of all that a text meets here, only those with the nearest fingerprint are looked at, one of each kind, so that the pairs are at most twice as many as the texts.
    nearest = golay.unionByName(before).groupBy("b", "hub").agg(F.min(F.struct("d", "a")).alias("x")).select("x.a", "b").distinct()
    nearest, nearest_path, _ = store.few(nearest)
    found = verified(nearest)
    store.discard(nearest_path)
    n_texts, rest_path, stalled = info.count(), "", False
    for turn in range(TURNS + 1):
        # Of the texts of one shingle that aren't all linked, the largest linked group is its main one.
        rest = met.join(components(found), "node", "left").select("h", "node", "n", "fp", "p", "blocks", F.coalesce("root", "node").alias("root"))
        groups = rest.groupBy("h", "root").agg(F.count("*").alias("k")).groupBy("h").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.sum("k").alias("all"), (F.sum("k") - F.max("k")).alias("others")).where("others > 0")
        rest, new, _ = store.few(rest.join(groups, "h"))
        if rest_path:
            store.discard(rest_path)
        rest_path = new
        crowds = rest.where(F.col("all") * F.col("others") > CROWD**2)
        load = crowds.agg(F.coalesce(F.sum(F.when(F.col("root") != F.col("main"), F.col("all"))), F.lit(0)).alias("n")).first().n
        if stalled or turn == TURNS or load <= n_texts:
            break
        # Before all pairs of a crowd are taken, each text outside its main group tries a few members of that: those with the nearest fingerprints of some, of more in each turn.
        line = Window.partitionBy("h", F.pmod(F.xxhash64("node"), "blocks")).orderBy(F.xxhash64("node", "h", F.lit(turn)), "node")
        member = F.collect_list(F.when(F.col("root") == F.col("main"), mine)).over(line.rowsBetween(-SOME << turn, SOME << turn))
        near_by = F.transform(F.filter("them", lambda x: _possible(similarity, x, F.col("me"))), lambda x: F.struct(_apart(x["fp"], F.col("me.fp")).alias("d"), x["node"].alias("x")))
        tries = crowds.select("root", "main", mine.alias("me"), member.alias("them")).where("root <> main").select(F.col("me.node").alias("y"), F.explode(F.slice(F.array_sort(near_by), 1, TRIES // 2)).alias("z")).select("y", "z.x", "z.d").distinct()
        tries = tries.withColumn("place", F.row_number().over(Window.partitionBy("y").orderBy("d", "x"))).where(F.col("place") <= TRIES)
        tries, tries_path, _ = store.few(tries.select("x", "y"))
        linked = verified(tries.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        found = found.unionByName(linked)
        stalled = linked.count() * TRIES < tries.select("y").distinct().count()  # the texts that are left have few links, if any
        store.discard(tries_path)
    store.discard(met_path)
    # Now all pairs of one shingle that lie apart: those outside its largest group with all others.
    rest = rest.withColumns({"own": F.pmod(F.xxhash64("node"), "blocks"), "other": F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))})
    x = rest.where("root <> main").select("h", "node", "n", "fp", "p", "root", "main", F.col("own").alias("i"), F.col("other").alias("j")).alias("x")
    # Spark doesn't see that a row has become one for each block, so this isn't left to its sizes either.
    y = rest.select("h", "node", "n", "fp", "p", "root", "main", F.col("other").alias("i"), F.col("own").alias("j")).alias("y").hint("merge")
    on = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in "hij"]
    # A pair of two texts outside the largest group meets in either order; once is enough.
    once = (F.col("y.root") == F.col("y.main")) | (F.col("x.node") < F.col("y.node"))
    pairs = x.join(y, on[0] & on[1] & on[2] & (F.col("x.root") != F.col("y.root")) & once & _possible(similarity, *[F.struct(*[F.col(f"{t}.{c}").alias(c) for c in ("n", "p", "fp")]) for t in "xy"]))
    pairs, pairs_path, _ = store.few(pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct())
    store.discard(rest_path)
    more = verified(pairs)
    store.discard(pairs_path)
    store.discard(sketches_path)
    roots, _, _ = store.few(components(found.unionByName(more)))
    return roots


def _grouped(docs: DataFrame, id_col: str, text_col: str, width: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(id, node) of each row, and (node, first) of each node: the row of its group with the smallest id, as (id, node)."""
    rows = _rows(docs, id_col, text_col).select("id", "node")
    roots = near_links(docs, id_col, text_col, width, similarity)
    least = rows.groupBy("node").agg(F.min("id").alias("id")).join(roots, "node", "left").select("id", "node", F.coalesce("root", "node").alias("root"))
    least = cut(least)
    groups = least.groupBy("root").agg(F.min(F.struct("id", "node")).alias("first"))
    return rows, least.join(groups, "root").select("node", "first")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, component_id) of every row with an id and a text that isn't blank: groups of near copies.

    Two texts are linked if their sets of distinct shingles of `width` words, in lower case, have a Jaccard similarity of at least `similarity`; component_id
    is the smallest id of a row that is reachable. A text under `width` words is one shingle. Rows with one id and different texts are compared each by its own text; repeated rows each stay.
    """
    rows, named = _grouped(docs, id_col, text_col, width, similarity)
    return rows.join(named, "node").select(F.col("id").alias(id_col), F.col("first.id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs without near copies: of each group the row with the smallest id (of rows with that id, one text), and of repeated rows one.

    Rows are told apart by id and text: one that shares its id with a copy, but not its text, stays. Rows with a null id or a null or blank
    text have nothing to compare and stay, repeated ones too; an empty table stays empty. All columns stay, whatever their names.
    """
    compared = F.col(id_col).isNotNull() & F.coalesce(F.col(text_col).rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    _, named = _grouped(docs, id_col, text_col, width, similarity)
    keep = named.where(F.col("first.node") == F.col("node")).select("first.id", F.col("first.node").alias("node"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.where(compared).select(F.col(id_col).alias("id"), _named(text_col).alias("node"), row)
    kept = rows.join(keep, ["id", "node"], "left_semi").dropDuplicates(["id", "node"])
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]).unionByName(docs.where(~compared))
