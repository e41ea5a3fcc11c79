"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1 that follows from its code point and a seed. An n-gram's vector binds
(multiplies) those of its letters, each permuted (rotated) by its place from the end; a text's vector bundles
(sums) those of all its n-grams, and a language's prototype those of its documents. A text gets the language
whose prototype has the highest cosine with its vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, need, slices, small_batches

DIM, N, SEED = 512, 3, 20
#: Bound of the documents of each language that prototypes are learned from.
MOST_DOCS = 10_000
_LETTERS = np.array([chr(i).isalpha() for i in range(0x110000)])


class Vectors:
    """Rotated letter vectors of the code points met so far, in this task."""

    def __init__(self, dim: int = DIM, n: int = N, seed: int = SEED) -> None:
        self.dim, self.n, self.seed = dim, n, seed
        self.place = np.full(0x110000, -1, np.int32)
        self.rows = np.zeros((n, 0, dim), np.int8)

    def letters(self, points: np.ndarray) -> np.ndarray:
        """Row numbers of code points."""
        new = points[self.place[points] < 0]
        if len(new):
            new = np.unique(new)
            if self.rows.shape[1] > 20_000:  # bounded; the vectors follow from code point and seed alone
                self.place[:], self.rows = -1, np.zeros((self.n, 0, self.dim), np.int8)
                new = np.unique(points)
            fresh = np.stack([np.random.default_rng((self.seed, int(c))).integers(0, 2, self.dim, np.int8) * 2 - 1 for c in new])
            self.place[new] = self.rows.shape[1] + np.arange(len(new))
            self.rows = np.concatenate([self.rows, np.stack([np.roll(fresh, self.n - 1 - i, axis=1) for i in range(self.n)])], axis=1)
        return self.place[points]

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.zeros(self.dim, np.float64)
        for a in range(0, len(codes), 1024):
            part = codes[a : a + 1024]
            points = [(part >> (21 * (self.n - 1 - i))) & 0x1FFFFF for i in range(self.n)]
            where = np.split(self.letters(np.concatenate(points)), self.n)
            grams = self.rows[0][where[0]]
            for i in range(1, self.n):
                grams = grams * self.rows[i][where[i]]
            total += counts[a : a + 1024].astype(np.float32) @ grams.astype(np.float32)
        return total


def ngrams(text: str, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the lower-cased letters, runs of other characters as one space, with their counts."""
    points = np.frombuffer(f" {text} ".lower().encode("utf-32-le"), np.uint32)
    letter = _LETTERS[points]
    points = np.where(letter, points, 32)
    points = points[letter | np.r_[True, letter[:-1]]].astype(np.int64)
    if not letter.any() or len(points) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = points[: len(points) - n + 1].copy()
    for i in range(1, n):
        codes = codes << 21 | points[i : len(points) - n + 1 + i]
    return np.unique(codes, return_counts=True)


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", most: int = MOST_DOCS, dim: int = DIM, n: int = N, seed: int = SEED) -> dict[str, np.ndarray]:
    """Prototypes from the rows of docs with a text and a language; about `most` documents of each language at most.

    The share of a language's documents that is used follows from the hashes of their ids and texts.
    """
    full = need(docs, id_col, text_col, lang_col).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = full.groupBy(lang_col).agg(F.count("*").alias("n"))
    # One row for each language, a number that doesn't grow with the documents.
    share = {r[0]: min(1.0, most / r[1]) for r in counts.collect()}
    if not share:
        return {}
    shares = F.try_element_at(F.create_map(*[F.lit(x) for pair in share.items() for x in pair]), F.col(lang_col))
    chosen = full.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 20)) < shares * (1 << 20)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, sums = Vectors(dim, n, seed), {}
        for batch in (x for big in batches for x in slices(big, "text", 4 << 20)):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[lang] = sums.get(lang, 0) + vectors.bundle(*ngrams(text, n))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    parts = chosen.mapInArrow(run, "lang string, v array<double>")
    total = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    total = total.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    return {r.lang: v for r in total.select("lang", "v.x").collect() if np.linalg.norm(v := np.array(r.x)) > 0}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", dim: int = DIM, n: int = N, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, further columns `keep`, lang_pred, score) for every row of docs.

    score is the cosine, at least 0. Ties go to the language first in order. Null texts, texts without a letter, and
    all texts where nothing was learned get `und` and 0.
    """
    small_batches(docs.sparkSession)
    langs = sorted(prototypes)
    matrix = np.stack([prototypes[x] / np.linalg.norm(prototypes[x]) for x in langs]) if langs else np.zeros((0, dim))

    def one(vectors: Vectors, text: str | None) -> tuple[str, float]:
        codes, counts = ngrams(text, n) if text else ((), ())
        if not len(codes) or not langs:
            return "und", 0.0
        v = vectors.bundle(codes, counts)
        cos = matrix @ v / max(np.linalg.norm(v), 1e-12)
        best = int(cos.argmax())
        return langs[best], float(min(1.0, max(0.0, cos[best])))

    # The text goes to Python once: alone, or where it is kept, within the row.
    inside = text_col in (id_col, *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors(dim, n, seed)
        for big in batches:
            texts = big.column(0).field(text_col) if inside else big.column(1)
            if not pa.types.is_string(texts.type):
                texts = texts.cast(pa.string())
            for batch in slices(pa.RecordBatch.from_arrays([big.column(0), texts], names=["row", "text"]), "text", 4 << 20):
                out = [one(vectors, x.as_py()) for x in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())], names=["row", "lang_pred", "score"])

    held = list(dict.fromkeys([id_col, *keep]))
    row = F.struct(*[F.col(f"`{c}`") for c in held]).alias("row")
    rows = docs.select(row) if inside else docs.select(row, F.col(f"`{text_col}`").alias("text"))
    out = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double")
    return out.select(*[F.col("row").getField(c).alias(c) for c in held], "lang_pred", "score")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is held out; a null id is not, and isn't learned from either."""
    return F.coalesce(crc_mod(F.col(id_col), 4) == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = (), **how) -> DataFrame:
    """predict() with prototypes from the documents that aren't held out."""
    return predict(docs, learn(docs.where(crc_mod(F.col(id_col), 4) != 2), text_col, lang_col, id_col, **how), id_col, text_col, keep=keep)
