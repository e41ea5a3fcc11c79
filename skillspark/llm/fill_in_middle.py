"""Fill-in-middle documents, cut at units by an indexable skip list.

A document's units (lines) stand in the lowest lane with their widths: a unit, so many code points, so many bytes. Each lane above has
a node for every STRIDE nodes of the one below, whose link carries the widths of all that it skips. The place of a cut is found from the top lane down: links
are followed while the units behind them don't exceed the rank, and what they carry is added up, so that a rank is reached after at most STRIDE
steps a lane, with its place in code points and in bytes. Texts stay UTF-8 bytes throughout.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, need, slices, small_batches

STRIDE = 16
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"


def line_widths(text: bytes) -> np.ndarray:
    """(units, 3): a unit, its code points and its bytes, for each line with its line feed; a last line may be without one."""
    if not text:
        return np.zeros((0, 3), np.int64)
    raw = np.frombuffer(text, np.uint8)
    ends = np.flatnonzero(raw == 10) + 1
    if not len(ends) or ends[-1] != len(raw):
        ends = np.append(ends, len(raw))
    starts = np.r_[0, ends[:-1]]
    points = np.add.reduceat((raw & 0xC0) != 0x80, starts, dtype=np.int64)
    return np.stack((np.ones(len(ends), np.int64), points, ends - starts), axis=1)


@dataclass
class SkipList:
    """lanes[0] has the widths of the units, lanes[i] those of the links over STRIDE nodes each of lanes[i - 1]."""

    lanes: list[np.ndarray]

    @classmethod
    def of(cls, widths: np.ndarray) -> SkipList:
        lanes = [widths]
        while len(lanes[-1]) > STRIDE:
            lanes.append(np.add.reduceat(lanes[-1], np.arange(0, len(lanes[-1]), STRIDE), axis=0))
        return cls(lanes)

    def place(self, rank: int) -> tuple[int, int]:
        """(code points, bytes) before the unit of that rank; those of the whole text at or beyond its end."""
        units = points = size = node = 0
        for i in range(len(self.lanes) - 1, -1, -1):
            lane = self.lanes[i]
            while node < len(lane) and units + lane[node, 0] <= rank:
                units, points, size, node = units + int(lane[node, 0]), points + int(lane[node, 1]), size + int(lane[node, 2]), node + 1
            node *= STRIDE
        return points, size


def draws(seed: int, key: str) -> tuple[int, int, int, int]:
    """The first four groups of 8 digits of the hex sha256 of "seed:key"."""
    digits = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return tuple(int(digits[8 * i : 8 * i + 8], 16) for i in range(4))


def transformed(text: bytes, key: str, seed: int, rate: int, spm: int) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of the prefix and of the middle, output)."""
    widths = line_widths(text)
    n = len(widths)
    h1, h2, h3, h4 = draws(seed, key)
    if not text or h3 % 100 >= rate or any(x in text for x in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    lanes = SkipList.of(widths)
    (p, a), (m, b) = (lanes.place(f(h1 % (n + 1), h2 % (n + 1))) for f in (min, max))
    before, middle, after = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", p, m - p, b"".join((SUFFIX, after, PREFIX, before, MIDDLE, middle))
    return n, "psm", p, m - p, b"".join((PREFIX, before, SUFFIX, after, MIDDLE, middle))


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output), a row for each row of docs.

    n: lines. Of the numbers h1 to h4 that sha256 of "seed:id" gives, h1 % (n + 1) and h2 % (n + 1) are the ranks of the cuts, h3 % 100 below
    `rate` asks for a cut at all, and h4 % 100 below `spm` for suffix, prefix, middle instead of prefix, suffix, middle. A text that is null (as an empty one), empty or holds one of the
    three marks stays plain, with null prefix_chars and middle_chars. Prefix, middle or suffix may be empty. A null id counts as an empty one;
    repeated rows give equal rows; very long texts go whole, a few MB of texts at a time; an empty table stays empty; further columns aren't read.
    """
    small_batches(docs.sparkSession)
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for big in batches for x in slices(big, "text", 4 << 20)):
            keys = ("" if x is None else str(x) for x in batch.column("id").to_pylist())
            rows = [transformed(text or b"", key, seed, rate, spm) for key, text in zip(keys, as_bytes(batch.column("text")))]
            n, form, prefix, middle, output = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())],
                names=[id_col, "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return need(docs, id_col, text_col).toDF("id", "text").mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output in that form was made of: its parts in order, without the marks."""
    parts = F.split(output, "<[PSM]>")
    part = lambda *at: F.concat(*[F.get(parts, F.lit(i)) for i in at])
    return F.when(form == "psm", part(1, 3, 2)).when(form == "spm", part(2, 3, 1)).otherwise(output)
