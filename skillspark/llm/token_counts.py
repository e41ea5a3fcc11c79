"""Token counts under a unigram vocabulary, by dynamic programming over a trie of the distinct pre-tokens.

The best score of a string's first d characters depends on those characters alone, so pre-tokens that share a
prefix share its scores. A task takes the distinct pre-tokens of a run of documents that it hasn't met, goes
through their trie depth first (the sorted words, keeping the path) and stores a count at each terminal; the
documents then add up the counts of their pre-tokens.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, need, slices, words_of
from .pieces import Vocabulary, load

#: Pre-tokens whose counts a task keeps; beyond it, it starts afresh, which changes no count.
KEPT = 400_000
SPACE = "▁"


def terminal_counts(words: Iterable[str], vocabulary: Vocabulary) -> Iterator[tuple[str, int]]:
    """(word, tokens of its best segmentation) in sorted order; of equal scores the longest last piece counts, as SentencePiece does."""
    weights, suffixes, byte = vocabulary.weights, vocabulary.suffixes, bool(vocabulary.byte_ids)
    scores, counts, before = [0.0], [0], ""
    for word in sorted(words):
        d = 0
        for a, b in zip(word, before):
            if a != b:
                break
            d += 1
        del scores[d + 1 :], counts[d + 1 :]
        for end in range(d + 1, len(word) + 1):
            best, n, single, start = -np.inf, 0, False, end - 1
            while start >= 0 and (tail := word[start:end]) in suffixes:
                if (weight := weights.get(tail)) is not None:
                    single |= start == end - 1
                    if (score := scores[start] + weight) >= best:
                        best, n = score, counts[start] + 1
                start -= 1
            if not single and (score := scores[end - 1] + vocabulary.unknown_weight) > best:
                best, n = score, counts[end - 1] + (len(word[end - 1].encode()) if byte else 1)
            scores.append(best)
            counts.append(n)
        before = word
        yield word, counts[-1]


@cache
def _known(path: str | None) -> dict[bytes, int]:
    """Counts that this process keeps from task to task."""
    return {}


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", kept: int = KEPT) -> DataFrame:
    """(id, n_words, n_tokens) for every row of docs.

    Pre-tokens are the runs without ASCII white space, each with the vocabulary's space mark before it; the white
    space itself counts nothing. Null and blank texts have 0 of both. `path` is a SentencePiece model file; its scores
    are the unigram log weights, or negative ranks of merges that Zipf's law turns into such. Repeated rows each stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, known = load(path), _known(path)
        if vocabulary.charsmap or vocabulary.user_defined:
            raise ValueError("pre-tokens are counted as they are: a vocabulary with a map of characters or user-defined pieces asks for more")
        for big in batches:
            for batch in slices(big, "text"):
                rows = [words_of(x) for x in as_bytes(batch.column("text"))]
                if len(known) > kept:
                    known.clear()
                new = {w for words in rows for w in words}.difference(known)
                by_text = {SPACE + w.decode(): w for w in new}
                known.update((by_text[text], n) for text, n in terminal_counts(by_text, vocabulary))
                tokens = [sum(map(known.__getitem__, words)) for words in rows]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(x) for x in rows], pa.int64()), pa.array(tokens, pa.int64())], names=["id", "n_words", "n_tokens"])

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = need(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, n_words long, n_tokens long").withColumnRenamed("id", id_col)
