"""A SentencePiece vocabulary file as plain tables for the tokenising operators."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import cache, cached_property

import numpy as np

#: SentencePiece's own penalty for a character that no piece has, below the lowest score.
UNKNOWN_PENALTY = 10.0
DEFAULT_MODEL = "piece_bpe_32k.model"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_MODEL)


def charsmap_rules(blob: bytes) -> dict[str, str]:
    """The rewriting rules of a compiled map of characters: a size, a double array of so many bytes over UTF-8 sources, and targets that end in zeros.

    A unit of the double array has its label in the low 8 bits, a mark that a value follows in bit 8, and where its children begin above, in steps of 256 if bit 9 is set.
    """
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, targets = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64), blob[4 + size :]
    children = lambda unit: (unit >> 10) << ((unit & 0x200) >> 6)
    rules, bytes_ = {}, np.arange(1, 256)
    stack = [(int(children(units[0])), b"")]
    while stack:
        base, source = stack.pop()
        at = base ^ bytes_
        at = at[at < len(units)]
        at = at[(units[at] & 0x800000FF) == (at ^ base)]
        for place in at.tolist():
            unit = int(units[place])
            below, longer = place ^ int(children(unit)), source + bytes([place ^ base])
            if unit >> 8 & 1:
                value = int(units[below]) & 0x7FFFFFFF
                rules[longer.decode(errors="replace")] = targets[value : targets.index(b"\0", value)].decode()
            stack.append((below, longer))
    return rules


@dataclass
class Vocabulary:
    """Pieces with the file's scores, unigram log weights, byte pieces, and the normaliser's rules and switches."""

    pieces: dict[str, tuple[int, float]]
    byte_ids: list[int]
    names: list[str]
    merges: bool
    unknown_id: int
    dummy_prefix: bool
    squeeze: bool
    user_defined: dict[str, int] = field(default_factory=dict)
    charsmap: bytes = b""
    weights: dict[str, float] = field(default_factory=dict)
    unknown_weight: float = 0.0

    def __post_init__(self) -> None:
        # A merge file's scores are negative ranks, not log weights; by Zipf's law the weight falls as the rank's logarithm.
        self.weights = {p: -math.log(2 - s) if self.merges else s for p, (_, s) in self.pieces.items()}
        self.unknown_weight = min(self.weights.values(), default=0.0) - UNKNOWN_PENALTY

    @cached_property
    def suffixes(self) -> set[str]:
        return {p[i:] for p in self.pieces for i in range(len(p))}

    @cached_property
    def rules(self) -> dict[str, str]:
        return charsmap_rules(self.charsmap)


@cache
def load(path: str | None = None) -> Vocabulary:
    """Reads a .model file, unigram or of merges. Files that put the space mark after words, or none, raise."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path or default_path(), "rb") as f:
        model.ParseFromString(f.read())
    rules = model.normalizer_spec
    if not rules.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix or model.trainer_spec.model_type not in (1, 2):
        raise ValueError("only unigram and merge vocabularies with the space mark before words are compiled here")
    normal, unknown, user_defined, byte = 1, 2, 4, 6
    pieces = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type == normal}
    bytes_ = [i for i, p in enumerate(model.pieces) if p.type == byte]
    return Vocabulary(
        pieces,
        bytes_ if len(bytes_) == 256 else [],
        [p.piece for p in model.pieces],
        model.trainer_spec.model_type == 2,
        next(i for i, p in enumerate(model.pieces) if p.type == unknown),
        rules.add_dummy_prefix,
        rules.remove_extra_whitespaces,
        {p.piece: i for i, p in enumerate(model.pieces) if p.type == user_defined},
        rules.precompiled_charsmap,
    )
