"""SentencePiece encoding and decoding by weighted finite-state transducers.

Compiled once a process, as arrays of states and arcs:

- the normaliser, which rewrites the longest source of the file's map of characters at each place (user-defined pieces pass unchanged),
  squeezes spaces on demand and turns them into marks, with one in front;
- the lexicon: from its start over a piece's characters, last one first, and back, emitting the piece; a character of
  no piece emits its bytes, or the unknown piece;
- the weights. For a unigram vocabulary an arc weighs the piece's negative score. For a merge vocabulary they are
  those of an automaton whose state is the last piece: 0 if merging the characters of that piece and the next by rank gives the two
  again, infinite if not. Of all segmentations exactly one then has finite weight, that which merging the whole text gives.

A place that no piece can span is on every path, so a text is cut there: at each space mark after another character, at
other characters after letters and at line feeds, where the vocabulary has no such piece, and around user-defined pieces. A
task composes the distinct parts that it hasn't met, as one automaton: the trie of their prefixes, whose
states share distances. Composition with the lexicon goes over all states at once, and the shortest paths in the tropical semiring
are taken depth by depth. The paths' outputs are kept, and a text's ids are its parts' in a row; the inverse transducer decodes them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches
from .pieces import Vocabulary, load

#: Parts whose paths a task keeps; beyond it, it starts afresh, which changes no id.
KEPT = 200_000
MARK = "▁"
PAD = 0xFFFFFFFF


class Arcs:
    """A function from whole numbers (a state and a label in one) to whole numbers, as an open hash table."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] < 0
            place, first = np.unique(slot[free], return_index=True)
            chosen = np.flatnonzero(free)[first]
            self.keys[place], self.values[place] = keys[left[chosen]], values[left[chosen]]
            rest = np.ones(len(left), bool)
            rest[chosen] = False
            left, slot = left[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def follow(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], -1)
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            slot_left = slot[left] = (slot[left] + 1) & self.mask
            there = self.keys[slot_left]
            hit = there == keys[left]
            out[left[hit]] = self.values[slot_left[hit]]
            left = left[~hit & (there >= 0)]
        return out


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1 ... of each run, one after another."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


class Normaliser:
    def __init__(self, v: Vocabulary) -> None:
        self.v, self.rules, self.own = v, v.rules, sorted(v.user_defined, key=len, reverse=True)
        self.longest: dict[str, int] = {}
        for source in self.rules:
            self.longest[source[0]] = max(len(source), self.longest.get(source[0], 0))
        begin = "".join(map(re.escape, {*self.longest, *(x[0] for x in self.own)}))
        self.begin = re.compile(f"[{begin}]") if begin else None

    def rewritten(self, text: str) -> str:
        if not self.rules:
            return text
        out, place = [], 0
        while m := self.begin.search(text, place):
            i = m.start()
            out.append(text[place:i])
            source = next((x for x in self.own if text.startswith(x, i)), None)
            target = source
            if source is None:
                sources = (text[i : i + n] for n in range(self.longest.get(m[0], 1), 0, -1))
                source = next((x for x in sources if x in self.rules), m[0])
                target = self.rules.get(source, source)
            out.append(target)
            place = i + len(source)
        return "".join([*out, text[place:]])

    def __call__(self, text: str) -> str:
        text = self.rewritten(text)
        if self.v.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (MARK if self.v.dummy_prefix else "") + text.replace(" ", MARK)


class Lexicon:
    """The reversed trie of the pieces: states with arcs by character class, and the piece that ends at each state."""

    def __init__(self, v: Vocabulary) -> None:
        letters = sorted({c for p in v.pieces for c in p})
        self.classes = np.zeros(0x110001, np.int32)  # 0: in no piece; the last place is that of PAD
        self.classes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        number, arcs, ends = {c: i + 1 for i, c in enumerate(letters)}, {}, [-1]
        for piece, (i, _) in v.pieces.items():
            state = 0
            for c in reversed(piece):
                key = state * self.width + number[c]
                state = arcs.setdefault(key, len(ends))
                if state == len(ends):
                    ends.append(-1)
            ends[state] = i
        self.arcs = Arcs(np.fromiter(arcs, np.int64, len(arcs)), np.fromiter(arcs.values(), np.int64, len(arcs)))
        self.ends = np.array(ends, np.int64)


class Merges:
    """Which pieces may stand side by side in a merge vocabulary."""

    def __init__(self, v: Vocabulary) -> None:
        n, pieces = len(v.names), v.pieces
        order = {s: 2 * i for i, s in enumerate(sorted({s for _, s in pieces.values()}, reverse=True))}
        self.v, self.n = v, n
        self.rank, self.left, self.right, self.marks = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int8)
        pairs, ranks = [], []
        for piece, (i, score) in pieces.items():
            self.marks[i] = 4 * (MARK * 2 in piece) | 2 * piece.endswith(MARK) | piece.startswith(MARK)
            if len(piece) > 1:
                two = self.merged(piece, 2)
                if all(x in pieces for x in two) and len(two) == 2:
                    self.rank[i], self.left[i], self.right[i] = order[score], pieces[two[0]][0], pieces[two[1]][0]
                for k in range(1, len(piece)):
                    a, b = pieces.get(piece[:k]), pieces.get(piece[k:])
                    if a and b:
                        pairs.append(a[0] * n + b[0])
                        ranks.append(order[score])
        self.pairs = Arcs(np.array(pairs, np.int64), np.array(ranks, np.int64))
        self.known: dict[tuple[int, int], bool] = {}

    def merged(self, text: str, parts_left: int = 1) -> list[str]:
        """Characters of a short text merged by rank, the leftmost first among equals, down to `parts_left` parts."""
        pieces, parts = self.v.pieces, list(text)
        while len(parts) > parts_left:
            best, at = -np.inf, -1
            for i in range(len(parts) - 1):
                piece = pieces.get(parts[i] + parts[i + 1])
                if piece and piece[1] > best:
                    best, at = piece[1], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stand(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the arc from the state of piece a (-1: a character of none) over piece b has finite weight.

        The merges that made a and b are undone, the later first. If what then stands at the border would have merged before
        that, merging a and b's characters doesn't give a and b.
        """
        out = np.ones(len(a), bool)
        marks, other = self.marks[a], self.marks[b]
        twice = (a >= 0) & (((marks | other) & 4 > 0) | ((marks & 2 > 0) & (other & 1 > 0)))
        for i in np.flatnonzero(twice):  # runs of marks: few, and kept
            key = int(a[i]), int(b[i])
            if key not in self.known:
                x, y = self.v.names[key[0]], self.v.names[key[1]]
                self.known[key] = self.merged(x + y) == [x, y]
            out[i] = self.known[key]
        left = np.flatnonzero((a >= 0) & ~twice)
        a, b, limit = a[left], b[left], np.full(len(left), 1 << 40)
        while len(left):
            both = self.pairs.follow(a * self.n + b)
            bad = (both >= 0) & (both < limit)
            out[left[bad]] = False
            of_a, of_b = self.rank[a], self.rank[b]
            later = of_a > of_b
            keep = np.flatnonzero(~bad & ((of_a >= 0) | (of_b >= 0)))
            left, a, b, of_a, of_b, later = left[keep], a[keep], b[keep], of_a[keep], of_b[keep], later[keep]
            limit = np.where(later, of_a, of_b + 1)
            a, b = np.where(later, self.right[a], a), np.where(later, b, self.left[b])
        return out


class Transducer:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v, self.normalise, self.lexicon = vocabulary, Normaliser(vocabulary), Lexicon(vocabulary)
        self.merges = Merges(vocabulary) if vocabulary.merges else None
        self.costs = np.zeros(len(vocabulary.names))
        for p, (i, _) in vocabulary.pieces.items():
            self.costs[i] = -vocabulary.weights[p]
        self.unknown: dict[int, list[int]] = {}
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.counts, self.used = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    @cached_property
    def parts(self) -> re.Pattern:
        """Cuts a normalised text where no piece can span, as far as the vocabulary's pieces allow."""
        crossing = lambda pattern: any(re.search(pattern, p) for p in self.v.pieces)
        letter, other = r"[^\W\d_]", rf"(?:(?![{MARK}\n])[\W\d_])"
        if crossing(f"[^{MARK}]{MARK}"):
            return re.compile("(?s).+")
        if crossing(f"\n|{letter}[\\W\\d_]"):
            return re.compile(f"(?s){MARK}*[^{MARK}]+|{MARK}+")
        return re.compile(rf"\n|{MARK}*{other}*{letter}+|{MARK}*{other}+|{MARK}+")

    @cached_property
    def own(self) -> re.Pattern | None:
        """The user-defined pieces, of those that begin at one place the longest."""
        names = sorted(self.v.user_defined, key=len, reverse=True)
        return re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def cut(self, text: str) -> list[str]:
        text = self.normalise(text)
        if not self.own:
            return self.parts.findall(text)
        return [p for i, x in enumerate(self.own.split(text)) for p in ([x] if i % 2 else self.parts.findall(x))]

    def emitted(self, c: int) -> list[int]:
        """The output of a character that is in no piece."""
        found = self.unknown.get(c)
        if found is None:
            if len(self.unknown) > 50_000:
                self.unknown.clear()
            found = self.unknown[c] = [self.v.byte_ids[b] for b in chr(c).encode()] if self.v.byte_ids else [self.v.unknown_id]
        return found

    def learn(self, parts: set[str]) -> None:
        """Composes the parts, by length up to a power of two, and keeps the outputs of their shortest paths."""
        by: dict[int, list[str]] = {}
        for p in parts:
            by.setdefault(max(8, 1 << (len(p) - 1).bit_length()), []).append(p)
        for width, some in by.items():
            some.sort()
            each = max(1, (1 << 22) // width)
            for a in range(0, len(some), each):
                self._keep(some[a : a + each], *self.shortest(some[a : a + each], width))

    def _keep(self, parts: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        n = len(self.known)
        while n + len(parts) > len(self.starts):
            self.starts, self.counts = np.r_[self.starts, np.zeros_like(self.starts)], np.r_[self.counts, np.zeros_like(self.counts)]
        while self.used + len(ids) > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros_like(self.ids)]
        self.starts[n : n + len(parts)] = self.used + np.cumsum(counts) - counts
        self.counts[n : n + len(parts)] = counts
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.known.update(zip(parts, range(n, n + len(parts))))

    def shortest(self, parts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the lightest path of each of the sorted parts, in a row, and how many each has; of equally light paths that with the longest last piece at each place."""
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        grid = np.full((len(parts), width), PAD, np.uint32)
        here = np.arange(width) < lengths[:, None]
        grid[here] = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        # The trie of the parts: a state for each prefix that differs from the row above, numbered depth by depth from 1.
        new = here.copy()
        new[1:] &= np.logical_or.accumulate(grid[1:] != grid[:-1], axis=1)
        state, base = np.zeros((len(parts), width), np.int64), [1]
        above, letter = [np.zeros(1, np.int64)], [np.zeros(1, np.uint32)]
        for d in range(width):
            rows = np.flatnonzero(new[:, d])
            state[:, d] = base[-1] - 1 + np.cumsum(new[:, d])
            base.append(base[-1] + len(rows))
            above.append(state[rows, d - 1] if d else np.zeros(len(rows), np.int64))
            letter.append(grid[rows, d])
        above, letter = np.concatenate(above), np.concatenate(letter)
        kind = self.lexicon.classes[np.minimum(letter, 0x110000)].astype(np.int64)
        last, back = self._viterbi(above, kind, np.array(base))
        # Back along the paths of all parts at once.
        at, steps, who, place = state[np.arange(len(parts)), lengths - 1], [], np.arange(len(parts)), []
        while len(at):
            steps.append(np.where(last[at] < 0, -1 - letter[at].astype(np.int64), last[at]))
            place.append(who)
            at = back[at]
            who, at = who[at > 0], at[at > 0]
        step = np.repeat(np.arange(len(steps)), [len(x) for x in steps])
        steps, place = np.concatenate(steps), np.concatenate(place)
        steps = steps[np.lexsort((-step, place))]
        counts = np.bincount(place, minlength=len(parts))
        odd = np.flatnonzero(steps < 0)
        if not len(odd):
            return steps.astype(np.int32), counts
        outputs = [self.emitted(-1 - c) for c in steps[odd].tolist()]
        size = np.ones(len(steps), np.int64)
        size[odd] = [len(x) for x in outputs]
        out = np.repeat(steps, size)
        out[ranges((np.cumsum(size) - size)[odd], size[odd])] = [x for y in outputs for x in y]
        return out.astype(np.int32), np.add.reduceat(size, np.cumsum(counts) - counts)

    def _viterbi(self, above: np.ndarray, kind: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each state of the parts' trie: the last piece of its lightest path (-1: a character of none) and the state before it."""
        lexicon, merges = self.lexicon, self.merges
        arcs = []  # by length of the piece: states, the state before the piece, piece
        at, before, state = np.arange(1, len(above)), np.arange(1, len(above)), np.zeros(len(above) - 1, np.int64)
        while len(at):
            state = lexicon.arcs.follow(state * lexicon.width + kind[before])
            alive = state >= 0
            at, before, state = at[alive], above[before[alive]], state[alive]
            whole = lexicon.ends[state] >= 0
            arcs.append((at[whole], before[whole], lexicon.ends[state[whole]]))
            alive = before > 0
            at, before, state = at[alive], before[alive], state[alive]
        cuts = [np.searchsorted(x[0], base) for x in arcs]
        last, back, far = np.full(len(above), -1, np.int64), above.copy(), np.full(len(above), np.inf)
        far[0] = 0.0
        for d in range(len(base) - 1):
            low, high = base[d], base[d + 1]
            if low == high:
                break
            if merges:  # one piece has finite weight, or none and the character is unknown
                open_ = np.ones(high - low, bool)
                for (to, start, piece), cut in zip(reversed(arcs), reversed(cuts)):
                    x = slice(cut[d], cut[d + 1])
                    left = open_[to[x] - low]
                    a, b, p = to[x][left], start[x][left], piece[x][left]
                    good = b == 0
                    rest = np.flatnonzero(~good)
                    good[rest] = merges.stand(last[b[rest]], p[rest])
                    last[a[good]], back[a[good]] = p[good], b[good]
                    open_[a[good] - low] = False
            else:
                for k, ((to, start, piece), cut) in enumerate(zip(arcs, cuts)):
                    x = slice(cut[d], cut[d + 1])
                    a, b, p = to[x], start[x], piece[x]
                    weight = far[b] + self.costs[p]
                    good = weight <= far[a]
                    far[a[good]], last[a[good]], back[a[good]] = weight[good], p[good], b[good]
                    if not k:  # a character that is a piece isn't unknown
                        lone = np.setdiff1d(np.arange(low, high), a, assume_unique=True)
                        far[lone] = far[above[lone]] - self.v.unknown_weight
        return last, back

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        rows = [self.cut(x) if x else [] for x in texts]
        if len(self.known) > KEPT:
            self.forget()
        self.learn({p for row in rows for p in row}.difference(self.known, self.v.user_defined))
        if self.own and (fresh := [p for p in self.v.user_defined if p not in self.known]):
            self._keep(fresh, np.array([self.v.user_defined[p] for p in fresh], np.int32), np.ones(len(fresh), np.int64))
        known = self.known
        index = np.array([known[p] for row in rows for p in row], np.int64)
        sizes = self.counts[index]
        flat = self.ids[ranges(self.starts[index], sizes)]
        ends = np.r_[0, np.cumsum(sizes)][np.cumsum([0, *map(len, rows)])]
        if not self.v.byte_ids and len(flat):  # unknown characters in a row are one piece
            odd = flat == self.v.unknown_id
            first = np.zeros(len(flat) + 1, bool)
            first[ends[:-1]] = True
            drop = odd & np.r_[False, odd[:-1]] & ~first[:-1]
            flat, ends = flat[~drop], ends - np.r_[0, np.cumsum(drop)][ends]
        return flat, np.diff(ends)

    @cached_property
    def outputs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The arcs of the inverse transducer: the bytes of all pieces in a row, where each begins, and how many it has."""
        byte, v = {i: bytes([b]) for b, i in enumerate(self.v.byte_ids)}, self.v
        plain = {i for i, _ in v.pieces.values()} | {*v.user_defined.values()}
        rows = [byte[i] if i in byte else b" \xe2\x81\x87 " if i == v.unknown_id else name.replace(MARK, " ").encode() if i in plain else b"" for i, name in enumerate(v.names)]
        counts = np.array([len(x) for x in rows], np.int64)
        return np.frombuffer(b"".join(rows), np.uint8), np.cumsum(counts) - counts, counts

    def decode_flat(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each path; bytes that aren't UTF-8 become U+FFFD."""
        data, starts, sizes = self.outputs
        size = sizes[ids]
        text = data[ranges(starts[ids], size)].tobytes()
        ends = np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum(counts)]].tolist()
        mark = b" " if self.v.dummy_prefix else b"\n\n"
        return [text[a + (text[a : a + 1] == mark) : b].decode(errors="replace") if a < b else "" for a, b in zip(ends, ends[1:])]

    def encode(self, texts: list[str | None]) -> list[list[int] | None]:
        """Ids of each text; null for null."""
        flat, counts = self.encode_flat(texts)
        ends = np.cumsum(counts)
        return [None if x is None else flat[b - n : b].tolist() for x, n, b in zip(texts, counts, ends)]

    def decode(self, ids: list[int]) -> str:
        return self.decode_flat(np.array(ids, np.int64), np.array([len(ids)]))[0]


@cache
def compiled(path: str | None) -> Transducer:
    return Transducer(load(path))


def _lists(flat: np.ndarray, counts: np.ndarray, nulls: np.ndarray) -> pa.Array:
    offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, mask=np.r_[nulls, False]), pa.array(flat, pa.int32()))


def _run(path: str | None, encode: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = compiled(path)
        for big in batches:
            for batch in slices(big, "text", 2 << 20) if encode else [big]:
                if encode:
                    texts = batch.column("text").to_pylist()
                    flat, counts = transducer.encode_flat(texts)
                    yield pa.RecordBatch.from_arrays([batch.column("row"), _lists(flat, counts, np.array([x is None for x in texts], bool))], names=["row", "ids"])
                else:
                    texts = [None if not x.is_valid else transducer.decode(x.values.to_pylist()) for x in batch.column("ids")]
                    yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "decoded"])

    return run


def encode(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """docs with the column `ids` (a column of that name in docs is replaced). Null texts have null ids, empty texts none.

    `path` is a SentencePiece model file on every machine; unigram or of merges. Whole texts are encoded, however long; repeated rows each stay.
    """
    held = [c for c in docs.columns if c != "ids"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in held]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = rows.mapInArrow(_run(path, True), f"row {rows.schema['row'].dataType.simpleString()}, ids array<int>")
    return out.select(*[F.col("row").getField(c).alias(c) for c in held], "ids")


def decode(docs: DataFrame, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """docs with the column `decoded`. Null ids have a null text."""
    held = [c for c in docs.columns if c != "decoded"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in held]).alias("row"), F.col(f"`{ids_col}`").alias("ids"))
    out = rows.mapInArrow(_run(path, False), f"row {rows.schema['row'].dataType.simpleString()}, decoded string")
    return out.select(*[F.col("row").getField(c).alias(c) for c in held], "decoded")


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_ids, ids, decoded, whole) for every row: ids of the text, their text, and whether that is the input, both normalised.

    One pass both ways. A null text has null ids, text and flag, an empty one no ids; repeated rows each stay, whole texts are taken however long they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = compiled(path)
        for big in batches:
            for batch in slices(big, "text", 2 << 20):
                texts = batch.column("text").to_pylist()
                flat, counts = transducer.encode_flat(texts)
                back = [None if x is None else y for x, y in zip(texts, transducer.decode_flat(flat, counts))]
                whole = [None if x is None else x == y or transducer.normalise(x) == transducer.normalise(y) for x, y in zip(texts, back)]
                ids = _lists(flat, counts, np.array([x is None for x in texts], bool))
                yield pa.RecordBatch.from_arrays([batch.column("id"), ids, pa.array(back, pa.string()), pa.array(whole, pa.bool_())], names=["id", "ids", "decoded", "whole"])

    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, ids array<int>, decoded string, whole boolean").select(F.col("id").alias(id_col), F.size("ids").alias("n_ids"), "ids", "decoded", "whole")
