"""Language-model scores from a hierarchical Pitman-Yor model of words in context.

A token's context is the word before it, that of a document's first token the end of texts. Each context has a restaurant whose
customers are the training tokens that follow it; all share the corpus restaurant as parent, whose own parent is the uniform
distribution over the known words and one unknown. A table of a context's restaurant is a customer of the corpus. The predictive probability of w after u is
(c_uw - d t_uw) / (theta + c_u) + (theta + d t_u) / (theta + c_u) * P_corpus(w); a text's is the product over its tokens, so perplexity follows from it.

Training counts pairs of neighbouring words. Given how many tables the restaurant's other words have and the parent's probability of the word, the number of tables of a word is drawn
from its exact distribution, in which all its customers have left and sit down again: with a discount of a half its generalised Stirling numbers have a closed form. A sweep draws each half of a restaurant's
words at once, given the other half and its own half as it was. Then the tables of each word are summed over its contexts, and the corpus restaurant is swept likewise, all words at once. P_corpus averages the sweeps after the first.
The contexts are seated in ROUNDS: first under each word's share of the counts, then, going on from their tables, under the corpus restaurant, which is seated anew after each round.

Words are 64-bit hashes. A chunk (a set of documents) sends its distinct pairs to parts, by context; contexts of over HEAVY tokens are spread over all parts, by pair.
A part sums its pairs. Those of one customer have one table, so that only the others are seated, each under its own word's probability, which is joined to the part's words. A part of a spread context
takes the tables of the other parts as they were after the round before, in the first round as many as its customers there let expect. At last a part answers each chunk in the order of its pairs. Counts of words go the same way as rows, so no table of all words or pairs
is ever in one place. Random numbers follow from words, and parts from counts, so that scores depend neither on how
the table is laid out nor on which task is run again.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.store import Store
from .common import as_bytes, crc_mod, hashes, mix, need, slices, words_of

#: Discount of all restaurants: the one with a closed form of the Stirling numbers.
D = 0.5
#: Strengths of the context and the corpus restaurants.
CONTEXT, CORPUS = 10.0, 100.0
#: Sweeps of the context restaurants and of the corpus restaurant.
GIBBS, SWEEPS = 3, 3
#: Times that the contexts are seated, each with so many sweeps, and the corpus after them.
ROUNDS = 2
#: Frequent words that chunks send as small numbers in place of hashes.
TOP = 1 << 16
#: Training tokens a part; tokens of a context that is spread over parts.
PART, HEAVY = 1_500_000, 250_000
#: Bytes of text of a chunk, on average.
CHUNK_BYTES = 16 << 20
#: Large chunks that are broadcast at most; more are joined by a shuffle.
MOST_BROADCAST = 10_000
END = int(hashes([b"\n"])[0])  # no word has a line feed


def tokens_of(text: bytes | None) -> np.ndarray:
    return np.r_[hashes(words_of(text and text.lower())), np.uint64(END)]


def _uniform(x: np.ndarray, key: int) -> np.ndarray:
    return (mix(x + np.uint64(key * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def seed(tokens: np.ndarray, key: int) -> int:
    """The seed of a document's own random numbers."""
    return xxhash.xxh64_intdigest(tokens.tobytes(), key)


class Repeats:
    """The tokens of a document whose word stood before, in order: only these have a choice of tables."""

    def __init__(self, words: np.ndarray) -> None:
        """words: a number for each token, from 0 without gaps."""
        n = len(words)
        order = np.argsort(words, kind="stable")
        first = np.r_[True, words[order[1:]] != words[order[:-1]]]
        place = np.arange(n)
        before = np.empty(n, np.int64)
        before[order] = place - np.maximum.accumulate(np.where(first, place, 0))
        new = before == 0
        self.at = np.flatnonzero(~new)
        self.words, self.before = words[self.at], before[self.at]  # and how many tokens of the word stood before
        self.opened = np.cumsum(new) - new  # first tables before each token


def predictive(words: np.ndarray, parent: np.ndarray, d: float, theta: float, seeds: list[int]) -> np.ndarray:
    """The probability of each token given a seating of those before it, which is sampled on the way; the mean over a seating for each of the seeds.

    words: a number for each token, from 0 without gaps; parent: the probability of each number under the parent.
    """
    rest = Repeats(words)
    start, total = parent[words], theta + d * rest.opened
    rows = list(zip(rest.words.tolist(), rest.before.tolist(), total[rest.at].tolist(), start[rest.at].tolist()))
    mean, n = np.zeros(len(words)), len(rest.at)
    following = np.searchsorted(rest.at, np.arange(len(words)))  # the repeats before each token
    for key in seeds:
        tables, more, p, opened = [d] * len(parent), 0.0, [], []  # d t of each word; d times the tables beyond the first
        add = p.append
        for (w, c, most, h), u in zip(rows, _uniform(np.arange(n, dtype=np.uint64), key).tolist()):
            mass = (most + more) * h
            x = c - tables[w] + mass
            add(x)
            if u * x < mass:
                tables[w] += d
                more += d
                opened.append(len(p))
        value = (total + d * np.searchsorted(np.array(opened, np.int64), following, side="right")) * start
        value[rest.at] = p
        mean += value
    return mean / len(seeds) / (theta + np.arange(len(words)))


def gibbs_tables(words: np.ndarray, parent: np.ndarray, d: float, theta: float, sweeps: int, rng: random.Random) -> np.ndarray:
    """The number of tables of each word after seating the tokens one by one and so many sweeps of seating each again given all others."""
    draw, rest = rng.random, Repeats(words)
    several: dict[int, tuple[list[int], list[int]]] = {}  # of each word that repeats: the table of each customer, and the customers of each table, 0 where it is gone
    tables, more = [1] * len(parent), 0.0

    def old(own: list[int], size: list[int], without: int) -> int:
        """A table of the word with a chance of its customers less d: that of a random customer, unless d of its customers are drawn."""
        n = len(own)
        while True:
            j = int(draw() * n)
            if j != without and draw() * size[own[j]] >= d:
                return own[j]

    for w, c, most, h in zip(rest.words.tolist(), rest.before.tolist(), (theta + d * rest.opened[rest.at]).tolist(), parent[rest.words].tolist()):
        if c == 1:
            several[w] = [0], [1]
        own, size = several[w]
        mass = (most + more) * h
        if draw() * (c - d * tables[w] + mass) < mass:
            own.append(len(size))
            size.append(1)
            tables[w] += 1
            more += d
        else:
            k = 0 if len(size) == 1 else old(own, size, -1)
            own.append(k)
            size[k] += 1
    total = theta + d * len(parent) + more
    for _ in range(sweeps):  # a word's only customer can but open its table again
        for w, (own, size) in several.items():
            h, c, t = float(parent[w]), len(own) - 1, tables[w]
            for i, k in enumerate(own):
                size[k] -= 1
                if not size[k]:
                    t -= 1
                    total -= d
                mass = total * h
                if draw() * (c - d * t + mass) < mass:
                    if size[k]:
                        k = len(size)
                        size.append(0)
                    t += 1
                    total += d
                elif t > 1 or not size[k]:
                    k = old(own, size, i)
                own[i] = k
                size[k] += 1
            tables[w] = t
    return np.array(tables, np.int64)


def drawn_tables(c: np.ndarray, h: np.ndarray, a: np.ndarray, u: np.ndarray, most: int = 1 << 21) -> np.ndarray:
    """The number of tables of each word with c customers, drawn by the uniform number u from its distribution given all other words: a table opens at (a + D t) h, where
    a is the strength and D times the tables of the other words.

    t has the weight S(c, t) h^t (a) (a + D) ... (a + D (t - 1)), S being the generalised Stirling numbers; t + 1 has ratio(t) times that of t, which falls with t. Far beyond the largest weight there is nothing to be drawn.
    """
    ratio = lambda c, h, a, t: 4 * h * (a + D * t) * (c - t) / ((2 * c - t - 1) * t)
    c = c.astype(np.float64)
    low, high = np.ones(len(c)), c.copy()
    for _ in range(int(np.log2(c.max(initial=1))) + 1):  # the first t whose ratio is below one
        middle = np.floor((low + high) / 2)
        up = (ratio(c, h, a, middle) >= 1) & (middle < high)
        low, high = np.where(up, middle + 1, low), np.where(up, high, middle)
    bend = D / (a + D * low) - 1 / np.maximum(c - low, 0.5) + 1 / np.maximum(2 * c - low - 1, 0.5) - 1 / low
    far = np.ceil(12 / np.sqrt(np.maximum(-bend, 1e-12))) + 16
    first, last = np.maximum(1, low - far), np.minimum(c, low + far)
    n = (last - first + 1).astype(np.int64)
    out, ends = np.empty(len(c), np.int64), np.cumsum(n)
    start = 0
    while start < len(c):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right")))
        size = n[start:stop]
        at = np.r_[0, np.cumsum(size)[:-1]]
        who = np.repeat(np.arange(start, stop), size)
        t = np.arange(len(who)) - np.repeat(at, size) + first[who]
        steps = np.log(ratio(c[who], h[who], a[who], np.maximum(t - 1, 0.5)))
        steps[at] = 0.0
        sums = np.cumsum(steps)
        sums -= np.repeat(np.maximum.reduceat(sums, at), size)
        weights = np.cumsum(np.exp(sums))
        before = np.r_[0.0, weights[at[1:] - 1]]
        place = np.searchsorted(weights, before + u[start:stop] * (weights[at + size - 1] - before), side="right")
        out[start:stop] = first[start:stop] + np.clip(place - at, 0, size - 1)
        start = stop
    return out


def seated(context: np.ndarray, c: np.ndarray, h: np.ndarray, key: np.ndarray, whole: np.ndarray, theta: float, sweeps: int, beside: np.ndarray | float = 0.0, t: np.ndarray | None = None, before: int = 0) -> np.ndarray:
    """The tables of each pair after the sweeps. context: a number from 0; c: customers, 0 for none; h: the word's probability under the parent; key: a hash of the pair; whole: for each context, how much larger it is than what is here;
    beside: its further tables; t: where the sweeps begin, by default with one table; before: sweeps done before, which drew other numbers."""
    t = np.minimum(c, 1).astype(np.int64) if t is None else t.astype(np.int64)
    many, half = c > 1, (mix(key) & np.uint64(1)).astype(bool)
    for k in range(2 * before, 2 * (before + sweeps)):
        now = np.flatnonzero(many & (half == bool(k % 2)))
        if len(now):
            total = np.bincount(context, weights=t, minlength=len(whole)) * whole + beside
            t[now] = drawn_tables(c[now], h[now], theta + D * (total[context[now]] - t[now]), _uniform(key[now], k + 1))
    return t


def seat_corpus(words: np.ndarray, customers: np.ndarray, before: np.ndarray, tables: float, types: int, sweep: int, theta: float) -> np.ndarray:
    """Tables of each word given those of all others: `tables` in all, of which the word has `before`."""
    out, many = np.minimum(customers, 1).astype(np.int64), customers > 1
    if many.any():
        out[many] = drawn_tables(customers[many], np.full(many.sum(), 1 / (types + 1)), theta + D * (tables - before[many]), _uniform(words[many], sweep * 1_000_003))
    return out


def corpus_sweeps(words: np.ndarray, customers: np.ndarray, tables: list[float], types: int, theta: float) -> list[np.ndarray]:
    """The tables of the words in each sweep so far, one for each of `tables`: those of all words in the sweep before."""
    out = [np.minimum(customers, 1)]
    for k, total in enumerate(tables):
        out.append(seat_corpus(words, customers, out[-1], total, types, k, theta))
    return out[1:]


class Chunk:
    """The words and pairs of a chunk's texts in order of their hashes, whatever the order of the texts."""

    def __init__(self, texts: list[bytes | None]) -> None:
        tokens = [tokens_of(x) for x in texts]
        self.sizes = np.array([len(x) for x in tokens], np.int64)
        self.words, at = np.unique(np.concatenate(tokens), return_inverse=True)
        del tokens
        self.at = at.astype(np.int32)
        ends = np.cumsum(self.sizes)
        self.starts = ends - self.sizes
        before = np.r_[np.int32(0), self.at[:-1]]
        before[self.starts] = np.searchsorted(self.words, np.uint64(END))
        pairs, place = np.unique(before.astype(np.int64) * len(self.words) + self.at, return_inverse=True)
        self.place = place.astype(np.int32)  # the pair of each token
        self.u, self.w = pairs // len(self.words), pairs % len(self.words)

    def parts(self, parts: int, heavy: np.ndarray) -> np.ndarray:
        """The part of each pair: by context, for heavy ones by pair."""
        if parts == 1:
            return np.zeros(len(self.u), np.int64)
        spread = np.isin(self.words, heavy)[self.u]
        key = mix(self.words)[self.u]
        return (np.where(spread, mix(key ^ self.words[self.w]), key) % np.uint64(parts)).astype(np.int64)


class Top:
    """The most frequent words by hash; heavy: those that are spread over parts as contexts."""

    def __init__(self, rows: pa.Table, heavy: int) -> None:
        words, counts = np.asarray(rows["word"]).astype(np.int64).view(np.uint64), np.asarray(rows["c"]).astype(np.float64)
        order = np.argsort(words)
        self.known = words[order]
        self.heavy = self.known[counts[order] > heavy]


#: What a chunk sends to a part, see _pairs. Numbers that only Python reads are bytes, of which Spark makes no values.
SENT = "part long, chunk long, words binary, u binary, k binary, w binary, c binary"
#: Values below FAR are a byte, FAR stands for the next of the further ones.
FAR = 255


def _table(schema: str, **columns: list) -> pa.Table:
    """The columns by name, missing ones null. Arrays that the schema has as binary are all their first bytes, then all second ones and so on, which leaves little of them once compressed."""
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    n, out = max(map(len, columns.values())), {}
    for name, kind in (x.split() for x in schema.split(", ")):
        values = columns.get(name, [None] * n)
        if kind == "binary":
            values = [None if x is None else np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes() for x in values]
        out[name] = pa.array(values, kinds[kind])
    return pa.table(out)


def _numbers(value: pa.Scalar, kind: type = np.int64) -> np.ndarray:
    """An array of a column of _table."""
    if not pa.types.is_binary(value.type):
        return value.values.to_numpy()
    return np.ascontiguousarray(np.frombuffer(value.as_buffer(), np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def _pairs(top, parts: int):
    """Rows (part, chunk, words, u, k, w, c) for a chunk's texts: its pairs by context u (k pairs each), with the times they occur in training documents. Numbers from TOP on are places in words, others places in top."""

    def run(key, texts):
        known, heavy = top.value.known, top.value.heavy
        chunk = Chunk(as_bytes(texts.column("text")))
        train = np.repeat(texts.column("train").to_numpy().astype(bool), chunk.sizes)
        c = np.bincount(chunk.place[train], minlength=len(chunk.u)).astype(np.int32)
        place = np.minimum(np.searchsorted(known, chunk.words), max(len(known) - 1, 0))
        known_as = np.where(known[place] == chunk.words, place, -1) if len(known) else np.full(len(chunk.words), -1)
        number = known_as.astype(np.int32)
        part = chunk.parts(parts, heavy)
        order = np.argsort(part, kind="stable")
        out = []
        for mine in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            us, w = chunk.u[mine], chunk.w[mine]  # the pairs of a context stand together
            starts = np.flatnonzero(np.r_[True, us[1:] != us[:-1]])
            u, k = us[starts], np.diff(np.r_[starts, len(us)])
            rare = np.unique(np.r_[u[known_as[u] < 0], w[known_as[w] < 0]])
            number[rare] = TOP + np.arange(len(rare))
            out.append((int(part[mine[0]]), key[0].as_py(), chunk.words[rare].view(np.int64), number[u], k.astype(np.int32), number[w], c[mine]))
        return _table(SENT, **dict(zip((x.split()[0] for x in SENT.split(", ")), map(list, zip(*out)))))

    return run


#: A part's sums: of each chunk the customers of each of its pairs (many: 0, 1 or 2 for several) and the numbers of those of several; in a row without chunk these pairs (u, w: places in words; c),
#: with the customers of each word's restaurant here (here) and how many of these are a word's only ones (single); and the tables that stay: of pairs of one customer (stay, stay_t, stay_own).
MERGED = "part long, chunk long, many binary, numbers binary, words array<long>, u binary, w binary, c binary, single binary, here binary, stay array<long>, stay_t array<int>, stay_own array<int>"
#: The pairs again with their tables, and of each word those over its contexts here and those of the context that it is.
SEATED = "part long, words array<long>, u binary, w binary, c binary, single binary, here binary, t binary, t_word array<long>, own array<long>"


def _merged(top):
    """See MERGED."""

    def run(key, rows):
        known = top.value.known
        arrays = {name: [_numbers(x, np.int64 if name == "words" else np.int32) for x in rows.column(name)] for name in ("words", "u", "k", "w", "c")}
        flat = lambda name: np.concatenate(arrays[name])
        lengths = lambda name: np.array([len(x) for x in arrays[name]])
        words, rare = np.unique(flat("words").view(np.uint64), return_inverse=True)
        rare, sizes, shift = rare.astype(np.int32), lengths("w"), np.r_[0, np.cumsum(lengths("words"))[:-1]]
        span = TOP + len(words)

        def numbers(name: str) -> np.ndarray:
            x = flat(name).astype(np.int64)
            far = np.flatnonzero(x >= TOP)
            x[far] = TOP + rare[x[far] - TOP + np.repeat(shift, lengths(name))[far]]
            return x

        pairs = np.repeat(numbers("u") * span, flat("k"))
        pairs += numbers("w")
        pairs, place = np.unique(pairs, return_inverse=True)
        place = place.astype(np.int32)
        c = np.bincount(place, weights=flat("c"), minlength=len(pairs)).astype(np.int64)
        hashed = np.zeros(span, np.uint64)
        hashed[: len(known)], hashed[TOP:] = known, words
        here = np.bincount(pairs // span, weights=c, minlength=span).astype(np.int64)
        once, many = c == 1, np.flatnonzero(c > 1)
        number = np.zeros(len(pairs), np.int32)
        number[many] = np.arange(len(many))
        own, tables = np.bincount(pairs[once] // span, minlength=span), np.bincount(pairs[once] % span, minlength=span)
        stay = np.flatnonzero((own > 0) | (tables > 0))
        used, at = np.unique(np.r_[pairs[many] // span, pairs[many] % span], return_inverse=True)
        at = at.astype(np.int32)
        of_chunks = np.split(place, np.cumsum(sizes)[:-1])
        customers = np.minimum(c, 2).astype(np.uint8)
        n, part, none = rows.num_rows, key[0].as_py(), [None]
        last = {"words": hashed[used].view(np.int64), "u": at[: len(many)], "w": at[len(many) :], "c": c[many], "single": own[used].astype(np.int32), "here": here[used], "stay": hashed[stay].view(np.int64), "stay_t": tables[stay].astype(np.int32), "stay_own": own[stay].astype(np.int32)}
        firsts = {"part": [part] * (n + 1), "chunk": rows.column("chunk").to_pylist() + none, "many": [customers[x] for x in of_chunks] + none, "numbers": [number[x[customers[x] == 2]] for x in of_chunks] + none}
        return _table(MERGED, **firsts, **{name: none * n + [x] for name, x in last.items()})

    return run


def _seat(parts: int, heavy: int, theta: float, sweeps: int, done: int):
    """See SEATED. pairs: a part's row; shares: of each of its words the probability under the parent (share), its tokens (n) and, from the second round on, its tables as a context (tables)."""

    def run(key, pairs, shares):
        kinds = {"u": np.int32, "w": np.int32, "single": np.int32}
        values = {name: _numbers(pairs.column(name)[0], kinds.get(name, np.int64)) for name in pairs.column_names if name != "part"}
        words, u, w, c = values["words"].view(np.uint64), values["u"], values["w"], values["c"]
        order = np.argsort(words)
        at = order[np.searchsorted(words, shares.column("word").to_numpy().view(np.uint64), sorter=order)]
        h, n, tables = np.zeros(len(words)), np.zeros(len(words)), np.zeros(len(words))
        h[at], n[at], tables[at] = shares.column("share").to_numpy(), shares.column("n").to_numpy(), shares.column("tables").to_numpy()
        whole, beside, spread = np.ones(len(words)), values["single"].astype(np.float64), (n > heavy) & (values["here"] > 0) & (parts > 1)
        if done:
            beside[spread] = tables[spread] - values["own"][spread]  # with those of this part's pairs of one customer
        else:
            whole[spread] = n[spread] / values["here"][spread]
            beside *= whole
        t = seated(u, c, h[w], mix(words[u]) ^ words[w], whole, theta, sweeps, beside, values.get("t"), done * sweeps)
        t_word, own = (np.bincount(x, weights=t, minlength=len(words)).astype(np.int64) for x in (w, u))
        return _table(SEATED, **{"part": [key[0].as_py()], **{name: [x] for name, x in values.items()}, "t": [t], "t_word": [t_word], "own": [own]})

    return run


def _answers(key, codes: pa.Table, seats: pa.Table) -> pa.Table:
    """Rows (chunk, part, found, further): 2 c - t of each of a chunk's pairs in order, over all training documents; see FAR."""
    c, t = (_numbers(seats.column(x)[0]) for x in "ct")
    value, found, further = 2 * c - t, [], []
    for many, numbers in zip(codes.column("many"), codes.column("numbers")):
        out = _numbers(many, np.uint8).astype(np.int64)  # one table for one customer, so that 2 c - t is c
        out[out == 2] = value[_numbers(numbers, np.int32)]
        found.append(np.minimum(out, FAR).astype(np.uint8))
        further.append(out[out >= FAR])
    return _table("chunk long, part long, found binary, further binary", chunk=codes.column("chunk").to_pylist(), part=codes.column("part").to_pylist(), found=found, further=further)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, word, c): of each word of the documents of a chunk in a run of documents, its training tokens."""
    for big in batches:
        for batch in slices(big, "text", 16 << 20):
            chunks, train = batch.column("chunk").to_numpy(), batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
            rows = [tokens_of(x) for x in as_bytes(batch.column("text"))]
            for chunk in np.unique(chunks):
                here = np.flatnonzero(chunks == chunk)
                words, at = np.unique(np.concatenate([rows[i] for i in here]), return_inverse=True)
                c = np.bincount(at[np.repeat(train[here], [len(rows[i]) for i in here])], minlength=len(words))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), chunk, np.int64)), pa.array(words.view(np.int64)), pa.array(c.astype(np.int64))], names=["chunk", "word", "c"])


def _swept(tables: list[float], types: int, theta: float):
    """The tables of all words of a batch in the last of the sweeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = corpus_sweeps(batch.column("word").to_numpy().view(np.uint64), batch.column("t").to_numpy(), tables, types, theta)[-1]
            yield pa.RecordBatch.from_arrays([pa.array([float(s.sum())])], names=["s"])

    return run


def _shares(tables: list[float], types: int, theta: float):
    """(word, c, share, own): the word's mean share t - D s over the sweeps after the first, and its tables as a context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, t = batch.column("word").to_numpy().view(np.uint64), batch.column("t").to_numpy()
            done = corpus_sweeps(words, t, tables, types, theta)
            kept = np.mean(done[1:] or done, axis=0)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(t - D * kept), batch.column("own")], names=["word", "c", "share", "own"])

    return run


def _chunked(rows: DataFrame, chunk_bytes: int) -> DataFrame:
    """rows (id, text ...) with `chunk`: about chunk_bytes of text each, of neighbouring ids where these are dense, which makes fewer rows; results don't depend on it.

    Null ids, and ids of more than four chunks' text, are dealt by their texts.
    """
    n, size, low, high = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.min("id"), F.max("id")).first()
    many = size // chunk_bytes + 1
    by_text = F.lit(-1) - F.pmod(F.xxhash64("text"), F.lit(many))
    if n and low is not None and high - low + 1 <= 4 * n:
        chunk = F.floor((F.col("id") - F.lit(low)) / max(1, (high - low + 1) // many)).cast("long")
    else:
        chunk = F.pmod(F.xxhash64("id"), F.lit(many))
    rows = rows.withColumn("chunk", F.when(F.col("id").isNull(), by_text).otherwise(chunk))
    large = rows.groupBy("chunk").agg(F.sum(F.octet_length("text")).alias("bytes")).where(F.col("bytes") > 4 * chunk_bytes).select("chunk", F.lit(True).alias("large"))
    found = large.count()
    if not found:
        return rows
    return rows.join(F.broadcast(large) if found <= MOST_BROADCAST else large, "chunk", "left").withColumn("chunk", F.when(F.col("large"), by_text).otherwise(F.col("chunk"))).drop("large")


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gibbs: int = GIBBS, sweeps: int = SWEEPS, chunk_bytes: int = CHUNK_BYTES, part: int = PART, heavy: int = HEAVY) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs; ids are whole numbers.

    Tokens are the ASCII-lower-cased runs without ASCII white space and then one end; a null text is empty and has the end alone.
    Learns from documents whose crc32 of the id as text, modulo 5, is not 1; those with a null id are neither learned from nor
    held out. Repeated rows each count and stay. If nothing can be learned from, every token is unknown. An empty table gives no rows.
    Scores are the same however the rows are partitioned.
    """
    held = crc_mod(F.col(id_col), 5)
    rows = need(docs, id_col, text_col).select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(held == 1, F.lit(False)).alias("held_out"), F.coalesce(held != 1, F.lit(False)).alias("train"),
    )
    rows = _chunked(rows, chunk_bytes)
    store = Store(docs.sparkSession)
    counted, _ = store.put(need(rows, "chunk", "text", "train").mapInArrow(_count, "chunk long, word long, c long"))
    first, firsts = store.put(counted.where("c > 0").groupBy("word").agg(F.sum("c").alias("c")))
    n, types = first.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    frequent = Top(first.select("word", "c").orderBy(F.desc("c"), "word").limit(TOP).toArrow(), heavy)
    top, parts = docs.sparkSession.sparkContext.broadcast(frequent), n // part + 1
    sent = need(rows, "chunk", "text", "train").groupBy("chunk").applyInArrow(_pairs(top, parts), SENT)
    merged, merges = store.put(sent.groupBy("part").applyInArrow(_merged(top), MERGED))
    summed = lambda df, *names: df.select(F.explode(F.arrays_zip(*names)).alias("x")).groupBy(F.col(f"x.{names[0]}").alias("word")).agg(F.sum(f"x.{names[1]}").alias("t"), F.sum(f"x.{names[2]}").alias("own"))
    stay = summed(merged.where("chunk is null"), "stay", "stay_t", "stay_own").withColumnsRenamed({"t": "stay_t", "own": "stay_own"})
    known, knowns = store.put(first.join(stay, "word", "left").select("word", "c", F.coalesce("stay_t", F.lit(0)).alias("stay_t"), F.coalesce("stay_own", F.lit(0)).alias("stay_own")))
    store.discard(firsts)
    pairs, seats_path, corpus_path = merged.where("chunk is null").select("part", "words", "u", "w", "c", "single", "here"), None, None
    shares = known.select("word", F.col("c").alias("n"), (F.col("c") / F.lit(float(max(1, n)))).alias("share"), F.lit(0).cast("long").alias("tables"))
    for done in range(ROUNDS):
        # Spark doesn't see how many words a part has, so that these aren't left to its sizes.
        theirs = pairs.select(F.col("part").alias("of"), F.explode("words").alias("word")).join(shares.where("n > 1").hint("merge"), "word")
        before = seats_path, corpus_path
        seats, seats_path = store.put(pairs.groupBy("part").cogroup(theirs.groupBy("of")).applyInArrow(_seat(parts, heavy, CONTEXT, gibbs, done), SEATED))
        pairs = seats
        tables = summed(seats, "words", "t_word", "own")
        corpus, corpus_path = store.put(known.join(tables, "word", "left").select("word", "c", (F.col("stay_t") + F.coalesce("t", F.lit(0))).alias("t"), (F.col("stay_own") + F.coalesce("own", F.lit(0))).alias("own")))
        for path in filter(None, before):
            store.discard(path)
        customers, alone = corpus.agg(F.coalesce(F.sum("t"), F.lit(0)), F.count_if(F.col("t") == 1)).first()
        taken = [float(types)]
        for _ in range(sweeps):
            s = corpus.where("t > 1").mapInArrow(_swept(taken, types, CORPUS), "s double")
            taken.append(alone + float(s.agg(F.coalesce(F.sum("s"), F.lit(0.0))).first()[0]))
        # Words of one token are in no pair of several customers.
        asked = corpus if done == ROUNDS - 1 else corpus.where("c > 1")
        model = asked.mapInArrow(_shares(taken[:-1], types, CORPUS), "word long, c long, share double, own long")
        # The mass that the corpus leaves to its parent, shared evenly by the known words and the unknown one.
        kept = float(np.mean(taken[2:] or taken[1:]))
        left = (CORPUS + D * kept) / (CORPUS + customers) / (types + 1)
        shares = model.select("word", F.col("c").alias("n"), (F.col("share") / F.lit(float(CORPUS + customers)) + F.lit(left)).alias("share"), F.col("own").alias("tables"))
    answers, _ = store.put(merged.where("chunk is not null").select("part", "chunk", "many", "numbers").groupBy("part").cogroup(seats.select("part", "c", "t").groupBy("part")).applyInArrow(_answers, "chunk long, part long, found binary, further binary"))
    for path in (merges, knowns, seats_path):
        store.discard(path)
    replies = counted.select("chunk", "word").join(model, "word").select("chunk", "word", "c", "share", "own")
    total = float(n + 0.5 * (types + 1))

    def score(key, texts: pa.Table, found: pa.Table) -> pa.Table:
        is_answer = pa.compute.is_valid(texts.column("part"))
        of_pairs, texts = texts.filter(is_answer).select(["part", "found", "further"]).sort_by("part"), texts.filter(pa.compute.invert(is_answer))
        chunk = Chunk(as_bytes(texts.column("text")))
        words, order = np.unique(found.column("word").to_numpy().view(np.uint64), return_index=True)
        place = np.searchsorted(chunk.words, words)
        c, share, own = np.zeros(len(chunk.words)), np.full(len(chunk.words), left), np.zeros(len(chunk.words))
        c[place], own[place] = found.column("c").to_numpy()[order], found.column("own").to_numpy()[order]
        share[place] += found.column("share").to_numpy()[order] / (CORPUS + customers)
        part_of = chunk.parts(parts, top.value.heavy)
        order = np.argsort(part_of, kind="stable")
        seen = np.zeros(len(chunk.u))
        found_here = np.concatenate([_numbers(x, np.uint8) for x in of_pairs.column("found")]).astype(np.float64)
        found_here[found_here == FAR] = np.concatenate([_numbers(x) for x in of_pairs.column("further")])
        seen[order] = found_here
        p = (seen / 2 + (CONTEXT + D * own[chunk.u]) * share[chunk.w]) / (CONTEXT + c[chunk.u])
        sums = lambda x: np.add.reduceat(x, chunk.starts)
        return pa.table([
            texts.column("id"), texts.column("held_out"), pa.array(chunk.sizes), pa.array(sums((c > 0).astype(np.int64)[chunk.at])),
            pa.array(sums(np.log10((c + 0.5) / total)[chunk.at])), pa.array(sums(np.log10(p)[chunk.place])),
        ], names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    id_type = docs.schema[id_col].dataType.simpleString()
    # The answers go with the texts: rows of words are many, and an array column makes each of them dear.
    texts = need(rows, "chunk", "id", "held_out", "text").unionByName(answers.select("chunk", "part", "found", "further"), allowMissingColumns=True)
    done = texts.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(score, f"id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return done.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score")
