"""Personal data: patterns, and terms that reveal it by co-occurrence.

Protected entities are the values that the patterns find (an address, a number). Over all documents,
IC(e) = log2(N / n_e) is what naming the entity e tells, and PMI(e; t) = log2(N n_et / (n_e n_t)) what seeing the
term t near it tells about e; n are distinct texts, so that a text says the same however often it is repeated. A term within `window` words of e
discloses it if PMI reaches the share `alpha` of IC, which for an entity of one text asks for a term of at most N ** (1 - alpha) texts, and if there is
evidence of `support`: a text with both counts one, and one more if it writes the term as a name or with a digit. So by default a rare word that chance has put beside an entity once
isn't flagged, a name is, and so is a word that stands beside it in two texts. Its occurrences near e are
spans too: numbers and names are generalised to a placeholder, other words are removed.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, need, slices, small_batches
from .simhash import MAP_BITS, _wanted

KINDS = ("email", "ip", "card", "phone", "term")
ALPHA, SUPPORT, WINDOW = 0.8, 2, 8
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Stripped from both ends of a word to get its term.
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_EDGE_BYTES = _EDGE.encode()


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ back over the local part and on over the domain: linear in the text, with the result of a left-to-right search."""
    pos, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > pos and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            pos = m.end()
        at = text.find("@", m.end() if m else at + 1)


def luhn(digits: str) -> bool:
    double = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return sum(double[int(d)] if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as in KINDS, then start; code points."""
    out = [("email", a, b) for a, b in emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def _term(word: bytes) -> bytes:
    return word.lower().strip(_EDGE_BYTES)


def _near(text: str, spans: list[tuple[str, int, int]], window: int) -> list[dict]:
    """The words within `window` words before and after each span, outside all spans."""
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    starts = [a for a, _ in words]
    from bisect import bisect_left, bisect_right

    ordered = sorted((a, b) for _, a, b in spans)
    out = []
    for kind, a, b in spans:
        value = text[a:b] if kind in ("email", "ip") else "".join(c for c in text[a:b] if c.isdigit())
        entity = xxhash.xxh64_intdigest(f"{kind}:{value.lower()}") - (1 << 63)
        left, right = bisect_right(starts, a) - 1, bisect_left(starts, b)
        for i in [*range(max(0, left - window), left), *range(right, min(len(words), right + window))]:
            x, y = words[i]
            j = bisect_left(ordered, (y, 0)) - 1
            if j >= 0 and any(p < y and q > x for p, q in ordered[max(0, j - 3) : j + 1]):
                continue
            raw = text[x:y]
            core = raw.strip(_EDGE)
            term = _term(raw.encode())
            if len(term) >= 3:
                x += raw.index(core) if core else 0
                out.append({"entity": entity, "term": xxhash.xxh64_intdigest(term) - (1 << 63), "start": x, "end": x + len(core), "cased": core[:1].isupper() or any(c.isdigit() for c in core)})
    return out


_NEAR = "array<struct<entity:long,term:long,start:int,end:int,cased:boolean>>"
_SPAN = "array<struct<kind:int,start:int,end:int>>"


def _scan(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near_kind = pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("cased", pa.bool_())]))
        span_kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in (x for big in batches for x in slices(big, "text", 4 << 20)):
            spans = [base_spans(x) if x else [] for x in batch.column("text").to_pylist()]
            near = [_near(batch.column("text")[i].as_py(), s, window) if s else [] for i, s in enumerate(spans)]
            rows = [[{"kind": KINDS.index(k), "start": a, "end": b} for k, a, b in s] for s in spans]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("k1"), batch.column("k2"), pa.array(rows, span_kind), pa.array(near, near_kind)], names=["id", "k1", "k2", "base", "near"])

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each term, summed over runs of documents before the shuffle."""

    def out() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array([xxhash.xxh64_intdigest(t) - (1 << 63) for t in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])
        seen.clear()
        return rows

    seen: Counter[bytes] = Counter()
    for batch in (x for big in batches for x in slices(big, "text", 4 << 20)):
        for text in as_bytes(batch.column(0)):
            if text:
                seen.update({t for t in {w.strip(_EDGE_BYTES) for w in set(text.lower().split())} if len(t) >= 3})
            if len(seen) > 300_000:
                yield out()
    yield out()


def _rows_in(marked, wanted: bool):
    """The rows (k2, text) whose key is, or isn't, on the map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(marked.value[batch.column(0).to_numpy() % MAP_BITS] == wanted))

    return run


def _term_counts(rows: DataFrame) -> DataFrame:
    """(term, n_t): in how many distinct texts each term is. rows: k2, text.

    Only texts that are there more than once, and a few others on the same bits of a map of fixed size, are sent to meet their repeats; all others are counted where they are.
    """
    again = rows.groupBy("k2").agg(F.count("*").alias("n")).where("n > 1").select(F.col("k2").alias("node"))
    marked = rows.sparkSession.sparkContext.broadcast(_wanted(again))

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _frequencies(x.select(["text"]) for x in _rows_in(marked, False)(batches))

    # The first row of each repeated text: most repeats go before anything is sent.
    first = rows.mapInArrow(_rows_in(marked, True), "k2 long, text string").dropDuplicates(["k2"]).select("text")
    counts = rows.mapInArrow(once, "term long, n long").unionByName(first.mapInArrow(_frequencies, "term long, n long"))
    return counts.groupBy("term").agg(F.sum("n").alias("n_t"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, support: int = SUPPORT, window: int = WINDOW) -> DataFrame:
    """(id, k1, k2, base, terms) for every row of docs: the patterns' spans and those of disclosing terms, in code points.

    Null texts count as empty and have no spans. Rows are told apart by id and text (k1 and k2 are their hashes);
    repeated rows each stay. Spans of one kind don't overlap, those of different kinds may.
    """
    small_batches(docs.sparkSession)
    rows = need(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(id_col, F.lit(7)).alias("k1"), F.xxhash64(text_col, F.lit(11)).alias("k2"))
    id_type = docs.schema[id_col].dataType.simpleString()
    base = cut(rows.mapInArrow(_scan(window), f"id {id_type}, k1 long, k2 long, base {_SPAN}, near {_NEAR}"))
    n = base.select("k2").distinct().count()
    near = base.where(F.size("near") > 0).select("k1", "k2", F.explode("near").alias("x")).select("k1", "k2", "x.*")
    both = near.groupBy("entity", "term", "k2").agg(F.max(F.col("cased").cast("int")).alias("cased"))
    pairs = both.groupBy("entity", "term").agg(F.count("*").alias("n_et"), F.sum(F.col("cased") + 1).alias("evidence"))
    pairs = cut(pairs.where(F.col("evidence") >= support).drop("evidence"))
    entities = near.groupBy("entity", "k2").agg(F.lit(1).alias("one")).groupBy("entity").agg(F.count("*").alias("n_e"))
    terms = _term_counts(need(rows.where("text is not null"), "k2", "text")).join(pairs.select("term").distinct(), "term", "left_semi")
    pmi = F.log2(F.lit(float(max(n, 1))) * F.col("n_et") / (F.col("n_e") * F.col("n_t")))
    flagged = pairs.join(entities, "entity").join(terms, "term").where(pmi >= alpha * F.log2(F.lit(float(max(n, 1))) / F.col("n_e"))).where(F.col("n_e") < n).select("entity", "term")
    hits = near.join(flagged, ["entity", "term"]).groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct(F.lit(KINDS.index("term")).alias("kind"), "start", "end"))).alias("terms"))
    return base.select("id", "k1", "k2", "base").join(hits, ["k1", "k2"], "left").select(F.col("id").alias(id_col), "k1", "k2", "base", F.coalesce("terms", F.array().cast(_SPAN)).alias("terms"))


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each span replaced; of overlapping spans the first in place, then in kind, names the union."""
    out, pos = [], 0
    merged: list[list[int]] = []
    for a, b, kind in sorted((a, b, kind) for kind, a, b in spans):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b, kind])
    for a, b, kind in merged:
        value = text[a:b]
        if KINDS[kind] != "term":
            new = f"[{KINDS[kind].upper()}]"
        else:
            new = "[NUMBER]" if any(c.isdigit() for c in value) else "[NAME]" if value[:1].isupper() else ""
        out += [text[pos:a], new]
        pos = b
    return "".join([*out, text[pos:]])


def _masked(text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            texts = big.column(0).field(text_col).cast(pa.string())
            for batch in slices(pa.RecordBatch.from_arrays([big.column(0), big.column(1), texts], names=["row", "spans", "text"]), "text", 4 << 20):
                out = [
                    x if x is None or not s else mask(x, [(y["kind"], y["start"], y["end"]) for y in s])
                    for x, s in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist())
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["row", "text"])

    return run


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with personal data and disclosing terms replaced in the text; all rows and columns stay, repeated ones too, null texts stay null. Whole texts are masked, however long."""
    found = find(docs, id_col, text_col, **how).select("k1", "k2", F.concat("base", "terms").alias("spans")).where(F.size("spans") > 0).dropDuplicates(["k1", "k2"])
    k1, k2 = F.xxhash64(id_col, F.lit(7)), F.xxhash64(text_col, F.lit(11))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), k1.alias("k1"), k2.alias("k2")).join(found, ["k1", "k2"], "left").select("row", "spans")
    out = rows.mapInArrow(_masked(text_col), f"row {rows.schema['row'].dataType.simpleString()}, text string")
    return out.select(*[(F.col("text") if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns])
