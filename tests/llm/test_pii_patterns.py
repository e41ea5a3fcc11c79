"""All kinds of base spans against a plain search by the stated patterns, and disclosing terms against plain counts."""

import math
import random
import re
from collections import Counter, defaultdict

from skillspark.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def searched(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}
            if good[kind]():
                out.append((kind, m.start(), m.end()))
    return out


def card(rng):
    digits = [rng.randrange(10) for _ in range(rng.choice([15, 15, 16, 17, 18]))]
    digits.append(next(d for d in range(10) if luhn(digits + [d])) if rng.random() < 0.8 else rng.randrange(10))
    return "".join(str(d) + rng.choice(["", "", " ", "-"]) for d in digits).rstrip(" -")


def test_all_kinds_equal_a_search():
    rng, found = random.Random(9), Counter()
    for _ in range(20_000):
        parts = []
        for _ in range(rng.randrange(6)):
            kind = rng.randrange(5)
            parts.append((
                lambda: card(rng), lambda: "+" + "".join(rng.choice("0123456789 ().-") for _ in range(rng.randrange(18))), lambda: ".".join(str(rng.randrange(300)) for _ in range(rng.choice([3, 4, 4, 5]))),
                lambda: rng.choice(["a.b@x.co", "@", "q@z", "é@x.org", "a@b@c.d"]), lambda: rng.choice(["word", "12", "é", "-", "4.5"]),
            )[kind]())
        text = rng.choice(["", " ", ", "]).join(parts)
        want = searched(text)
        assert pii.base_spans(text) == want, text
        found.update(k for k, _, _ in want)
    assert min(found[k] for k in PATTERNS) > 300, found


def test_terms_equal_plain_counts(spark):
    rng = random.Random(10)
    words = [f"w{k}" for k in range(3000)]
    entities = [f"user{k}@x.org" for k in range(12)]
    texts = []
    for k in range(200):
        row = [rng.choice(words) for _ in range(30)]
        if k % 3 == 0:
            row.insert(rng.randrange(len(row)), entities[rng.randrange(12)])
            row.insert(rng.randrange(len(row)), f"Name{k % 67}")
        texts.append(" ".join(row))
    n, n_e, n_t, n_et, near = len(texts), Counter(), Counter(), Counter(), {}
    for i, text in enumerate(texts):
        row = text.split()
        n_t.update({w.lower() for w in row if len(w) >= 3})
        here = defaultdict(set)
        for j, w in enumerate(row):
            if "@" in w:
                n_e[w] += 1
                for o in [*range(max(0, j - pii.WINDOW), j), *range(j + 1, min(len(row), j + 1 + pii.WINDOW))]:
                    if "@" not in row[o] and len(row[o]) >= 3:
                        here[w, row[o].lower()].add(o)
        n_et.update(here.keys())
        near[i] = here
    want = set()
    for i, here in near.items():
        row, place = texts[i].split(), 0
        starts = []
        for w in row:
            starts.append(place)
            place += len(w) + 1
        for (e, t), at in here.items():
            if math.log2(n * n_et[e, t] / (n_e[e] * n_t[t])) >= pii.ALPHA * math.log2(n / n_e[e]):
                want |= {(i, starts[o], starts[o] + len(row[o])) for o in at}
    rows = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r.doc_id, s.start, s.end) for r in rows for s in r.terms} == want and len(want) > 50
