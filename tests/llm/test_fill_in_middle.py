"""Fill-in-middle against regular expressions and plain slices, and exact round trips."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from skillspark.llm import fill_in_middle
from skillspark.llm.fill_in_middle import SkipList, line_widths

SCHEMA = "doc_id long, text string, id string, n string, form long, output long"


def plain(i, text, rate=100):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digits = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digits[8 * x : 8 * x + 8], 16) for x in range(4)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return i, len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 50:
        return i, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def made(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "i", "n", 1, 2) for i, t in rows], SCHEMA)
    out = fill_in_middle.transform(df, **options)
    return out.withColumn("restored", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()


def texts(seed, n):
    rng = random.Random(seed)
    letters = ["a", "é", "日", "😀", "\n", "\n", "\r", " ", "\x0b", "<", "S", "P>", "<M", ">", " ", "\t"]
    return [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(120)))) for i in range(n)]


def test_equals_plain_slices(spark):
    rows = [*texts(0, 400), (1000, None), (1001, ""), (1002, "\n"), (1003, "\n\n"), (1004, "one"), (1004, "one"), (None, "a\nb\nc"), (None, None), (1005, "x<P>y"), (1006, "<S>"), (1007, "\nq<M>\n"), (1008, "<\nP>\n<S\n>")]
    got = made(spark, rows)
    want = [plain(*r) for r in rows]
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted(want, key=repr)
    assert sorted((r.doc_id, r.restored) for r in got if r.doc_id is not None) == sorted((i, t or "") for i, t in rows if i is not None)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_rates(spark):
    rows = texts(1, 200)
    assert sorted(tuple(r)[:6] for r in made(spark, rows, rate=30)) == sorted(plain(*r, rate=30) for r in rows)
    assert {r.form for r in made(spark, rows, rate=0)} == {"plain"}


def test_empty_table(spark):
    assert made(spark, []) == []


def test_very_long_texts(spark):
    rows = [(1, "line é\n" * 200_000), (2, "z" * 3_000_000), (3, "\n" * 100_001 + "end")]
    assert sorted(tuple(r)[:6] for r in made(spark, rows)) == sorted(plain(*r) for r in rows)


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 255, 256, 257, 5000])
def test_every_rank_is_reached_by_the_lanes(n):
    rng = random.Random(n)
    units = ["é" * rng.randrange(5) + "\n" for _ in range(n)]
    widths = line_widths("".join(units).encode())
    lanes = SkipList.of(widths)
    assert all(lane.sum(axis=0).tolist() == widths.sum(axis=0).tolist() for lane in lanes.lanes)
    assert len(lanes.lanes[-1]) <= fill_in_middle.STRIDE
    for rank in {*range(min(n, 300) + 1), n}:
        before = "".join(units[:rank])
        assert lanes.place(rank) == (len(before), len(before.encode()))
