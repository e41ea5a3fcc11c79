"""Terms that reveal an entity of one or two texts, or of many copies of one."""

import random

from pyspark.sql import functions as F

from skillspark.llm import pii


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(f"word{rng.randrange(40)}" for _ in range(n))


def test_entities_of_one_text_two_texts_and_copies_have_terms(spark):
    rows = [(1, f"{prose(1, 20)} Quillon writes to one@x.org {prose(2, 20)}")]
    rows += [(2 + i, f"{prose(3 + i, 20)} Marwick writes to two@x.org {prose(5 + i, 20)}") for i in range(2)]
    rows += [(10 + i, f"{prose(7, 20)} Ostrander writes to many@x.org {prose(8, 20)}") for i in range(5)]
    rows += [(100 + i, prose(100 + i, 60)) for i in range(100)]
    df, texts = spark.createDataFrame(rows, "doc_id long, text string"), dict(rows)
    found = {r.doc_id: {texts[r.doc_id][s.start : s.end] for s in r.terms} for r in pii.find(df).collect()}
    names = {1: "Quillon", 2: "Marwick", 3: "Marwick", **{10 + i: "Ostrander" for i in range(5)}}
    assert all(name in found[i] for i, name in names.items())
    assert not any(t.startswith("word") for terms in found.values() for t in terms)  # words of most documents tell nothing
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert all(name not in clean[i] for i, name in names.items()) and all(clean[i] == texts[i] for i in texts if i >= 100)


def test_terms_are_found_in_the_tables(spark):
    found = pii.find(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    counts = found.agg(F.count_if(F.size("terms") > 0).alias("with_terms"), F.sum(F.size("terms")).alias("terms"), F.count_if(F.size("base") > 0).alias("with_base"), F.count_if((F.size("base") == 0) & (F.size("terms") > 0)).alias("alone")).first()
    print(counts)
    assert counts.terms > 0 and counts.with_terms <= counts.with_base and counts.alone == 0


def terms_of(spark, rows):
    df, texts = spark.createDataFrame(rows, "doc_id long, text string"), {}
    for i, t in rows:
        texts[i] = t
    return {r.doc_id: {texts[r.doc_id][s.start : s.end] for s in r.terms} for r in pii.find(df).collect()}


def test_repeated_rows_and_copies_change_nothing(spark):
    """A text says the same ten times as once, under one id or under several."""
    rest = [(100 + i, prose(100 + i, 60)) for i in range(100)]
    text = f"{prose(1, 20)} Quillon writes to one@x.org {prose(2, 20)}"
    once = terms_of(spark, [(1, text), *rest])
    assert "Quillon" in once[1]
    assert terms_of(spark, [(1, text)] * 10 + rest)[1] == once[1]
    assert all(x == once[1] for i, x in terms_of(spark, [(i, text) for i in range(10)] + rest).items() if i < 10)


def test_chance_neighbours_are_left_alone(spark):
    """Of 3,000 texts with unrelated words and an address each, next to none loses a word; a word that keeps an address company does go."""
    rng = random.Random(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}" for i in range(30_000)]
    weights = [1 / (i + 1) for i in range(len(words))]
    draw = lambda n: " ".join(rng.choices(words, weights, k=n))
    rows = [(i, f"{draw(20)} user{i}@mail.example.org {draw(20)}") for i in range(3000)]
    rows += [(5000 + i, f"{draw(20)} zyzzyva wrote from boss@corp.example.org {draw(20)}") for i in range(3)]
    found = terms_of(spark, rows)
    assert sum(bool(found[i]) for i in range(3000)) < 30
    assert all("zyzzyva" in found[5000 + i] for i in range(3))
