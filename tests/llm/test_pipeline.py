"""Stages on hard rows: nulls, empty and very long texts, repeated rows, clashing ids, further columns, empty tables; and cases planted for each stage."""

import random

import pytest

import corpus_pipeline
from skillspark.llm import decontaminate, langid, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, node string, row string"


def prose(seed, n, words=400):
    rng = random.Random(seed)
    return " ".join(rng.choice(("the", "river", "stone", "house")) + str(rng.randrange(words)) for _ in range(n))


@pytest.fixture(scope="module")
def item(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text


@pytest.fixture(scope="module")
def hard(spark, item):
    base = prose(1, 200)
    texts = [
        (1, base), (2, base + " end"), (3, base.upper()), (3, prose(2, 60)), (4, None), (5, ""), (6, " \t\n"), (7, "12 34"), (8, prose(3, 60)), (8, prose(3, 60)), (None, base), (None, base), (9, prose(4, 30_000)),
        (10, prose(5, 50) + ". " + item + " " + prose(6, 50)), (11, "write to ann.smith@example.org about " + prose(7, 40)), (12, "one"),
    ]
    return spark.createDataFrame([(i, t, None if k % 5 == 0 else "en", "s", len(t or ""), k, "n", "r") for k, (i, t) in enumerate(texts)], SCHEMA)


def test_each_stage_on_hard_rows(spark, sf_dir, hard, item):
    keys = lambda df: sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.id) for r in df.collect())
    docs = corpus_pipeline.language_id(spark, hard, sf_dir)
    assert docs.columns == hard.columns
    before, after = keys(hard), keys(docs)
    assert [x for x in before if any(c.isalpha() for c in x[2])] == after and all(r.lang for r in docs.collect())
    kept = corpus_pipeline.near_dedup(spark, hard, sf_dir)
    assert kept.columns == hard.columns
    rows = keys(kept)
    assert sorted(x[1] for x in rows if not x[0]) == [1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12]  # 2 and the upper-case 3 are copies of 1; the other 3 and one of 8 stay
    assert [x[2] for x in rows if x[1] == 3] == [prose(2, 60)] and sum(x[0] for x in rows) == 2
    clean = corpus_pipeline.decontamination(spark, hard, sf_dir)
    assert clean.columns == hard.columns and keys(clean) == [x for x in before if item not in x[2]]
    masked = corpus_pipeline.personal_data(spark, hard, sf_dir)
    assert masked.columns == hard.columns and masked.count() == hard.count()
    texts = {r.id: r.text for r in masked.collect()}
    assert texts[14].count("[EMAIL]") == 1 and "ann.smith" not in texts[14] and all(texts[r.id] == r.text for r in hard.collect() if r.id != 14)
    ids = {r.decoded_sha256 is None for r in corpus_pipeline.tokens(spark, hard.where("doc_id = 4"), sf_dir).collect()}
    assert ids == {True} and corpus_pipeline.tokens(spark, hard, sf_dir).count() == hard.count()


def test_empty_tables_stay_empty(spark, sf_dir, hard):
    docs = hard.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.collect() == [], name
    unknown = hard.withColumn("lang", hard.lang.substr(1, 0)).selectExpr("doc_id", "text", "nullif(lang, '') lang", "source", "n_chars")
    assert corpus_pipeline.language_id(spark, unknown, sf_dir).count() == hard.count()


def test_the_operators_agree_with_the_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
    groups = {}
    for r in simhash.near_copies(docs).collect():
        groups.setdefault(r.component_id, set()).add(r.doc_id)
    left = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    assert all(min(g) == k and g & left == {k} for k, g in groups.items())
    found = {r.doc_id for r in decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()} == {r.doc_id for r in docs.select("doc_id").collect()} - found


def test_whole_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and all(r.whole for r in rows) and len({r.doc_id for r in rows}) == len(rows)


def test_languages_of_documents_that_were_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    said = {r.doc_id: r for r in langid.identify(docs).collect()}
    held = [r for r in docs.withColumn("h", langid.held_out()).where("h and lang is not null and length(text) > 100").collect()]
    assert len(held) > 20 and sum(said[r.doc_id].lang_pred == r.lang for r in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in said.values())
