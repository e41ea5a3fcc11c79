"""Near copies against all pairs of shingle sets, by length of text and kind of edit."""

import random

from skillspark.llm import simhash


def shingles(text, width=5):
    words = text.lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def brute_groups(texts, similarity=0.8):
    """The smallest place of each text's group."""
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, x in enumerate(sets):
        for j in range(i):
            shared = len(x & sets[j])
            if shared >= similarity * (len(x) + len(sets[j]) - shared) - 1e-9:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in range(len(texts))}


def groups(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    return {r.doc_id: r.component_id for r in simhash.near_copies(df).collect()}


def prose(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def edited():
    """Originals of four lengths, each cut, appended and changed by several shares."""
    rng, texts = random.Random(11), []
    for n in (40, 100, 300, 900):
        for _ in range(12):
            base = prose(rng, n)
            texts.append(base)
            texts += [base[: n - n * k // 100] for k in (10, 17, 25)]
            texts += [base + prose(rng, n * k // 100) for k in (15, 22, 30)]
            for k in (1, 2, 4):
                changed = base.copy()
                for i in rng.sample(range(n), max(1, n * k // 100)):
                    changed[i] = f"c{rng.randrange(3000)}"
                texts.append(changed)
    rng.shuffle(texts)
    return [" ".join(t) for t in texts]


def test_cut_appended_and_changed_copies_of_all_lengths_are_found(spark):
    texts = edited()
    assert groups(spark, texts) == brute_groups(texts)


def test_copies_among_hundreds_of_tables_with_one_dominant_word(spark):
    rng, texts = random.Random(12), []
    for k in range(300):
        row = [w for _ in range(40) for w in ("|", f"n{rng.randrange(200)}", "|")]
        texts.append(row)
        if k % 10 == 0:  # a copy with its last rows cut, and one with rows in another order
            texts.append(row[: len(row) * 9 // 10])
            texts.append(row[60:] + row[:60])
    rng.shuffle(texts)
    texts = [" ".join(t) for t in texts]
    want = brute_groups(texts)
    assert groups(spark, texts) == want and len(set(want.values())) < len(texts) - 50


def test_pairs_just_below_the_similarity_are_kept_and_pairs_at_it_are_not(spark, sf_dir):
    rng, texts = random.Random(13), []
    for _ in range(60):
        base = prose(rng, 84)  # 80 shingles
        texts += [base, base[: rng.randrange(60, 76)]]  # 56 to 71 of them: similarities of 0.7 to 0.89
    texts = [" ".join(t) for t in texts]
    want = brute_groups(texts)
    assert groups(spark, texts) == want and 0 < len(texts) - len(set(want.values())) < 60
    kept = simhash.drop_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == set(want.values())
