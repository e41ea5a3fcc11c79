"""Each operator against a brute-force version, and on nulls, empty and repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from skillspark.llm import decontaminate, hpyp, langid, pieces, pii, sentencepiece_fst, simhash, substring, token_counts, topk, warc

WORDS = ["alpha", "beta", "gamma", "delta", "eins", "zwei", "drei", "le", "la", "les", "maison", "être", "niño", "x1", "Z9"]
DOCS = "doc_id long, text string, lang string, id long, key string, h long, fp long, words string, row string"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """With columns whose names the operators use inside."""
    base = prose(1, 120)
    texts = [(1, base), (2, base + " end"), (3, prose(2, 90) + " " + base), (4, None), (5, ""), (6, " \t\n"), (7, "one"), (7, "one"), (None, base), (8, prose(3, 3000)), (9, prose(3, 3000).upper()), (10, "two words")]
    return spark.createDataFrame([(i, t, "en" if k % 2 else "de", k, "k", k, k, "w", "r") for k, (i, t) in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def brute_components(rows, most=3):
    parent = list(range(len(rows)))

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    fps = [int(r["fingerprint"], 16) for r in rows]
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            least[root(i)] = min(least.get(root(i), r["doc_id"]), r["doc_id"])
    return [least.get(root(i)) for i in range(len(rows))]


def test_fingerprint_follows_its_definition(spark, docs):
    import xxhash

    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    texts = collections.defaultdict(set)
    for r in docs.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate({i: i + 32 for i in range(65, 91)}))
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 3 else [" ".join(words)] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fp = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
        texts[r.doc_id].add(f"{fp:016x}")
    assert all(r.fingerprint in texts[r.doc_id] for r in rows)
    assert [r.component_id for r in rows] == brute_components(rows)


def test_golay_keys_lose_no_pair_within_three_bits():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, rng.integers(0, 4), replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    at, key, stored = simhash.keys_of(x)
    held = collections.defaultdict(set)
    for i, k, s in zip(at, key, stored):
        if s:
            held[i].add(k)
    at, key, stored = simhash.keys_of(y)
    met = {i for i, k, s in zip(at, key, stored) if not s and k in held[i]}
    assert met == set(range(300))


def test_components_of_hot_keys_are_whole(spark, monkeypatch):
    monkeypatch.setattr(simhash, "FEW", 4)
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = random.Random(3)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    centre = rng.getrandbits(64)
    fps = {signed(x) for x in [centre, *(centre ^ (1 << rng.randrange(64)) ^ (1 << 63) * (i % 2) for i in range(60)), *(rng.getrandbits(64) for _ in range(40))]}
    rows = [{"doc_id": f, "fingerprint": f"{f % (1 << 64):x}"} for f in sorted(fps)]
    roots = {r.node: r.root for r in simhash.components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))).collect()}
    assert [roots.get(r["doc_id"], r["doc_id"]) for r in rows] == brute_components(rows)


def test_near_duplicates_of_an_empty_table(none):
    assert simhash.near_duplicates(none).collect() == []
    assert simhash.drop_near_duplicates(none).collect() == []


def test_near_copies_fall_to_the_smallest_id(spark, docs):
    base = prose(5, 200).split()
    near = " ".join(base[:100] + ["changed"] + base[101:])
    df = spark.createDataFrame([(3, " ".join(base)), (2, near), (1, prose(6, 200)), (4, None), (5, " ")], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(df).collect()) == [1, 2, 4, 5]
    kept = simhash.drop_near_duplicates(docs).collect()
    assert {4, 5, 6, None} <= {r.doc_id for r in kept} and sum(r.doc_id == 7 for r in kept) == 1


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.normal(size=8) * rng.choice([0.1, 1, 3])]) for i in range(260)]
    vectors += [(260, vectors[3][1]), (261, vectors[3][1]), (300, None), (301, [1.0, float("nan")] + [0.0] * 6), (302, []), (350, [0.0] * 8), (351, [1.0, 2.0]), (400, [2.0, 1.0]), (None, vectors[0][1])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").selectExpr("vec_id", "embedding", "1 as q", "2 as norm", "3 as id")
    q = {i: np.floor(256 * np.array(x)).astype(int) for i, x in vectors if i is not None and x and all(math.isfinite(y) for y in x)}
    want = []
    for a in (i for i in q if i % 50 == 0):
        best = sorted((-int(q[a] @ q[b]), b) for b in q if b != a and len(q[b]) == len(q[a]))[:5]
        want += [(a, k + 1, b, -s) for k, (s, b) in enumerate(best)]
    for block, queries in ((4096, 512), (20, 2)):
        assert sorted(map(tuple, topk.top_k(df, block=block, queries=queries).collect())) == sorted(want)
    assert topk.top_k(df.limit(0)).collect() == []


def test_warc_round_trip(spark):
    same = "<p>" + "same " * 40
    pages = [(1, "http://a/1", "<html>é</html>"), (2, "http://a/2", same), (3, "http://a/3\r\nX: 1", same), (4, None, None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (None, "u", same)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as payload", "3 as first")
    got = {r.page_id: tuple(r) for r in warc.round_trip(df).collect()}
    sha = lambda x: hashlib.sha256((x or "").encode()).hexdigest()
    for i, _, html in pages:
        revisit = html == same and i != 2
        assert got[i] == (i, len((html or "").encode()), sha(html), "revisit" if revisit else "response", 2 if revisit else None)
    assert warc.round_trip(df.limit(0)).collect() == []


def test_warc_faults_are_found(spark, tmp_path):
    data = warc.record(1, "u", b"x" * 50, hashlib.sha256(b"x" * 50).hexdigest(), "response", None)
    assert warc.parse(data)["payload"] == b"x" * 50
    for bad in (data[:-1], data.replace(b"WARC/1.1", b"WARC/9"), data.replace(b"x", b"y", 1), data.replace(b"WARC-Type", b"Type")):
        with pytest.raises(warc.Broken):
            warc.parse(bad)
    import zstandard

    frame = zstandard.ZstdCompressor().compress(data)
    assert warc.split_frames(frame + warc.SEPARATOR + frame) == (None, [frame, frame])
    with pytest.raises(warc.Broken):
        warc.split_frames(frame[:-3])


def test_language_of_held_out_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = langid.identify(df, keep=("lang", "n_chars")).collect()
    assert len(rows) == df.count() and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and r.n_chars > 100]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)


def test_language_edges(docs, none):
    rows = langid.identify(docs).collect()
    assert {(r.lang_pred, r.score) for r in rows if r.doc_id in (4, 5, 6)} == {("und", 0.0)}
    assert {r.lang_pred for r in rows if r.doc_id in (1, 8)} <= {"en", "de"}
    assert langid.identify(none).collect() == []
    assert {r.lang_pred for r in langid.predict(docs, {}).collect()} == {"und"}


def test_token_counts_equal_a_plain_search(docs, none):
    v = pieces.load()

    def plain(word):
        best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
        for end in range(1, len(word) + 1):
            for start in range(end):
                w = v.weights.get(word[start:end])
                if w is not None and best[start][0] + w > best[end][0]:
                    best[end] = best[start][0] + w, best[start][1] + 1
            if word[end - 1] not in v.weights and best[end - 1][0] + v.unknown_weight > best[end][0]:
                best[end] = best[end - 1][0] + v.unknown_weight, best[end - 1][1] + len(word[end - 1].encode())
        return best[-1][1]

    for r in token_counts.count_tokens(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        assert (r.n_words, r.n_tokens) == (len(words), sum(plain("▁" + w) for w in words))
    assert list(token_counts.terminal_counts(["▁日本\U00010330x"], v))[0][1] == plain("▁日本\U00010330x")
    assert token_counts.count_tokens(docs).count() == docs.count() and token_counts.count_tokens(none).collect() == []


def brute_repeats(texts, n):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = collections.Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


@pytest.mark.parametrize("hot", [10_000, 1])
def test_repeated_passages(spark, docs, none, hot):
    rng = random.Random(4)
    passage = prose(11, 50).split()
    texts = [" ".join(prose(20 + i, rng.randrange(60)).split() + passage[rng.randrange(10) : 36 + rng.randrange(14)] + prose(60 + i, 20).split()) for i in range(25)]
    texts += [r.text for r in docs.collect()] + [" ".join(["la"] * 80)]
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in enumerate(texts)], "doc_id long, text string, k1 int, places int")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(df, hot=hot).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, 35)
    assert substring.remove_repeats(none).collect() == []
    assert substring.remove_repeats(docs).count() == docs.count()


def test_factors_are_greedy():
    starts = np.array([0, 1, 2, 3, 10])
    refs = np.array([[100, 500], [101, 501], [900, 502], [901, 700], [5, 6]])
    assert substring.factors(starts, refs, 4) == [(0, 6, 500), (3, 4, 901), (10, 4, 5)]


def test_sentencepiece_equals_the_library(spark, docs, none):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    rng = random.Random(7)
    odd = ["".join(rng.choice(" ab中é\n\r\t▁€\U0001f600theing.,;'") for _ in range(rng.randrange(50))) for _ in range(300)]
    df = docs.select("doc_id", "text", "lang", "row").unionByName(spark.createDataFrame([(100 + i, t, "x", "y") for i, t in enumerate(odd)], "doc_id long, text string, lang string, row string"))
    rows = sentencepiece_fst.decode(sentencepiece_fst.encode(df)).collect()
    assert len(rows) == df.count()
    for r in rows:
        if r.text is None:
            assert r.ids is None and r.decoded is None
        else:
            assert r.ids == library.encode(r.text) and r.decoded == library.decode(r.ids)
    trip = sentencepiece_fst.round_trip(df).collect()
    assert all(r.whole for r in trip if r.ids is not None)
    assert sentencepiece_fst.encode(none).collect() == []


def test_scores_of_the_model(spark, docs, none):
    df = spark.createDataFrame([(i, prose(200 + i, 80)) for i in range(60)] + [(60, None), (61, ""), (None, prose(201, 80)), (3, prose(203, 80))], "doc_id long, text string").selectExpr("*", "1 as id", "2 as chunk")
    rows = hpyp.scores(df, chunk_bytes=2000).collect()
    assert len(rows) == df.count()
    texts = collections.defaultdict(list)
    counts = collections.Counter()
    for r in df.collect():
        tokens = (r.text or "").lower().split() + ["\n"]
        texts[r.doc_id].append(tokens)
        if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 != 1:
            counts.update(tokens)
    n, types = sum(counts.values()), len(counts)
    for r in rows:
        tokens = texts[r.doc_id][0]
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (types + 1))) for t in tokens)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(counts[t] > 0 for t in tokens), n)
        assert r.base_score == pytest.approx(base) and r.score < 0 and math.isfinite(r.score)
    assert hpyp.scores(none).collect() == []
    assert hpyp.scores(docs).count() == docs.count()


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def test_patterns_equal_a_search():
    rng = random.Random(5)
    for _ in range(20_000):
        t = "".join(rng.choice("a1.@-+ é") for _ in range(rng.randrange(20)))
        assert list(pii.emails(t)) == [m.span() for m in EMAIL.finditer(t)]
        assert [m.span() for m in pii._IP.finditer(t)] == [m.span() for m in IP.finditer(t)]
    text = "é a@b.co 300.1.1.1, 10.0.0.1, 4111 1111 1111 1111, 4111111111111112, +1 (555) 123-4567, +12"
    assert [(k, text[a:b]) for k, a, b in pii.base_spans(text)] == [("email", "a@b.co"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 123-4567")]


def test_disclosing_terms(spark, docs, none):
    rows = [(i, f"{prose(300 + i, 20)} Zorblax42 writes to zor@x.org about {prose(400 + i, 20)}") for i in range(6)] + [(50 + i, prose(500 + i, 60)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as base", "1 as n", "2 as spans")
    found = {r.doc_id: r for r in pii.find(df).collect()}
    texts = dict(rows)
    for i in range(6):
        named = {texts[i][s.start : s.end] for s in found[i].terms}
        assert "Zorblax42" in named and [texts[i][s.start : s.end] for s in found[i].base] == ["zor@x.org"]
    assert all(not r.terms and not r.base for i, r in found.items() if i >= 50)
    clean = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert "[EMAIL]" in clean[0].text and "zor@x.org" not in clean[0].text and "Zorblax" not in clean[0].text
    assert all(clean[i].text == texts[i] for i in clean if i >= 50) and clean[0].spans == 2
    assert pii.find(none).collect() == [] and pii.find(docs).count() == docs.count() == pii.sanitise(docs).count()
    assert {r.text for r in pii.sanitise(docs).where("doc_id = 4").collect()} == {None}


def test_reparameterised_questions_are_caught(spark, docs, none):
    ask = "If a train with {} leaves at {} km per hour and {} walks {} miles then how far do they go?"
    rows = [(1, "Well. " + ask.format("Alice", 45, "Bob", 3) + " Answer it."), (2, ask.format("Zed", 5, "Yan", 5)), (3, prose(9, 100)), (4, None), (5, ""), (6, ask.format("Zed", 5, "Yan", 9)), (None, ask.format("Zed", 5, "Yan", 9))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as pos", "3 as item")
    bench = spark.createDataFrame([(9, ask.format("Zed", 5, "Yan", 9)), (10, None), (11, ""), (None, prose(9, 100)), (12, "tiny one")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_windows, r.n_exact) for r in decontaminate.contaminated(df, bench).collect()}
    assert {k[0] for k in got} == {1, 2, 6} and {k[1] for k in got} == {9}
    assert got[1, 9][1] == 0 and got[6, 9][0] == got[6, 9][1] >= got[2, 9][0]
    assert sorted(str(r.doc_id) for r in decontaminate.drop_contaminated(df, bench).collect()) == ["3", "4", "5", "None"]
    meet = "so when {} meets {} again near the bridge all is well"
    df = spark.createDataFrame([(1, meet.format("Bob", "Bob")), (2, meet.format("Bob", "Cid"))], "doc_id long, text string")
    same = {r.doc_id: r.n_windows for r in decontaminate.contaminated(df, spark.createDataFrame([(1, meet.format("Ann", "Ann"))], "item_id long, text string")).collect()}
    assert same[1] > same[2]  # windows with both names of the second don't correspond
    assert decontaminate.contaminated(none, bench).collect() == [] and decontaminate.contaminated(docs, bench.limit(0)).collect() == []
