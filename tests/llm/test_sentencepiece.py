"""The transducers against the library, for vocabularies of both kinds that are put together here (none is trained)."""

import random

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from skillspark.llm import pieces, sentencepiece_fst

SYLLABLES = ["th", "he", "the", "in", "ing", "an", "and", "on", "er", "re", "at", "ti", "tion", "s", "es", "de", "la"]
CHARMAP = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()


def model(path, kind, byte_fallback, charsmap=False, own=()):
    rng, m = random.Random(5), pb.ModelProto()
    m.trainer_spec.model_type = kind
    m.trainer_spec.byte_fallback = byte_fallback
    m.normalizer_spec.add_dummy_prefix = True
    m.normalizer_spec.escape_whitespaces = True
    m.normalizer_spec.remove_extra_whitespaces = charsmap
    if charsmap:
        source = pb.ModelProto()
        source.ParseFromString(CHARMAP)
        m.normalizer_spec.precompiled_charsmap = source.normalizer_spec.precompiled_charsmap

    def add(piece, score, type_=1):
        m.pieces.add(piece=piece, score=score, type=type_)

    add("<unk>", 0, 2)
    for x in own:
        add(x, 0, 4)
    if byte_fallback:
        for b in range(256):
            add(f"<0x{b:02X}>", 0, 6)
    letters = list("abcdefghilnorst▁.-")
    words = ["▁" + x for x in SYLLABLES] + SYLLABLES[:1] + [x for x in SYLLABLES[1:] if len(x) > 1] + ["--", "---", "▁▁"]
    if kind == 1:
        for x in letters:
            add(x, -8 - rng.random())
        for x in words:
            if x not in letters:
                add(x, -3 - 4 * rng.random())
    else:  # merges by rank: each is made of two pieces that come before
        made, rank = set(letters), 0
        for x in sorted({p for w in words for p in {w[:i] for i in range(2, len(w) + 1)} | {w[i:] for i in range(len(w) - 1)}} - made, key=lambda x: (len(x), rng.random())):
            if any(x[:i] in made and x[i:] in made for i in range(1, len(x))):
                made.add(x)
                add(x, -rank)
                rank += 1
        for x in letters:
            add(x, -rank)
            rank += 1
    with open(path, "wb") as f:
        f.write(m.SerializeToString())
    return str(path)


def texts():
    rng = random.Random(6)
    out = ["", " ", "the", "thing", "-" * 9, "  the  thing  ", "ＴＨＥ the ﬁne ①", "İstanbul", "é té", "thing\n\nthe\tand", "<sep>the<sep2>and", "the <sep> and"]
    for _ in range(400):
        out.append("".join(rng.choice([*SYLLABLES, " ", " ", ".", "-", "é", "中", "ﬃ", "Ａ", " ", "\U0001f600", "<sep>", "zq", "\n"]) for _ in range(rng.randrange(25))))
    return [*out, "".join(rng.choice([*SYLLABLES, " ", "q"]) for _ in range(40_000)), "q" * 3000, "-" * 3000]


@pytest.mark.parametrize("kind", [1, 2])
@pytest.mark.parametrize("byte_fallback", [False, True])
@pytest.mark.parametrize("charsmap", [False, True])
@pytest.mark.parametrize("own", [(), ("<sep>", "<sep2>")])
def test_ids_and_texts_equal_the_library(tmp_path, kind, byte_fallback, charsmap, own):
    path = model(tmp_path / "m.model", kind, byte_fallback, charsmap, own)
    library, ours = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_fst.Transducer(pieces.load(path))
    rows = texts()
    for text, want, got in zip(rows, library.encode(rows), ours.encode(rows)):
        assert got == want, text[:80]
        assert ours.decode(got) == library.decode(want)


def test_paths_dont_depend_on_what_was_met_before(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts())] + [(0, None), (None, "the")], "doc_id long, text string")
    rows = [{(r.doc_id, r.n_ids, tuple(r.ids or ()), r.decoded, r.whole) for r in sentencepiece_fst.round_trip(df.repartition(n)).collect()} for n in (1, 7)]
    assert rows[0] == rows[1] and all(x[4] for x in rows[0] if x[3] is not None)
    kept, sentencepiece_fst.KEPT = sentencepiece_fst.KEPT, 10
    try:
        ours = sentencepiece_fst.Transducer(pieces.load())
        once = ours.encode(texts())
        assert [ours.encode([x])[0] for x in texts()] == once
    finally:
        sentencepiece_fst.KEPT = kept
