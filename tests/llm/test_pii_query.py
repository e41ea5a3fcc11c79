"""The columns of op9_pii against a plain search, on texts with several spans of a kind, of all kinds, and of none."""

import hashlib
import random
from collections import Counter

from skillspark.llm.queries import op9_pii

from .test_pii_patterns import card, searched

KINDS = ("email", "ip", "card", "phone")


def _text(rng):
    kinds = {
        "email": lambda: rng.choice(["a.b@x.co", "q%1@y-z.org.uk", "é@x.org", "a@b.c@d.e"]), "ip": lambda: ".".join(str(rng.randrange(300)) for _ in range(4)), "card": lambda: card(rng),
        "phone": lambda: "+4" + "".join(rng.choice("0123456789 ()-") for _ in range(rng.randrange(6, 16))), "word": lambda: rng.choice(["word", "\U0001f600", "né", "12"]),
    }
    return rng.choice([", ", " \n", "; "]).join(kinds[rng.choice(list(kinds))]() for _ in range(rng.randrange(9)))


def test_columns_equal_a_search(spark, tmp_path):
    rng = random.Random(21)
    texts = [*(_text(rng) for _ in range(400)), None, "", "a@b.co c@d.co e@f.co", "1.2.3.4 5.6.7.8", "+1 234 567 890 and x@y.z"]
    rows = list(enumerate(texts)) + [(3, texts[3]), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    for i, text in rows:
        base = searched(text or "")
        named = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        want[i, *(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(named.encode()).hexdigest()] += 1
    found = op9_pii(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in found) == want
