import sys

from featsel.llm import fingerprints as f
from tests.llm.helpers import rows


def test_every_character_folds(spark):
    chars = [c for c in map(chr, range(1, sys.maxunicode + 1)) if not 0xD800 <= ord(c) < 0xE000 and (c.lower() != c or c.casefold() != c)]
    data = spark.createDataFrame([(i, f"{c}x") for i, c in enumerate(chars)], "i int, t string")
    got = dict(rows(data.select("i", f.folded(f.F.col("t")).alias("t")), "i", "t"))
    # the running Java may know other versions of a few scripts than the running Python
    bad = [hex(ord(c)) for i, c in enumerate(chars) if got[i] != f"{c}x".casefold()]
    assert len(bad) <= 0.01 * len(chars), bad


def test_copies_that_differ_in_case_only(spark):
    pairs = [("Straße im  Tal", "STRASSE IM TAL"), ("ﬁne ﬂow", "FINE FLOW"), ("ὈΔΥΣΣΕΎΣ", "ὀδυσσεύς"), ("oﬀ ſo", "OFF SO"), ("5 µm", "5 μm"), ("ŉ ǰ", "ʼN J̌")]
    data = spark.createDataFrame([(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)] + [(99, None)], "doc_id long, text string")
    got = dict(rows(f.fingerprints(data), "doc_id", "fingerprint"))
    assert all(got[2 * i] == got[2 * i + 1] for i in range(len(pairs))) and len(set(got.values())) == len(pairs) + 1


def test_marks_in_any_order(spark):
    import random
    import unicodedata

    r = random.Random(6)
    marks = ["ͅ", "́", "̣", "̀", "̈", "̧", "̓", "⃐", "़"]
    bases = ["α", "ᾳ", "Ω", "ᾼ", "e", "Å", "ß", "İ", "가", "ﬁ", "ᾴ", "ı", "Σ"]
    texts = ["".join(r.choice(bases) + "".join(r.choice(marks) for _ in range(r.randint(0, 4))) for _ in range(r.randint(1, 5))) for _ in range(400)]
    texts += ["ᾴ", "ᾴ", "́ͅx"]
    data = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = dict(rows(data.select("i", f.canonical(f.folded(f.F.col("t"))).alias("t")), "i", "t"))
    want = [unicodedata.normalize("NFC", unicodedata.normalize("NFD", t).casefold()) for t in texts]
    assert [(t, got[i]) for i, t in enumerate(texts) if got[i] != want[i]] == []
