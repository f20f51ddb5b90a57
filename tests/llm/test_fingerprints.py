import hashlib
import random
import re
import unicodedata

from featsel.llm import fingerprints as f
from tests.llm.helpers import rows

COLS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def canon(t):
    t = unicodedata.normalize("NFC", t.lower().replace("ς", "σ"))
    return re.sub(r"[\s\x1c-\x1f\x85\xa0]+", " ", t).strip(" ")


def check(got, docs):
    """docs in descending order of doc_id, all different ids."""
    n = len(docs)
    want = {}
    for k, (i, t) in enumerate(docs):
        t, nxt = t or "", docs[(k + 1) % n][1] or ""
        c = len(t) // 3
        e = t[: len(t) - c] + nxt[:c]
        want[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), canon(t), canon(e), canon(nxt))
    assert len(got) == n
    name = {}
    for i, chars, sha, fp, ep, ne, nn in got:
        w = want[i]
        assert (chars, sha) == w[:2]
        for c, x in ((w[2], fp), (w[3], ep)):
            assert name.setdefault(c, x) == x
        assert ne == float(w[2] == w[3]) and nn == float(w[2] == w[4])
    assert len(set(name.values())) == len(name)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = sorted(rows(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text"), reverse=True)
    check(rows(f.query(spark, sf), *COLS), docs)


def test_normalisation(spark):
    r = random.Random(2)
    alphabet = [*"aAéÉeE", "́", "̧", "̣", "̈", "ü", "ﬀ", "Å", "각", "ᄀ", "ᅡ", "ᆨ", "가", "Ω", "ő", "ड़", "क", "़", " ", "\t", " ", "ß", "ς", "Σ", "ǰ", "ཱི", "日", "😀"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 14))) for _ in range(400)] + ["ệ", "ệ", "İ"]
    data = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for i, c in rows(data.select("i", f.canonical(f.F.col("t")).alias("c")), "i", "c"):
        assert c == canon(texts[i]), (texts[i].encode("unicode_escape"), c.encode("unicode_escape"), canon(texts[i]).encode("unicode_escape"))


def test_ranges_and_collisions(spark, monkeypatch):
    monkeypatch.setattr(f, "BLOCK_ROWS", 7)
    r = random.Random(5)
    docs = [(i * i, r.choice(["same text here", "SAME  text\nhere", "", "ab", "x" * 50]) if i % 3 else "t%d " % i * 9) for i in range(120)][::-1]
    data = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, h string").repartition(5)
    check(rows(f.fingerprints(data), *COLS), docs)
    check(rows(f.fingerprints(data, bits=2), *COLS), docs)  # 16 hashes: nearly all texts clash


def test_edge_cases(spark):
    schema = "doc_id long, text string"
    one = spark.createDataFrame([(5, "abcdef")], schema)
    check(rows(f.fingerprints(one), *COLS), [(5, "abcdef")])
    odd = spark.createDataFrame([(5, None), (5, None), (4, "abc"), (4, "abd"), (None, "abc"), (None, None), (3, "y" * 100_000)], schema)
    got = rows(f.fingerprints(odd), *COLS)
    assert sorted((str(g[0]), g[1]) for g in got) == sorted([("5", 0), ("5", 0), ("4", 3), ("4", 3), ("None", 3), ("None", 0), ("3", 100_000)])
    assert len({g[3] for g in got}) == 4
    assert f.fingerprints(odd.limit(0)).count() == 0
