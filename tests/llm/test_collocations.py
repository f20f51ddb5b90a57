import re
from collections import Counter

import numpy as np

from featsel.llm import collocations as co
from tests.llm.helpers import rows

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def brute(docs, longest=3, least=10, share=50, top=2000):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    found = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= least}
    out = {}
    for (lang, g), a in found.items():
        inside = any(lg == lang and len(x) > len(g) and 100 * b >= share * a and any(x[i : i + len(g)] == g for i in range(len(x))) for (lg, x), b in found.items())
        if not inside:
            score, k = min((1000000 * a * a // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g)))
            out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    return sorted((lang, r, p.decode(), -a, le, ri, n[lang], -s) for lang, v in out.items() for r, (s, a, p, le, ri) in enumerate(sorted(v)[:top], 1))


def test_against_brute_force_in_small_chunks(spark):
    rng = np.random.default_rng(2)
    words = ["the", "The", "cat", "sat", "Été", "on", "new", "york", " x", "city", "o'neil", "a-b"]
    ends = [" ", "  ", "\t", " ", ". ", ",", "\n", "\r\n", " \x0b", "!? "]
    text = lambda n: "".join(words[rng.choice(12, p=[0.2, 0.1, 0.1, 0.1, 0.05, 0.1, 0.1, 0.1, 0.05, 0.04, 0.03, 0.03])] + ends[rng.integers(10)] for _ in range(n))
    docs = [(lang, text(int(rng.integers(1, 60)))) for lang in ("en", "de", None, "und") for _ in range(25)]
    docs += [("en", None), ("en", ""), (None, " .,; "), ("en", text(700)), ("de", "new york city " * 40), ("de", "new york city " * 40), ("fr", "solo")]
    df = spark.createDataFrame([(lang, t, "x", 1) for lang, t in docs], "lang string, text string, phrase string, n int").repartition(3)
    for least, top, longest in ((4, 2000, 3), (2, 5, 4)):
        got = sorted(rows(co.collocations(df, longest=longest, least=least, top=top, chunk=40), *COLUMNS))
        assert got == brute(docs, longest=longest, least=least, top=top)
    assert got


def test_long_texts_are_cut_where_pieces_end(spark, monkeypatch):
    docs = [("en", "alpha beta gamma. delta alpha beta, " * 300_000), ("en", "one long piece " * 20)]
    df = spark.createDataFrame(docs, "lang string, text string")
    chunks = [(len(r["seq"]) // 4, r["words"]) for r in co._chunks(df.coalesce(1), 400_000).collect()]
    assert len(chunks) >= 2 and max(n for n, _ in chunks) < 2_500_000
    got = {p: (a, le, r, n, s) for _, _, p, a, le, r, n, s in rows(co.collocations(df), *COLUMNS)}
    assert got["alpha beta gamma"] == (300_000, 600_000, 300_000, 1_800_060, 500_000) and got["one long piece"][0] == 20


def test_empty_table(spark):
    assert co.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
