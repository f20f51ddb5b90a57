import hashlib
import random
import re
from collections import Counter

import numpy as np

from featsel.llm import substring_dedup as s
from tests.llm.helpers import rows

W = 35


def brute(docs):
    words = [[w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for _, t in docs]
    n = Counter(tuple(w[i : i + W]) for w in words for i in range(len(w) - W + 1))
    out = []
    for (doc, _), w in zip(docs, words):
        gone = {i + k for i in range(len(w) - W + 1) if n[tuple(w[i : i + W])] > 1 for k in range(W)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def test_cover_and_hashes():
    cover = s.difference_cover(s.PERIOD)
    assert len(cover) == 5
    for i in range(21):
        for j in range(21):
            assert any((i + d) % 21 in cover and (j + d) % 21 in cover for d in range(21))
    h = np.arange(100, dtype=np.uint64) % np.uint64(37)
    r = s.run_hashes(h, 35)
    assert len(r) == 66 and r[0] == r[37] and len(set(r.tolist())) == 37


def test_whole_table(spark, sf):
    docs = rows(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text")
    want = sorted(x[:4] for x in brute(docs))
    got = sorted(rows(s.query(spark, sf), "doc_id", "n_words", "n_removed", "kept_sha256"))
    assert got == want
    assert 0 < sum(x[2] for x in got) < sum(x[1] for x in got)


def test_edge_cases(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    p = [word() for _ in range(60)]
    w = lambda n: [word() for _ in range(n)]
    docs = [
        (1, " ".join(w(13) + p + w(20))), (2, " ".join(w(31) + p[3:40] + w(7))), (3, "\n".join(p[10:45])),
        (4, " ".join(p[:34])), (5, " ".join(w(500))), (6, None), (7, ""), (8, "a b"), (8, "a b"), (9, "x " * 36),
        (10, "x " * 35), (11, " ".join(p[20:] + w(2) + p[20:])), (None, " ".join(p)), (None, " ".join(p)), (None, None),
        (12, " ".join(w(40))), (12, " ".join(p[:36])), (13, "a b " * 4000),
    ]
    data = spark.createDataFrame([(i, t, 1, "q") for i, t in docs], "doc_id long, text string, n_words int, key string")
    want = brute(docs)
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    got = rows(s.repeated_words(data), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(got, key=key) == sorted((x[:4] for x in want), key=key)
    out = s.without_repeats(data)
    assert out.columns == data.columns
    texts = sorted((i is None, i or 0, " ".join((t or "").split())) for i, t in rows(out, "doc_id", "text"))
    assert texts == sorted((i is None, i or 0, k) for i, _, _, _, k in want)
    assert s.repeated_words(data.limit(0)).count() == 0
