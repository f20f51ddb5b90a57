"""The two trained operators against plain loops: every text by itself, without batches, caches or numpy blocks."""

import math
from collections import Counter

import numpy as np
import pytest

from featsel.llm import quality as q
from featsel.llm import toxicity as t
from tests.llm.helpers import rows

SF = "/root/testdata/sf0.001"


def test_quality_against_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {i: (x or "").encode() for i, x in rows(docs, "doc_id", "text")}
    # votes of every document, counted by pattern
    pattern = {i: tuple(q.votes(q.measures(x))) for i, x in texts.items()}
    want = Counter(sum(v * 3**k for k, v in enumerate(p)) for p in pattern.values())
    assert dict(rows(q.vote_patterns(docs), "pattern", "count")) == want
    # expectation maximisation, one document and labeller at a time
    good, bad, share, post = [[0.05, 0.45, 0.5]] * 8, [[0.4, 0.1, 0.5]] * 8, 0.8, {}
    for _ in range(200):
        new = {}
        for p in set(pattern.values()):
            a, b = share, 1 - share
            for k, v in enumerate(p):
                a, b = a * good[k][v], b * bad[k][v]
            new[p] = a / (a + b)
        done, post = bool(post) and max(abs(new[p] - post[p]) for p in new) < 1e-9, new
        if done:
            break
        w = sum(post[p] for p in pattern.values())
        good = [[(sum(post[p] for p in pattern.values() if p[k] == v) + 1) / (w + 3) for v in range(3)] for k in range(8)]
        bad = [[(sum(1 - post[p] for p in pattern.values() if p[k] == v) + 1) / (len(texts) - w + 3) for v in range(3)] for k in range(8)]
        share = (w + 1) / (len(texts) + 2)
    model = q.fit(docs)
    assert model.good_share == pytest.approx(share, abs=1e-6)
    # all documents train here; the scorer must come near to their posteriors
    got = {i: (s, k) for i, s, k in rows(q.score(docs, model), "doc_id", "quality_score", "kept")}
    for i, x in texts.items():
        words, z = x.split(), 0.0
        for word in words:
            z += sum(model.weights[d] for d in q.dimensions(word)) / len(words)
        z += sum(model.weights[d] * v for d, v in q.extras(words))
        s = 1 / (1 + math.exp(-z)) if words else 0.0
        assert got[i][0] == pytest.approx(s, abs=1e-9) and got[i][1] == (got[i][0] >= q.KEEP)
    sure = [i for i, p in pattern.items() if not 0.1 < post[p] < 0.9 and texts[i].split()]
    assert np.mean([(got[i][0] > 0.5) == (post[pattern[i]] > 0.5) for i in sure]) > 0.9


def test_quality_of_very_many_documents(spark):
    docs = spark.range(200).selectExpr("id doc_id", "concat('word number ', id, ' of the text') text")
    assert 0 < len(q._training_rows(docs, 20_000_000_000, 10**9)) < 60  # a twentieth
    assert len(q._training_rows(docs, 200, 10**6)) == 200
    same = docs.selectExpr("1 doc_id", "'the same' text")
    assert len(q._training_rows(same, 200, 50)) <= 100
    assert q._shape(b"aA1" * 30) != q._shape(b"aA1" * 20)


def sigmoid(x):
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def one_window(net, words):
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = [net.inputs([w])[0].astype(np.float64) for w in words]
    states = {}
    for d in "fb":
        h, out = np.zeros(t.STATE), []
        for v in x if d == "f" else x[::-1]:
            g, a = v @ p[f"W{d}"] + p[f"b{d}"], h @ p[f"U{d}"]
            z = np.array([sigmoid(c) for c in (g + a)[: t.STATE]])
            r = np.array([sigmoid(c) for c in (g + a)[t.STATE : 2 * t.STATE]])
            n = np.tanh(g[2 * t.STATE :] + r * a[2 * t.STATE :])
            h = (1 - z) * n + z * h
            out.append(h)
        states[d] = out if d == "f" else out[::-1]
    h = [np.concatenate(s) for s in zip(states["f"], states["b"])]
    e = np.array([np.tanh(s @ p["A"]) @ p["v"] for s in h])
    w = np.exp(e - e.max())
    return sigmoid(sum(a * s for a, s in zip(w / w.sum(), h)) @ p["o"] + p["c"][0])


def test_toxicity_against_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    net = t.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = dict(rows(docs.where("length(text) < 3000 or doc_id % 40 = 0"), "doc_id", "text"))
    got = dict(rows(t.score(docs, net), "doc_id", "toxicity_score"))
    for i, text in list(texts.items())[:60]:
        words = [t.plain(w) for w in t.steps((text or "").encode())]
        scores = [one_window(net, words[s : s + t.WINDOW]) for s in range(0, max(1, len(words) - t.WINDOW + t.STEP), t.STEP) if words[s : s + t.WINDOW]]
        assert got[i] == pytest.approx(max(scores, default=0.0), abs=1e-4)


def test_toxicity_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None), (None, "idiot"), (2, "some text")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int")
    for d, lab in ((docs, labels.limit(0)), (docs.limit(0), labels), (docs, labels)):
        out = rows(t.score(docs, t.fit(d, lab)), "text", "toxicity_score", "predicted")
        assert len(out) == 4 and all(0 <= s < t.TOXIC and p == 0 for _, s, p in out) and all(s == 0 for x, s, _ in out if x is None)
        assert len({s for x, s, _ in out if x == "some text"}) == 1
    one = t.train([b"only toxic words"] * 3, [1, 1, 1])
    assert 0 <= t.Scorer(one)([b"only"])[0] <= 1
