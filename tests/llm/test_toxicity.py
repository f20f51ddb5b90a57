import zlib

import numpy as np

from featsel.llm import toxicity as t
from tests.llm.helpers import rows


def test_gradient():
    r = np.random.default_rng(0)
    net = t.Network.new([b"a", b"b"], 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words = [b"a", b"bcd", b"zz"]
    at = r.integers(0, 3, (5, 4))
    mask = np.array([[1, 1, 1, 1]] * 3 + [[1, 0, 1, 1], [0, 0, 1, 0]], bool)
    y = np.array([0, 1, 0, 1])

    def loss():
        x = net.inputs(words).astype(float)[at]
        gates = [(x @ net.p["W" + d] + net.p["b" + d]) * mask[:, :, None] for d in "fb"]
        p = net.score(*gates, mask)
        return -np.mean(np.log(np.where(y, p, 1 - p)))

    g = net.gradient(at, [np.array([1, 0, 0]), *t.trigram_rows(words), t.prefix_rows(words)], mask, y)
    for k, value in net.p.items():
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old = value[i]
        value[i] = old + 1e-2
        a = loss()
        value[i] = old - 1e-2
        b = loss()
        value[i] = old
        assert abs((a - b) / 2e-2 - g[k][i]) < 2e-3 * max(1, abs(g[k][i])) + 1e-4, k


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 56, 57, 1000):
        s = t.windows(n)
        assert {i for k in s for i in range(k, min(n, k + t.WINDOW))} == set(range(n))
        assert all(b - a == t.STEP for a, b in zip(s, s[1:]))


def test_held_out_accuracy_and_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    net = t.fit(docs, labels)
    got = {i: (h, s, p) for i, h, s, p in rows(t.score(docs, net).select("doc_id", t.held_out(t.F.col("doc_id")).alias("h"), "toxicity_score", "predicted"), "doc_id", "h", "toxicity_score", "predicted")}
    assert len(got) == 1000 and all(0 <= s <= 1 and p == (s >= 0.7) for _, s, p in got.values())
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, (h, _, _) in got.items())
    y = {i: v for i, v in rows(labels, "doc_id", "toxic") if got[i][0]}
    pos, neg = ([got[i][1] for i in y if y[i] == v] for v in (1, 0))
    assert np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg]) > 0.8
    odd = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "idiot", None), (2, "x " * 20_000, 3), (3, "\n", 4)], "doc_id long, text string, predicted int")
    out = rows(t.score(odd, net), "toxicity_score", "predicted")
    assert len(out) == 5 and [s for s, _ in out[:2]] == [0, 0] and out[4][0] == 0
    assert t.score(odd.limit(0), net).count() == 0


def test_sample_is_bounded_in_bytes(spark, monkeypatch):
    """The driver gets the first texts in the order of a hash, up to a number of bytes together, however the rows are partitioned."""
    data = [(i, ("é" if i % 2 else "e") * (i % 7 + 1)) for i in range(400)] + [(3, None), (3, "twice")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3 % 2) for i in range(400)], "doc_id long, toxic int")
    got = []
    monkeypatch.setattr(t, "train", lambda texts, y: got.append(sorted(zip(texts, y))))
    for most, rows_ in ((1 << 20, docs), (500, docs), (500, docs.repartition(9)), (0, docs.where("text is not null"))):
        t.fit(rows_, labels, most_bytes=most)
    size = [sum(len(x) for x, _ in g) for g in got]
    learnt = [((x or "").encode(), i % 3 % 2) for i, x in data if zlib.crc32(str(i).encode()) % 3 != 1]
    assert got[0] == sorted(learnt) and size[0] > 500
    assert got[1] == got[2] and 480 <= size[1] <= 500 and got[3] == []
