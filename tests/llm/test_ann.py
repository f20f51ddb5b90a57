import numpy as np

from featsel.llm import ann
from tests.llm.helpers import rows


def brute(vectors, queries, k=20):
    ids = np.array([i for i, _ in vectors])
    x = np.array([v for _, v in vectors], float)
    out = {}
    for i, v in queries:
        s = x @ np.array(v, float)
        out[i] = [(int(j), float(s_)) for j, s_ in sorted(zip(ids, s), key=lambda p: (-round(p[1], 12), p[0])) if j != i][:k]
    return out


def test_recall_and_scores(spark):
    sf = "/root/testdata/sf0.1"
    data = [(i, v) for i, v in rows(spark.read.parquet(f"{sf}/embeddings.parquet"), "vec_id", "embedding") if v is not None]
    want = brute(data, [d for d in data if d[0] % 20 == 0])
    got = {}
    of = dict(data)
    for q, r, v, s in sorted(rows(ann.query(spark, sf), "query_id", "rank", "vec_id", "score")):
        got.setdefault(q, []).append(v)
        assert r == len(got[q]) and v != q and abs(s - np.dot(np.array(of[q], float), np.array(of[v], float))) < 1e-12
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    recall = np.mean([len(set(got[q]) & {v for v, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.9, recall


def test_copies_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    base = [(i, rng.normal(size=4).tolist()) for i in range(0, 30)]
    data = base + [(100 + i, base[3][1]) for i in range(60)] + [(0, base[0][1]), (20, base[20][1])]
    odd = [(200, None), (220, [0.0] * 4), (240, [1.0, None, 2.0, 3.0]), (260, [float("nan"), 1.0, 1.0, 1.0]), (280, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4), (300, []), (320, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in data + odd], "vec_id long, embedding array<float>, score string")
    clean = [(i, np.float32(v).astype(float).tolist()) for i, v in dict(data).items()]
    index = ann.Index(tables=6, width=4.0)
    out = rows(ann.nearest(df, df.where("vec_id % 20 = 0"), 20, index), "query_id", "rank", "vec_id", "score")
    want = brute(clean, [c for c in clean if c[0] % 20 == 0])
    got = {}
    for q, r, v, s in sorted(out):
        got.setdefault(q, []).append(v)
    assert got == {q: [v for v, _ in w] for q, w in want.items()}
    few = df.where("vec_id in (0, 20, 1, 320)")
    out = sorted(rows(ann.nearest(few, few.where("vec_id % 20 = 0"), 20, ann.Index(tables=1, probes=1, width=0.01)), "query_id", "vec_id"))
    assert out == [(0, 1), (0, 20), (20, 0), (20, 1)]
    assert ann.nearest(df.limit(0), df).count() == 0 and ann.nearest(df, df.limit(0)).count() == 0
