import numpy as np

from featsel.llm import quality as q
from tests.llm.helpers import rows


def test_em_finds_accuracies():
    rng = np.random.default_rng(0)
    y = rng.random(20_000) < 0.7
    acc = [0.9, 0.8, 0.6, 0.75, 0.85, 0.7, 0.95, 0.65]
    v = np.stack([np.where(rng.random(len(y)) < a, y, ~y).astype(int) for a in acc], axis=1)
    v[rng.random(v.shape) < 0.3] = 2
    pat, inv, n = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    post, got, share = q.expectation_maximisation(pat, n.astype(float))
    assert np.abs(got - acc).max() < 0.03 and abs(share - 0.7) < 0.03
    assert ((post[inv.ravel()] > 0.5) == y).mean() > 0.93


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = {i: (s, k) for i, s, k in rows(q.query(spark, sf), "doc_id", "quality_score", "kept")}
    assert len(got) == 1000 and all(0 <= s <= 1 and k == (s >= q.KEEP) for s, k in got.values())
    labels = rows(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "quality")
    bad = [got[i][1] for i, y in labels if y == 0]
    good = [got[i][1] for i, y in labels if y == 1]
    assert np.mean(bad) < 0.05 and np.mean(good) > 0.95  # some labels are noise


def test_edge_cases(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = q.fit(docs, sample=150)
    data = spark.createDataFrame([(None, "The cat is in the house of the man.", "a"), (1, None, "b"), (1, "", None), (2, "x " * 20000, "c"), (3, " \n", "d")], "doc_id long, text string, kept string")
    out = q.score(data, model)
    assert out.columns == ["doc_id", "text", "quality_score", "kept"]
    got = rows(out, "doc_id", "quality_score", "kept")
    assert got[1][1] == got[2][1] == got[4][1] and not got[1][2] and got[0][2] and not got[3][2]
    assert q.classify(docs.limit(0)).count() == 0
    assert rows(q.score(docs.repartition(3), model).orderBy("doc_id"), "quality_score") == rows(q.score(docs, model).orderBy("doc_id"), "quality_score")
