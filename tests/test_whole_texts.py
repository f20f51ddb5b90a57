"""Document frequency and text measures over whole texts, against brute force."""

import re
from collections import Counter

import pytest

from featsel.jobs.queries import QUERIES

TEXTS = ["The cat's well-known; the CAT, 12 x 3", "", None, "hot " * 500 + "end", "Über naïve_one 日本 7", "a-b -c- 'd' ...", "the hot cat"]


def words(t):
    return re.findall(r"\b[\w'-]+\b", (t or "").lower())


@pytest.fixture(scope="module", params=["fixture", "sf0.001"])
def data(request, spark, tmp_path_factory):
    if request.param == "sf0.001":
        at = "/root/testdata/sf0.001"
    else:
        at = str(tmp_path_factory.mktemp("texts"))
        spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    return at, [tuple(r) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()]


def test_document_frequency(spark, data):
    at, docs = data
    want = Counter(w for _, t in docs for w in set(words(t)))
    got = QUERIES["a4_document_frequency"](spark, at).collect()
    assert len(got) == len(want) and {r["token"]: r["df"] for r in got} == want


def test_measures(spark, data):
    at, docs = data
    got = {r["doc_id"]: r for r in QUERIES["p7_text_measures"](spark, at).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        w, t = words(t), t or ""
        want = (len(t), len(w), len(set(w)) / len(w) if w else 0, sum(c in "0123456789" for c in t) / len(t) if t else 0)
        assert tuple(got[i][c] for c in ("length", "words", "variety", "digit_share")) == pytest.approx(want, abs=1e-6)
