from collections import Counter

import corpus_pipeline as p
from featsel.llm import quality
from tests.llm.helpers import components, rows, shingles
from tests.llm.test_bpe import REF
from tests.llm.test_substring_dedup import brute


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = dict(rows(docs, "doc_id", "text"))
    kept = {i for i, k in rows(quality.query(spark, sf), "doc_id", "kept") if k}
    groups = components({i: shingles(text[i]) for i in kept})
    left = sorted(i for i in kept if groups[i] == i)
    cut = {x[0]: x for x in brute([(i, text[i]) for i in left])}
    want = {i: " ".join(x[4].split()) for i, x in cut.items()}
    out = rows(p.run(spark, sf), "doc_id", "source", "ids", "n_tokens", "text")
    assert 0 < len(kept) < len(text) and len(left) < len(kept)
    assert {i for i, *_ in out} <= set(left) and len({i for i, *_ in out}) > 0.4 * len(left)
    for i, _, ids, n, t in out:
        assert " ".join(t.split()) == want[i] and ids == REF.encode_ordinary(t) and n == len(ids)
    assert max(Counter(i for i, *_ in out).values()) > 1


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 40").cache()
    for name, stage in p.STAGES[:-1]:
        assert stage(spark, docs, sf).dtypes == docs.dtypes, name
