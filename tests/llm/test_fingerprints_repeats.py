"""Rows of one or no doc_id are spread over blocks, and keep their order."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from featsel.llm import fingerprints as f
from tests.llm.helpers import rows

BIG = 2**60


@pytest.fixture
def data(spark, monkeypatch):
    monkeypatch.setattr(f, "BLOCK_ROWS", 16)
    docs = [(None, f"null {i} " * 3) for i in range(120)] + [(7, f"seven {i} " * 3) for i in range(90)]
    docs += [(i, f"text {i} " * 3) for i in range(100) if i != 7] + [(BIG + i % 3, f"big {i} " * 3) for i in range(90)]
    docs += [(None, None)] * 70 + [(7, "equal")] * 50
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(5)


def test_no_block_holds_a_repeated_key(data):
    parts = []
    real = f._blocks
    with pytest.MonkeyPatch.context() as m:
        m.setattr(f, "_blocks", lambda *a: parts.append(real(*a)) or parts[-1])
        f.fingerprints(data).count()
    sizes = [r["count"] for r in parts[0].groupBy("_block").count().collect()]
    assert max(sizes) <= 4 * f.BLOCK_ROWS


def test_order_over_repeats(data):
    docs = rows(data.withColumn("t", F.coalesce("text", F.lit(""))).withColumn("h", F.xxhash64("t")), "doc_id", "h", "t")
    docs.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    want = Counter()
    for (i, _, t), (_, _, nxt) in zip(docs, docs[1:] + docs[:1]):
        c = len(t) // 3
        want[i, len(t), hashlib.sha256((t[: len(t) - c] + nxt[:c]).encode()).hexdigest()] += 1
    assert Counter(rows(f.fingerprints(data), "doc_id", "n_chars", "edited_sha256")) == want
