import math

import duckdb

from featsel.llm import source_mixing as m
from tests.llm.helpers import rows


def test_against_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as from '{sf}/documents.parquet'")
    want = con.sql(f"select doc_id, source, copy, shuffle_key, md5(text), n_chars from ({m.ORACLE_SQL})").fetchall()
    import hashlib

    got = [(*r[:4], hashlib.md5(r[4].encode()).hexdigest(), r[5]) for r in rows(m.query(spark, sf), "doc_id", "source", "copy", "shuffle_key", "text", "n_chars")]
    assert got == sorted(got, key=lambda r: r[3]) and sorted(got) == sorted(want)


def test_cdf(spark):
    lams = [0.0, 0.3, 4.0, 900.0]
    for lam, cdf in rows(spark.createDataFrame([(x,) for x in lams], "r double").select("r", m.poisson_cdf(m.F.col("r")).alias("c")), "r", "c"):
        want, total = [], 0.0
        for k in range(len(cdf)):
            total += math.exp(k * math.log(lam) - lam - math.lgamma(k + 1)) if lam else float(k == 0)
            want.append(total)
        assert max(abs(a - b) for a, b in zip(cdf, want)) < 1e-10 and abs(cdf[-1] - 1) < 1e-10


def test_shares_follow_weights(spark):
    docs = spark.range(6000).selectExpr("id doc_id", "repeat('x', 10) text", "if(id % 3 = 0, 'a', 'b') source")
    w = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", 9.0), (None, None)], "source string, weight double")
    n = dict(rows(m.mix(docs, w, epochs=2.0).groupBy("source").count(), "source", "count"))
    assert abs(n["a"] - 9000) < 5 * 9000**0.5 and abs(n["b"] - 3000) < 5 * 3000**0.5
    a = sorted(rows(m.mix(docs, w), "doc_id", "copy"))
    assert a == sorted(rows(m.mix(docs.repartition(7), w), "doc_id", "copy"))


def test_edge_cases(spark):
    data = [(1, "aaaa", None), (1, "aaaa", None), (None, "bb", "s"), (None, None, "s"), (2, None, "empty"), (3, "", "empty"), (4, "c" * 9000, "s")]
    docs = spark.createDataFrame([(*r, 5) for r in data], "doc_id long, text string, source string, copy int")
    out = m.mix(docs, epochs=20.0)
    assert out.columns == ["doc_id", "text", "source", "copy", "shuffle_key"]
    n = out.where("source is null").groupBy("doc_id", "text").count().first()["count"]
    assert n % 2 == 0 and n > 0 and out.where("text is null and source = 's'").count() > 0
    assert m.mix(docs.limit(0)).count() == 0
