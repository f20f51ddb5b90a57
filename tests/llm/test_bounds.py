"""Inputs that made an operator slow, large or wrong: hosts of many labels, large rates, many templates, repeated rows."""

import random
import time

import pytest
from pyspark.sql import functions as F

from featsel.llm import bpe, common
from featsel.llm import licenses as li
from featsel.llm import minhash_dedup as m
from featsel.llm import source_mixing as mix
from featsel.llm import substring_dedup as s
from featsel.llm import url_filters as u
from tests.llm.helpers import rows
from tests.llm.test_licenses import brute


def test_host_of_many_labels(spark):
    pages = spark.createDataFrame([(1, "http://" + "a." * 20_000 + "org/x"), (2, "http://org/y"), (3, None), (4, "http://x.example.org/es/")] + [(5, "no url")] * 50, "page_id long, url string")
    began = time.time()
    got = sorted(set(rows(u.judge(pages, u.rules_table(spark)), "page_id", "rule", "verdict")))
    assert got == [(1, "org/", "allow"), (2, "org/", "allow"), (3, None, "allow"), (4, "example.org/es/", "block"), (5, None, "allow")]
    assert time.time() - began < 30
    deep = spark.createDataFrame([("a.b.c.d.org/", "block"), (".org/", "allow"), ("org/", "allow")], "rule string, verdict string")
    pages = spark.createDataFrame([("http://x.a.b.c.d.org/",), ("http://b.c.d.org/",), ("http://.org/",), ("http://c.d.org",)], "url string")
    assert rows(u.judge(pages, deep), "url", "rule") == [("http://x.a.b.c.d.org/", "a.b.c.d.org/"), ("http://b.c.d.org/", "org/"), ("http://.org/", ".org/"), ("http://c.d.org", None)]


def test_large_rates(spark):
    lams = [0.0, 0.3, 1.0, 40.0, 900.0]
    us = [0.0, 1e-9, 0.2, 0.5, 0.999, 1 - 2.0**-52]
    df = spark.createDataFrame([(a, b) for a in lams for b in us], "r double, u double")
    counts = rows(df.select(mix.poisson_count(F.col("r"), F.col("u")).alias("n"), F.size(F.filter(mix.poisson_cdf(F.col("r")), lambda c: c <= F.col("u"))).alias("m")), "n", "m")
    assert all(n == (k if r else 0) for (n, k), r in zip(counts, [a for a in lams for _ in us]))
    # one small source of a large corpus: a rate of 10^5, where a list of all probabilities took a minute
    docs = spark.createDataFrame([(i, "x" * 1000, "big") for i in range(200)] + [(1000, "y", "small")], "doc_id long, text string, source string")
    weights = spark.createDataFrame([("big", 1.0), ("small", 1.0)], "source string, weight double")
    began = time.time()
    n = dict(rows(mix.mix(docs, weights).groupBy("source").count(), "source", "count"))
    assert abs(n["small"] - 100_000) < 5 * 100_000**0.5 and time.time() - began < 30


def test_many_long_templates(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(3))
    common_phrase = [word() for _ in range(12)]
    templates = [(f"t{k}", " ".join([*(word() for _ in range(r.randrange(30, 400))), *common_phrase])) for k in range(520)]
    docs = []
    for k in range(60):
        t = templates[r.randrange(len(templates))][1].split()
        for _ in range(k % 4):  # words changed here and there
            t[r.randrange(len(t))] = word()
        docs.append((k, " ".join([*(word() for _ in range(r.randrange(60))), *t, *(word() for _ in range(40))])))
    docs += [(100, " ".join(common_phrase)), (101, " ".join(word() for _ in range(300)))]
    data = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((a, b, round(c, 9)) for a, b, c in rows(li.scan(data, li.templates_table(spark, templates)), "doc_id", "license", "containment"))
    assert got == sorted(brute(docs, templates)) and len(got) >= 50


def test_repeated_rows_in_the_pipeline(spark):
    import corpus_pipeline as p

    long = lambda k: " ".join(f"the{k} house and the {i} in it of {k * i}" for i in range(12))
    data = [(1, long(1), "a"), (1, long(1), "a"), (1, long(2), None), (None, long(3), "a"), (None, long(3), "b"), (None, long(4), "b"), (5, long(4), "b"), (6, None, "a"), (7, "", None), (8, " \n", "x"), (9, long(9) + " end", "a"), (10, long(9) + " fin", "a")]
    docs = spark.createDataFrame([(i, t, "en", x, 1, [1, 2], 0.5) for i, t, x in data], "doc_id long, text string, lang string, source string, kept int, row array<int>, _id double")
    out = m.one_of_each_group(docs)
    assert out.dtypes == docs.dtypes
    got = [((i or 0), t) for i, t in rows(out, "doc_id", "text")]
    want = [(1, long(1)), (1, long(2)), (0, long(3)), (5, long(4)), (6, None), (7, ""), (8, " \n"), (9, long(9) + " end")]
    assert sorted(got, key=str) == sorted(want, key=str)
    left = p.without_repeats(spark, out, "")
    assert left.dtypes == docs.dtypes and left.where("trim(text) = ''").count() == 0 and left.where("doc_id = 1").count() == 2
    for name, stage in p.STAGES[:-1]:
        assert stage(spark, docs, "").dtypes == docs.dtypes, name
        assert stage(spark, docs.limit(0), "").count() == 0, name
    assert p.encoded(spark, docs.limit(0), "").count() == 0
    coded = p.encoded(spark, docs, "")
    assert coded.columns == ["doc_id", "source", "ids", "text", "n_tokens"] and coded.count() == len(data)


def test_repeated_texts_are_known_by_128_bits():
    assert len(s._key([b"a", b"b"])) == 16 and s._key([b"a", b"b"]) != s._key([b"ab"])


def test_decoding_in_parts(spark):
    import pyarrow as pa

    v = bpe.vocabulary()
    ids = [list(range(k % 7, 400, 3)) if k % 5 else [] for k in range(300)]
    batch = pa.record_batch([pa.array(ids, pa.list_(pa.int32()))], names=["ids"])
    whole, parts = ([b for out in bpe._decoded(v, 0, most)([batch]) for b in out.column("bytes").to_pylist()] for most in (10**7, 150))
    assert whole == parts and len(whole) == 300


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_written_tables_go(spark):
    import os

    scratch = common.Scratch(spark)
    df = common.written(spark.range(5), scratch)
    at = scratch.at.removeprefix("file://").removeprefix("file:")
    assert df.count() == 5 and os.path.isdir(at)
    scratch.drop()
    assert not os.path.exists(at)
