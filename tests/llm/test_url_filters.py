import duckdb

from featsel.llm import url_filters as u
from tests.llm.helpers import rows


def test_against_sql(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        con = duckdb.connect()
        con.sql(f"create view pages as from '{sf}/pages.parquet'")
        cols = ["page_id", "host", "path", "rule", "verdict"]
        want = con.sql(f"select {', '.join(cols)} from ({u.ORACLE_SQL})").fetchall()
        got = rows(u.query(spark, sf), *cols)
        assert sorted(got, key=str) == sorted(want, key=str)
    assert {"allow", "block"} == {r[4] for r in got} and None in {r[3] for r in got}


def test_rules_and_urls(spark):
    urls = {
        "http://A.Example.ORG/es/x?y": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "http://example.org/es": ("example.org", "/es", "org/", "allow"),
        "http://example.org": ("example.org", "", None, "unknown"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "x://a.com/FR/": ("a.com", "/FR/", None, "unknown"),
        "x://a.com/fr/://b.org/": ("a.com", "/fr/://b.org/", "com/fr/", "allow"),
        "http://example.org/en/1#a": ("example.org", "/en/1", "example.org/en/1", "block"),
        "http://a.b.com#/de/": ("a.b.com", "", None, "unknown"),
        "example.org/es/": ("", "", None, "unknown"), "": ("", "", None, "unknown"), "http:///de/": ("", "/de/", None, "unknown"),
        "http://com/de/" + "x" * 9000: ("com", "/de/" + "x" * 9000, "com/de/", "block"),
        "http://org.com\n/fr/": ("org.com\n", "/fr/", None, "unknown"),
    }
    data = [(1, k, "old") for k in urls] + [(None, None, None), (1, None, "old"), (7, "http://example.org/es", "old")]
    pages = spark.createDataFrame(data, "page_id long, url string, verdict string")
    got = rows(u.judge(pages, u.rules_table(spark), "unknown"), "url", "host", "path", "rule", "verdict")
    want = [(k, *urls.get(k, ("", "", None, "unknown"))) for _, k, _ in data]
    assert sorted(got, key=str) == sorted(want, key=str)
    odd = spark.createDataFrame([("org/", "allow"), ("org/", "block"), (None, "block"), ("com", "block"), ("com/", None)], "rule string, verdict string")
    got = dict(rows(u.judge(pages.where("page_id = 7"), odd), "url", "verdict"))
    assert got == {"http://example.org/es": "block"}
    assert u.judge(pages.limit(0), odd).count() == 0 and u.judge(pages, odd.limit(0)).where("rule is not null").count() == 0
