import re

import __spark_entry__ as entry
from featsel.llm import licenses as li
from featsel.llm import short_notices as sn
from tests.llm.helpers import rows
from tests.llm.test_licenses import brute

SF = "/root/testdata/sf0.01"


def brute_short(docs, templates):
    cut = lambda text: [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    out = []
    for i, text in docs:
        w = cut(text)
        for name, t in templates:
            want = cut(t)
            at = [k for k in range(len(w) - len(want) + 1) if w[k : k + len(want)] == want]
            if at:
                out.append((i, name, 1.0, at[0]))
    return out


def test_registered_query_finds_short_notices(spark):
    docs = rows(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text")
    got = rows(entry.queries()["op10_license_scans"](spark, SF), "doc_id", "license", "containment", "first_word")
    want = brute_short(docs, sn.SHORT_TEMPLATES)
    assert want and sorted(g for g in got if g[1] == "all-rights-reserved") == sorted(want)
    assert sorted((a, b, round(c, 9)) for a, b, c, _ in got if b != "all-rights-reserved") == sorted(brute(docs, li.TEMPLATES))


def test_templates_of_one_to_five_words(spark):
    templates = [("one", "GPL"), ("two", "MIT License"), ("three", "All rights reserved."), ("four", "See LICENSE for details"), ("five", "Released under the MIT License."), ("none", "...")]
    docs = [
        (1, "mit license"), (1, "MIT\nLicense, mit license"), (None, "x mit-license"), (None, "x mit-license"), (2, None), (2, ""), (3, "mit x license"),
        (4, "a " * 30_000 + "See license for details"), (5, "released under the mit license"), (6, "gpl"), (7, "all rights"), (8, "All rights all rights reserved"),
    ]
    data = spark.createDataFrame([(i, t, "l", 3) for i, t in docs], "doc_id long, text string, license string, first_word int")
    got = rows(sn.scan_all(data, li.templates_table(spark, templates)), "doc_id", "license", "containment", "first_word")
    assert sorted(got, key=str) == sorted(brute_short(docs, templates[:5]), key=str)
    assert len(got) == 9 and sn.scan_all(data.limit(0), li.templates_table(spark, templates)).count() == 0
    assert sn.scan_short(data, li.templates_table(spark)).count() == 0
