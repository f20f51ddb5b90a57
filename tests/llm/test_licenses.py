import random
import re

from featsel.llm import licenses as li
from tests.llm.helpers import rows


def cut(text):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute(docs, templates, least=0.75):
    out = []
    for i, text in docs:
        sh = cut(text)
        for name, t in templates:
            want = set(cut(t))
            if not want:
                continue
            n = len(want)
            best = 0.0
            for at in range(len(sh)):
                if sh[at] in want:
                    best = max(best, len(want & set(sh[at : at + 2 * n])) / n)
            if best >= least:
                out.append((i, name, round(best, 9)))
    return out


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = rows(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text")
    want = brute(docs, li.TEMPLATES)
    got = [(a, b, round(c, 9)) for a, b, c in rows(li.query(spark, sf), "doc_id", "license", "containment")]
    assert sorted(got) == sorted(want) and len({b for _, b, _ in got}) == 4


def test_every_template_anywhere(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    docs, where = [], {}
    for k in range(300):
        name, text = li.TEMPLATES[k % len(li.TEMPLATES)]
        before = k % 41
        docs.append((k, " ".join([*(word() for _ in range(before)), text.upper() if k % 2 else text, *(word() for _ in range(k % 23))])))
        where[k] = (name, before)
    got = {i: (n, f) for i, n, c, f in rows(li.scan(spark.createDataFrame(docs, "doc_id long, text string"), li.templates_table(spark)), "doc_id", "license", "containment", "first_word") if c == 1.0}
    assert got == where


def test_edge_cases(spark):
    mit = "Released under the MIT License."
    data = [(1, None), (1, ""), (2, "released under the mit"), (None, mit), (None, mit), (3, mit), (3, "x " * 30_000 + mit), (4, "the gnu general public license version 3")]
    docs = spark.createDataFrame([(i, t, "l", 3) for i, t in data], "doc_id long, text string, license string, j int")
    got = sorted(((i or 0, n) for i, n in rows(li.scan(docs, li.templates_table(spark)), "doc_id", "license")))
    assert got == [(0, "mit"), (0, "mit"), (3, "mit"), (3, "mit")]
    assert li.scan(docs.limit(0), li.templates_table(spark)).count() == 0
    assert li.scan(docs, li.templates_table(spark, [("short", "MIT License")])).count() == 0


def test_long_notice_many_times(spark):
    import time

    r = random.Random(7)
    words = [f"w{k}" for k in range(1_000)]
    notice = " ".join(words)
    lines = [notice if r.random() < 0.7 else " ".join(words[:600] + ["gap"] * 3 + words[600:]) for _ in range(80)]
    docs = [(0, " x ".join(lines)), (1, " ".join(words[:700])), (2, " ".join(words[:800])), (3, "nothing here of it")]
    templates = [("long", notice), ("short", " ".join(words[10:17]))]
    df, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(templates, "license string, text string")
    began = time.time()
    got = sorted((a, b, round(c, 9), w) for a, b, c, w in rows(li.scan(df, known), "doc_id", "license", "containment", "first_word"))
    took = time.time() - began
    assert [(a, b) for a, b, *_ in got] == [(0, "long"), (0, "short"), (1, "short"), (2, "long"), (2, "short")] and got[0][2] == 1.0 and got[1][3] == 10
    assert took < 30, took
