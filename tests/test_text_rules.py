"""Rules on texts by shorter ways, against the plain ones."""

import random

from pyspark.sql import functions as F

from featsel.functions import text
from featsel.operators import prepare


def test_words_and_digits_of_odd_texts(spark):
    r = random.Random(8)
    common, more = "ab1_'- -'\n.Z9", "éß٣²①́ͅ‍‌’一𝟗😀 "
    texts = ["".join(r.choice(common if k % 2 else common + more) for _ in range(r.randint(0, 25))) for k in range(3_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    plain = F.regexp_extract_all(F.lower("t"), F.lit(r"(?U)\b[\w'-]+\b"), F.lit(0))
    got = df.select("i", text.tokens(F.col("t")).alias("words"), plain.alias("want"), text.word_count(F.col("t")).alias("n"), text.digit_count(F.col("t")).alias("d")).collect()
    assert [texts[x["i"]] for x in got if x["words"] != x["want"] or x["n"] != len(x["words"])] == []
    assert [texts[x["i"]] for x in got if x["d"] != sum(c.isdigit() for c in texts[x["i"]])] == []


def test_a_class_of_digits_has_few_members():
    """Each character that isn't in the class is compared with all its members: 128 of them before neighbours were one range."""
    assert text.digits().count("-") < 30


def test_significant_digits_by_the_shortest_text(spark):
    r = random.Random(4)
    values = [0.0, -0.0, 0.001, 0.0009999, 9999999.0, 1e7, 1e10, -12.5, 0.1 + 0.2, 1 / 3, 0.05, 100.0, 1234567.125, 123456.7891234, None]
    values += [float(f"{r.uniform(-1, 1) * 10 ** r.randint(-6, 12):.{r.randint(1, 10)}g}") for _ in range(2_000)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, x double")
    got = df.select("i", prepare.significant(F.col("x")).alias("s")).collect()
    assert [(values[g["i"]], g["s"]) for g in got if g["s"] != (None if values[g["i"]] is None else f"{values[g['i']]:.10g}")] == []
