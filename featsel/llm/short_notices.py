"""License notices of any length: templates of under five words are found as whole word sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featsel.llm.common import small, table, written
from featsel.llm.licenses import CONTAINMENT, SHINGLE, TEMPLATES, scan, templates_table

# Notices of under five words as they stand in documents (name, text).
SHORT_TEMPLATES = (("all-rights-reserved", "All rights reserved."),)


def words(text: Column) -> Column:
    """The words of a text as `licenses.shingles` reads them."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def scan_short(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """doc_id, license, containment (1.0), first_word for each row of `docs` and template of one to four words
    that it holds. Such a template has one shingle, its whole word sequence; document runs of the
    lengths that the templates have are hashed and looked up. Every step works within a row, so a common
    notice or doc_id is no group in one task. A license with several short texts is returned for each."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = templates.select("license", words(F.col("text")).alias("w")).where(F.size("w").between(1, SHINGLE - 1))
    known = written(known.select("license", F.size("w").alias("m"), F.xxhash64("w").alias("h"), F.col("w")[0].alias("w0")).distinct())
    lengths = sorted(r["m"] for r in known.select("m").distinct().collect())
    firsts = [r["w0"] for r in known.select("w0").distinct().limit(20_001).collect()]
    few = len(firsts) <= 20_000  # then runs are only hashed where a template's first word stands

    # exploding a single value keeps the words from being split again for every length
    cut = docs.select("doc_id", F.explode(F.array(words(F.col("text")))).alias("w"))
    if few:
        cut = cut.where(F.arrays_overlap("w", F.array(*map(F.lit, firsts)).cast("array<string>")))
    cut = cut.withColumn("at", F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1))))
    if few:
        cut = cut.withColumn("at", F.filter("at", lambda i: F.coalesce(F.get("w", i - 1).isin(firsts), F.lit(False))))
    each = []
    for m in lengths:
        runs = F.transform(F.filter("at", lambda i: i + (m - 1) <= F.size("w")), lambda i: F.struct(F.xxhash64(F.slice("w", i, m)).alias("h"), (i - 1).alias("first")))  # noqa: B023
        each.append(F.transform(runs, lambda r: F.struct(F.lit(m).alias("m"), r["h"].alias("h"), r["first"].cast("int").alias("first"))))  # noqa: B023
    none = F.array().cast("array<struct<m:int,h:bigint,first:int>>")
    rows = cut.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.concat(none, *each).alias("runs"))
    at = rows.select("row", "doc_id", F.inline("runs"))
    found = at.join(small(known.drop("w0")), ["m", "h"])
    found = found.groupBy("row", "doc_id", "license", "m", "h").agg(F.min("first").alias("first_word"))
    return found.select("doc_id", "license", F.lit(1.0).alias("containment"), "first_word")


def scan_all(docs: DataFrame, templates: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """`licenses.scan` for templates of five words and more, with `scan_short` for those of fewer. A
    template without words holds nothing that could be found."""
    return scan(docs, templates, containment).unionByName(scan_short(docs, templates))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_all(table(spark, sf_dir, "documents"), templates_table(spark, TEMPLATES + SHORT_TEMPLATES))
