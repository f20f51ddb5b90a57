"""License notices in documents: MinHash bands over text windows, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from featsel.llm.common import small, table, written

# Short notices as they stand in documents (name, text).
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("mit", "Released under the MIT License."),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)

SHINGLE = 5
#: Shingles in a text window, and by how many the next window starts later.
WINDOW, STEP = 4, 2
#: Bands of a window's MinHash signature, which is made by one permutation: the hashes of the window's shingles are dealt into so
#: many bins, and the least of each bin is its band (most bins of a window are empty and have none). Two windows that share a
#: shingle have an equal band unless another of their shingles lies in the same bin and is less: each of the other three of a
#: window does with probability 1 / (2 BINS), so a notice of a single shingle is missed with probability 2.3e-5 at the most.
BINS = 1 << 16
#: Rows of template bands or shingles that are sent to all tasks at the most (two numbers each); beyond, Spark joins by shuffle.
SENT = 2_000_000
#: Share of a template's shingles that must be in the text around a window.
CONTAINMENT = 0.75


def shingles(text: Column) -> Column:
    """Hashes of the 5-word shingles, in order; words are runs of letters and digits in lower case."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    none = F.array().cast("array<bigint>")
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (SHINGLE - 1)), lambda i: F.xxhash64(F.slice(w, i, SHINGLE)))
    # the words are bound to a variable, so that they are split once and not for every shingle
    return F.transform(F.array(words), lambda w: F.when(F.size(w) >= SHINGLE, cut(w)).otherwise(none))[0]


def windows(rows: DataFrame, keys: list[str], sh: str = "sh") -> DataFrame:
    """One row for each window of each `sh`: the keys, its number j, and its shingles s0 .. s3 (null
    after the end). The last window is the first that reaches the end."""
    n = F.size(sh)
    last = F.greatest(F.lit(0), F.ceil((n - WINDOW) / STEP)).cast("int")
    at = lambda j, k: F.get(F.col(sh), j * STEP + k)
    each = F.transform(F.sequence(F.lit(0), last), lambda j: F.struct(j.alias("j"), *[at(j, k).alias(f"s{k}") for k in range(WINDOW)]))
    return rows.where(n > 0).select(*keys, F.inline(each))


def bands() -> Column:
    """The bands of a window s0 .. s3 as an array: a shingle's hash stands for its bin (its last 16 bits) and its value at once; one
    that isn't the least of its bin is null."""
    s = [F.col(f"s{i}") for i in range(WINDOW)]
    at = [x.bitwiseAND(F.lit(BINS - 1)) for x in s]
    hidden = [reduce(Column.__or__, [(at[i] == at[j]) & (s[j] < s[i]) for j in range(WINDOW) if j != i]) for i in range(WINDOW)]
    return F.array(*[F.when(h, F.lit(None)).otherwise(x) for h, x in zip(hidden, s)])


def templates_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    quoted = ", ".join("('{}', '{}')".format(*(x.replace("\\", "\\\\").replace("'", "\\'") for x in t)) for t in templates)
    return spark.sql(f"select * from values {quoted} as t(license, text)")


def scan(docs: DataFrame, templates: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, license, containment, first_word: one row for each row of `docs` (doc_id, text) and
    template (license, text) that it holds.

    Texts and templates are cut into overlapping windows of four shingles. A window's MinHash bands (see BINS) retrieve the
    templates that have a window with an equal band, whatever the number of templates. What is retrieved is verified: the share of
    the template's n distinct shingles that occur within 2n shingles from one of them on must be at least `containment`. Returned
    are the largest share and the word (from 0) at which the first such stretch begins.

    A null text, or one of under five words, holds nothing; nor does a template of under five words match
    (`short_notices.scan_all` finds those too).
    Rows that share a doc_id or have a null one are matched each by its own text and returned each;
    identical rows are returned as often as they come. Empty tables give no rows; other columns are ignored."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    key = {"k": F.coalesce("doc_id", F.xxhash64("text")), "h": F.xxhash64("text")}
    known = templates.select("license", shingles(F.col("text")).alias("sh")).where(F.size("sh") > 0)
    known = written(known.withColumn("lid", F.dense_rank().over(Window.orderBy("license"))))  # one row a template
    wanted = windows(known, ["lid"]).select("lid", F.explode(bands()).alias("value")).where("value is not null").distinct()
    wanted = small(written(wanted), SENT)

    # exploding a single value keeps the shingles from being computed again by every later filter
    cut = docs.select(*[v.alias(k) for k, v in key.items()], F.explode(F.array(shingles(F.col("text")))).alias("sh"))
    found = windows(cut, ["k", "h"]).select("k", "h", F.explode(bands()).alias("value")).join(wanted, "value")
    found = written(found.select("k", "h", "lid").distinct())

    texts = docs.withColumns(key).join(small(written(found.select("k", "h").distinct())), ["k", "h"], "left_semi")
    counted = texts.groupBy("doc_id", "k", "h").agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    places = counted.select("doc_id", "k", "h", "copies", F.posexplode(shingles(F.col("text"))).alias("at", "s"))
    of = known.select("lid", F.explode("sh").alias("s")).distinct()
    hits = places.join(small(written(of), SENT), "s").join(found, ["k", "h", "lid"], "left_semi")
    sizes = of.groupBy("lid").agg(F.count("*").cast("int").alias("n")).join(known.select("lid", "license").distinct(), "lid")
    rows = hits.join(small(written(sizes)), "lid")
    # a hit counts for every start after the same shingle's hit before it and less than 2n places before itself: it adds one from
    # there on, and takes it away behind itself, so one running sum has the distinct hits of every start
    pair = ["doc_id", "k", "h", "lid"]
    prior = F.lag("at", 1, -1).over(Window.partitionBy(*pair, "s").orderBy("at"))
    rows = rows.withColumn("begin", (F.greatest(prior, F.col("at") - 2 * F.col("n")) + 1).cast("int"))
    change = lambda at, by, start: F.struct(at.alias("place"), F.lit(by).alias("by"), F.lit(start).alias("start"))
    events = rows.select(*pair, "copies", "license", "n", F.inline(F.array(change(F.col("begin"), 1, False), change(F.col("at"), 0, True), change(F.col("at") + 1, -1, False))))
    sofar = Window.partitionBy(*pair).orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    share = events.withColumn("containment", F.sum("by").over(sofar) / F.col("n")).where(F.col("start") & (F.col("containment") >= containment))
    best = share.groupBy(*pair, "copies", "license").agg(F.max("containment").alias("containment"), F.min("place").alias("first_word"))
    out = best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select("doc_id", "license", "containment", "first_word")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), templates_table(spark))
