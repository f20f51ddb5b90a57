"""The tables that a selection job reports."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featsel.operators import stats


def count_label(n: int) -> str:
    """A large count in short: 12,345 or 1.23 × 10^9."""
    digits, _, power = f"{Decimal(n):.2e}".partition("e")
    return f"{n:,}" if n < 10**6 else f"{digits} × 10^{int(power)}"


def selection_summary(sets: DataFrame, rel: DataFrame, red: DataFrame, energies: DataFrame) -> DataFrame:
    """One row for each set of `sets` (set_id, idx): its size k, names in column order, energy (of `energies`: set_id,
    energy), percent of the features left out, number of sets of this size (and in short), mean relevance, mean redundancy."""
    n = rel.count()
    named = sets.join(rel.select("idx", "name", "r"), "idx")
    each = named.groupBy("set_id").agg(
        F.count("*").cast("int").alias("k"),
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "name"))), lambda x: x["name"]).alias("names"),
        F.avg("r").alias("average_relevance"),
    )
    spaces = [(k, float(math.comb(n, k)), count_label(math.comb(n, k))) for k in range(1, n + 1)]
    space = sets.sparkSession.createDataFrame(spaces, "k int, search_space double, search_space_label string")
    out = each.join(F.broadcast(space), "k").join(stats.average_redundancy(sets, red).withColumnRenamed("value", "average_redundancy"), "set_id")
    return out.join(energies.select("set_id", "energy"), "set_id", "left").select(
        "set_id", "k", "names", F.round("energy", 6).alias("energy"), F.round(100 * (1 - F.col("k") / n), 2).alias("feature_reduction"),
        "search_space", "search_space_label", F.round("average_relevance", 6).alias("average_relevance"), F.round("average_redundancy", 6).alias("average_redundancy"),
    )


def feature_table(rel: DataFrame, red: DataFrame, chosen: list[int], greedy: list[int]) -> DataFrame:
    """position, name, selected, greedy, relevance, selected_redundancy (mean with the chosen ones other than itself) of every
    feature: the chosen first, then by relevance (rounded), then in column order."""
    rows = rel.select("idx", "name", F.col("idx").isin(chosen).alias("selected"), F.col("idx").isin(greedy).alias("greedy"), F.round("r", 6).alias("relevance"))
    rows = rows.join(stats.feature_overlap(rel, chosen, red), "idx").withColumn("selected_redundancy", F.round("overlap", 6))
    place = Window.partitionBy(F.lit(0)).orderBy(F.desc("selected"), F.desc("relevance"), "idx")  # one row a feature
    out = rows.withColumn("position", F.row_number().over(place))
    return out.select("position", "name", "selected", "greedy", "relevance", "selected_redundancy").orderBy("position")


def benchmark_table(metrics: DataFrame, names: dict[str, str]) -> DataFrame:
    """The metrics (see `evaluate.evaluate_subsets`) of some sets side by side: method (names: set_id -> method), floats rounded to 6."""
    method = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    rows = metrics.where(F.col("set_id").isin(list(names)))
    floats = {"score", "secondary", "loss"}
    return rows.select(method[F.col("set_id")].alias("method"), *[F.round(c, 6).alias(c) if c in floats else F.col(c) for c in metrics.columns if c != "set_id"])


# What the comparison found.
FINDINGS = {1: "less overlap and a stronger score", 2: "less overlap at nearly the same score", 3: "both methods found much the same"}


def insight(pair: DataFrame) -> DataFrame:
    """`pair`: one row with score and redundancy of the chosen and of the greedy set (score, redundancy, greedy_score,
    greedy_redundancy). Returns score_delta, redundancy_delta and finding: 1 if the score is higher by .002 and the overlap lower,
    2 if the overlap is lower by more than .01, else 3; and its text."""
    score, overlap = F.col("score") - F.col("greedy_score"), F.col("redundancy") - F.col("greedy_redundancy")
    finding = F.when((score >= 0.002) & (overlap < 0), 1).when(F.col("redundancy") + 0.01 < F.col("greedy_redundancy"), 2).otherwise(3)
    text = F.create_map(*[F.lit(x) for p in FINDINGS.items() for x in p])[finding]
    return pair.select(F.round(score, 6).alias("score_delta"), F.round(overlap, 6).alias("redundancy_delta"), finding.alias("finding"), text.alias("finding_text"))


def frontier_table(sets: DataFrame, red: DataFrame, metrics: DataFrame | None, n: int) -> DataFrame:
    """k, method, score, reduction, redundancy of the sets (set_id, k, method, selected array<int>) of a frontier; without
    metrics no score."""
    members = sets.select("set_id", F.explode("selected").alias("idx"))
    out = sets.join(stats.average_redundancy(members, red), "set_id")
    if metrics is not None:
        out = out.join(metrics.select("set_id", F.round("score", 6).alias("score")), "set_id")
    score = ["score"] if metrics is not None else []
    return out.select("k", "method", *score, F.round(100 * (1 - F.col("k") / n), 2).alias("reduction"), F.round("value", 6).alias("redundancy"))
