"""Moments in one distributed pass, and the statistics that follow from them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featsel.sinks.shared import written

#: Below this, a sum of squares counts as zero.
TINY = 1e-15


@dataclass
class Moments:
    """For each fold: n, the sums and the cross products of (columns, label), about `shift`."""

    names: list[str]
    shift: np.ndarray
    folds: dict[int, tuple[float, np.ndarray, np.ndarray]]

    def total(self, but: int | None = None) -> tuple[float, np.ndarray, np.ndarray]:
        parts = [self.folds[f] for f in sorted(self.folds) if f != but]
        return tuple(sum(x[i] for x in parts) for i in range(3))

    def centred(self, but: int | None = None) -> np.ndarray:
        """Cross products about the mean."""
        n, s, c = self.total(but)
        return c - np.outer(s, s) / max(n, 1)


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows without null or NaN in any of the (numeric) columns: the only ones that statistics and models read."""
    return df.dropna(subset=columns)


#: Partial results that one merge adds up at the most.
FAN_IN = 32


def added(stack: np.ndarray) -> np.ndarray:
    """The sum of the rows, by pairs."""
    while len(stack) > 1:
        odd = stack[len(stack) & ~1 :]
        stack = np.concatenate([stack[0 : len(stack) & ~1 : 2] + stack[1 : len(stack) & ~1 : 2], odd])
    return stack[0]


def chan(stack: np.ndarray) -> np.ndarray:
    """Rows of (n, means, products about the means) of parts of a table -> those of the whole, by pairs (Chan's rule)."""
    d = round((-1 + (4 * stack.shape[1] - 3) ** 0.5) / 2)
    while len(stack) > 1:
        a, b, odd = stack[0 : len(stack) & ~1 : 2], stack[1 : len(stack) & ~1 : 2], stack[len(stack) & ~1 :]
        n = np.maximum(a[:, 0] + b[:, 0], 1)
        delta = b[:, 1 : d + 1] - a[:, 1 : d + 1]
        mean = a[:, 1 : d + 1] + delta * (b[:, 0] / n)[:, None]
        outer = (delta[:, :, None] * delta[:, None, :]).reshape(len(a), -1) * (a[:, 0] * b[:, 0] / n)[:, None]
        both = np.concatenate([(a[:, 0] + b[:, 0])[:, None], mean, a[:, d + 1 :] + b[:, d + 1 :] + outer], axis=1)
        stack = np.concatenate([both, odd])
    return stack[0]


def summed(parts: DataFrame, tasks: int | None = None, merge=added) -> dict[int, np.ndarray]:
    """(key int, v array<double>), a few rows a task -> key -> the merge of v. FAN_IN neighbouring tasks are merged at a time, level by level,
    so that a merge (and in the end the driver) holds that many rows of a key however many tasks there were; in a fixed order, so
    that results repeat. tasks: how many tasks there are at the most, if that is known; else their results are written and counted."""
    parts = parts.select("key", F.spark_partition_id().alias("p"), "v")
    if not tasks:
        parts = written(parts)
        tasks = 1 + (parts.agg(F.max("p")).first()[0] or 0)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(pdf.sort_values("p")["v"].tolist())
        return pd.DataFrame({"key": pdf["key"].iloc[:1], "p": pdf["g"].iloc[:1], "v": [merge(v).tolist()]})

    while tasks > FAN_IN:
        parts = parts.withColumn("g", F.floor(F.col("p") / FAN_IN).cast("int")).groupBy("key", "g").applyInPandas(one, "key int, p int, v array<double>")
        tasks = -(-tasks // FAN_IN)
    rows = parts.toPandas().sort_values(["key", "p"])
    return {int(k): merge(np.stack(g["v"].tolist())) for k, g in rows.groupby("key")}


def columns_of(batch: pa.RecordBatch, n: int) -> np.ndarray:
    """The first n columns of an Arrow batch (doubles without nulls), a row each."""
    return np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(n)])


def moments(df: DataFrame, columns: list[str], label: str, fold: str | None = None, weight: str | None = None) -> Moments:
    """One pass over the rows: each task makes the means and products of its rows in numpy, and only (d+1)^2 numbers a task and fold
    travel, which are merged level by level (`summed` by `chan`). Values are shifted by the columns' means first, for
    stability. Rows with a null or NaN in any of the columns don't count; without rows all moments are 0. weight: a column that tells
    how many rows each row stands for."""
    names = [*columns, label]
    kept = [F.col(c).cast("double").alias(c) for c in names]
    rows = df.select(*kept, (F.col(fold) if fold else F.lit(0)).cast("int").alias("_fold"), *([F.col(weight).cast("double").alias("_rows")] if weight else []))
    rows = complete(rows, names)
    first = rows.agg(*[F.avg(c) for c in names]).first()
    shift = np.array([x if x is not None else 0.0 for x in first], float)

    def run(batches):
        state: dict[int, np.ndarray] = {}
        for batch in batches:
            x, f = columns_of(batch, len(names)) - shift[:, None], batch.column(len(names)).to_numpy(zero_copy_only=False)
            w = batch.column(len(names) + 1).to_numpy(zero_copy_only=False) if weight else None
            for k in np.unique(f):
                here = f == k
                part, n = x[:, here], w[here] if weight else np.ones(1)
                total = n.sum() if weight else here.sum()
                mean = (part * n).sum(axis=1) / total
                part = part - mean[:, None]
                new = np.concatenate([[total], mean, ((part * n) @ part.T).ravel()])
                state[int(k)] = chan(np.stack([state[int(k)], new])) if int(k) in state else new
        if state:
            yield pa.record_batch([pa.array(list(state), pa.int32()), pa.array([v.tolist() for v in state.values()], pa.list_(pa.float64()))], ["key", "v"])

    d = len(names)
    folds = {}
    for k, v in sorted(summed(rows.mapInArrow(run, "key int, v array<double>"), merge=chan).items()):
        n, mean, c = float(v[0]), v[1 : d + 1], v[d + 1 :].reshape(d, d)
        folds[k] = (n, n * mean, c + n * np.outer(mean, mean))
    return Moments(names, shift, folds or {0: (0.0, np.zeros(len(names)), np.zeros((len(names),) * 2))})


def correlations(m: Moments) -> np.ndarray:
    """Pearson between all columns and the label; 0 where a column hardly varies."""
    c = m.centred()
    v = np.sqrt(np.maximum(np.diag(c), 0))
    d = np.outer(v, v)
    return np.divide(c, d, out=np.zeros_like(c), where=d > TINY)


def relevance(spark: SparkSession, m: Moments) -> DataFrame:
    """idx, name, r_raw = |corr with the label|, r = r_raw / max (all 0 if the largest is 0)."""
    raw = np.abs(correlations(m)[:-1, -1])
    top = raw.max(initial=0.0)
    return spark.createDataFrame([(i, n, float(x), float(x / top) if top > TINY else 0.0) for i, (n, x) in enumerate(zip(m.names[:-1], raw))], "idx int, name string, r_raw double, r double")


def redundancy(spark: SparkSession, m: Moments) -> DataFrame:
    """i, j, value = |corr| for every pair i < j."""
    c = np.abs(correlations(m))
    d = len(m.names) - 1
    return spark.createDataFrame([(i, j, float(c[i, j])) for i in range(d) for j in range(i + 1, d)], "i int, j int, value double")


def average_redundancy(sets: DataFrame, red: DataFrame) -> DataFrame:
    """sets (set_id, idx) -> set_id, value: mean over the pairs of each set, 0 for a single."""
    pairs = sets.select("set_id", F.col("idx").alias("i")).join(sets.select("set_id", F.col("idx").alias("j")), "set_id").where("i < j")
    mean = pairs.join(red, ["i", "j"], "left").groupBy("set_id").agg(F.avg(F.coalesce("value", F.lit(0.0))).alias("value"))
    return sets.select("set_id").distinct().join(mean, "set_id", "left").select("set_id", F.coalesce("value", F.lit(0.0)).alias("value"))


def feature_overlap(rel: DataFrame, chosen: list[int], red: DataFrame) -> DataFrame:
    """idx, overlap: mean redundancy of each feature with the chosen ones other than itself."""
    both = red.union(red.select("j", "i", "value")).where(F.col("j").isin(chosen))
    mean = both.groupBy(F.col("i").alias("idx")).agg(F.avg("value").alias("overlap"))
    return rel.select("idx").join(mean, "idx", "left").select("idx", F.coalesce("overlap", F.lit(0.0)).alias("overlap"))
