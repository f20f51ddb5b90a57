"""Fair comparison of feature sets: the same folds and small models for all."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featsel.operators import positions
from featsel.operators.stats import TINY, Moments, columns_of, complete, moments, summed


#: The column of `merged` that tells how many rows a row stands for.
ROWS = "_rows"


def merged(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of `df` with equal rows as one and how many they are (`ROWS`): models and metrics add up over rows, so that what
    repeats is computed once."""
    return df.groupBy(*columns).agg(F.count("*").cast("double").alias(ROWS))


def _times(weight: str | None) -> Column:
    return F.col(weight) if weight else F.lit(1.0)


def classification_metrics(pred: DataFrame, by: str = "set_id", weight: str | None = None) -> DataFrame:
    """set_id, accuracy (p >= .5), log_loss (p clipped at 1e-9) of rows (set_id, label, p); a row counts `weight` times."""
    n = _times(weight)
    p = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), "p"))
    hit = F.when((F.col("p") >= 0.5).cast("double") == F.col("label"), 1.0).otherwise(0.0)
    loss = -F.when(F.col("label") == 1, F.ln(p)).otherwise(F.ln(1 - p))
    return pred.groupBy(by).agg((F.sum(hit * n) / F.sum(n)).alias("accuracy"), (F.sum(loss * n) / F.sum(n)).alias("log_loss"))


#: Scores that a task sorts, about.
SCORES_A_TASK = 2_000_000


def auc(pred: DataFrame, by: str = "set_id", partitions: int | None = None, weight: str | None = None) -> DataFrame:
    """set_id, auc: area under the ROC curve with average ranks for ties; 0.5 if a class is absent.

    Ties are grouped first, so a score that many rows have is one row. (set, score) is then cut into ranges at splitters
    sampled from what there is, so that ranges hold about as many rows each, however sets and scores are spread. A task
    ranks its range by itself and returns, for each set, its rows, positives and sum of ranks; a range starts after those
    before it, which is carried over those few rows. partitions: ranges (else the session's shuffle partitions).
    A row counts `weight` times."""
    times = _times(weight)
    ties = pred.groupBy(by, "p").agg(F.sum(F.col("label") * times).cast("double").alias("pos"), F.sum(times).cast("double").alias("n"))
    cut = (partitions,) if partitions else ()
    ranged = ties.repartitionByRange(*cut, by, "p").sortWithinPartitions(by, "p")

    def run(batches):
        found: dict = {}
        for pdf in batches:
            for key, g in pdf.groupby(by, sort=False, dropna=False):
                low, pos, n, ranks = found.get(key, (g["p"].iloc[0], 0.0, 0.0, 0.0))
                upto = n + g["n"].cumsum()
                ranks += float((g["pos"] * (upto - (g["n"] - 1) / 2)).sum())
                found[key] = low, pos + float(g["pos"].sum()), float(upto.iloc[-1]), ranks
        if found:
            yield pd.DataFrame([(k, *v) for k, v in found.items()], columns=[by, "low", "pos", "n", "ranks"])

    kind = pred.schema[by].dataType.simpleString()
    parts = ranged.mapInPandas(run, f"{by} {kind}, low double, pos double, n double, ranks double")
    before = Window.partitionBy(by).orderBy("low").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    parts = parts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0.0)))
    a = parts.groupBy(by).agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"), F.sum(F.col("ranks") + F.col("start") * F.col("pos")).alias("ranks"))
    neg = F.col("n") - F.col("pos")
    value = (F.col("ranks") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * neg)
    return a.select(by, F.when((F.col("pos") > 0) & (neg > 0), value).otherwise(0.5).alias("auc"))


def regression_metrics(pred: DataFrame, by: str = "set_id") -> DataFrame:
    """set_id, r2 (0 if the label hardly varies), rmse of rows (set_id, label, p)."""
    e = F.pow(F.col("label") - F.col("p"), F.lit(2))
    a = pred.groupBy(by).agg(F.sum(e).alias("sse"), F.count("*").alias("n"), (F.var_pop("label") * F.count("*")).alias("sst"))
    return a.select(by, F.when(F.col("sst") > TINY, 1 - F.col("sse") / F.col("sst")).otherwise(0.0).alias("r2"), F.sqrt(F.col("sse") / F.col("n")).alias("rmse"))


def standardized(df: DataFrame, columns: list[str], m: Moments, fold: str) -> DataFrame:
    """`df` with z_<column> for each column: centred and scaled by the mean and population deviation of the rows of all other
    folds (a deviation of hardly more than 0 counts as 1). A projection; the moments are those of `stats.moments`."""
    new: dict[str, Column] = {}
    for f in sorted(m.folds):
        n, s, _ = m.total(but=f)
        var = np.diag(m.centred(but=f)) / max(n, 1)
        for i, c in enumerate(columns):
            mean, sd = m.shift[i] + s[i] / max(n, 1), np.sqrt(var[i]) if var[i] > TINY else 1.0
            z, here = (F.col(c) - F.lit(float(mean))) / F.lit(float(sd)), F.col(fold) == f
            new[f"z_{c}"] = F.when(here, z) if f"z_{c}" not in new else new[f"z_{c}"].when(here, z)
    return df.withColumns(new)


def fit_linear(m: Moments, chosen: list[int], steps: int = 64) -> dict[int, tuple[np.ndarray, float]]:
    """fold -> (weights, intercept) on the original scale, and no pass over rows: full-batch steps
    .075 / (1 + .009 e) with ridge .01 on standardised moments of all other folds."""
    out = {}
    for fold in m.folds:
        n, s, _ = m.total(but=fold)
        c = m.centred(but=fold) / max(n, 1)
        sd = np.sqrt(np.where(np.diag(c) > TINY, np.diag(c), 1.0))
        z = c / np.outer(sd, sd)
        a, b = z[np.ix_(chosen, chosen)], z[chosen, -1]
        w = np.zeros(len(chosen))
        for e in range(steps):
            w -= 0.075 / (1 + 0.009 * e) * (a @ w - b + 0.01 * w)
        weights = w * sd[-1] / sd[chosen]
        mean = m.shift + s / max(n, 1)
        out[fold] = (weights, float(mean[-1] - weights @ mean[chosen]))
    return out


def linear_scores(m: Moments, sets: dict[str, list[int]], steps: int = 64) -> dict[str, tuple[float, float]]:
    """set -> (R^2, RMSE) of the cross-validated linear models, from the moments alone."""
    n, _, _ = m.total()
    sst = m.centred()[-1, -1]
    out = {}
    for name, chosen in sets.items():
        sse = 0.0
        for fold, (w, b) in fit_linear(m, chosen, steps).items():
            k, s, c = m.folds[fold]
            v = np.zeros(len(m.names))
            v[chosen], v[-1] = w, -1.0
            const = b + m.shift @ v  # the residual of a row x (about the shift) is x.v + const
            sse += v @ c @ v + 2 * const * (s @ v) + k * const**2
        out[name] = (float(1 - sse / sst) if sst > TINY else 0.0, float(np.sqrt(max(sse, 0) / max(n, 1))))
    return out


def fit_logistic(df: DataFrame, m: Moments, sets: dict[str, list[int]], fold: str, steps: int = 64, weight: str | None = None) -> dict[tuple[str, int], tuple[np.ndarray, float]]:
    """(set, fold) -> (weights, intercept) on the original scale. All models train together: each step is one job over
    the rows, packed once into numpy blocks and persisted, whatever the number of sets; the gradients of the tasks are added up
    in two steps (`stats.summed`). Steps .16 / (1 + .012 e), ridge .012 on the weights, linear term clipped at 35.
    Rows with a null or NaN in a column, the label or the fold don't train; a row counts `weight` times. A block meets only the
    models that train on its fold."""
    from pyspark import StorageLevel

    names, models = m.names[:-1], [(s, f) for s in sets for f in sorted(m.folds)]
    d = len(names)
    use = np.zeros((d, len(models)))
    mean, sd, n = np.zeros((d, len(models))), np.ones((d, len(models))), np.zeros(len(models))
    for k, (s, f) in enumerate(models):
        use[sets[s], k] = 1
        n[k], total, _ = m.total(but=f)
        var = np.diag(m.centred(but=f))[:-1] / max(n[k], 1)
        mean[:, k], sd[:, k] = total[:-1] / max(n[k], 1), np.sqrt(np.where(var > TINY, var, 1.0))
    shift = m.shift[:-1]
    training = {int(f): np.array([k for k, (_, t) in enumerate(models) if t != f], int) for f in m.folds}

    def pack(batches):
        for batch in batches:
            x, f = columns_of(batch, d + 2), batch.column(d + 2).to_numpy(zero_copy_only=False)
            x[:d] -= shift[:, None]
            for k in np.unique(f):
                part = x[:, f == k]
                values = [np.ascontiguousarray(part[:d].T).tobytes(), part[d].tobytes(), part[d + 1].tobytes()]
                yield pa.record_batch([pa.array([int(k)], pa.int32()), *[pa.array([v], pa.binary()) for v in values]], ["fold", "x", "y", "n"])

    kept = [F.col(c).cast("double").alias(c) for c in names]
    rows = df.select(*kept, F.col(m.names[-1]).cast("double").alias("_y"), _times(weight).cast("double").alias("_n"), F.col(fold).cast("int").alias("_fold"))
    rows = complete(rows, [*names, "_fold", "_y"])
    blocks = rows.mapInArrow(pack, "fold int, x binary, y binary, n binary").persist(StorageLevel.MEMORY_AND_DISK)
    tasks = blocks.rdd.getNumPartitions()
    w, b = np.zeros((d, len(models))), np.zeros(len(models))
    for e in range(steps):
        v, c = w / sd, b - (mean * w / sd).sum(axis=0)

        each = {f: (np.ascontiguousarray(v[:, own]), c[own]) for f, own in training.items()}

        def gradient(batches, each=each):
            total = {f: np.zeros((d + 1, len(own))) for f, own in training.items()}
            for batch in batches:
                for at, f in enumerate(batch.column(0).to_pylist()):
                    x, y, n = (np.frombuffer(batch.column(k)[at].as_buffer()) for k in (1, 2, 3))
                    x, (vf, cf), g = x.reshape(-1, d), each[f], total[f]
                    err = x @ vf  # made into the errors in place
                    err += cf
                    np.clip(err, -35, 35, out=err)
                    np.negative(err, out=err)
                    np.exp(err, out=err)
                    err += 1
                    np.reciprocal(err, out=err)
                    err -= y[:, None]
                    err *= n[:, None]
                    g[:d] += x.T @ err
                    g[d] += err.sum(axis=0)
            all_ = np.zeros((d + 1, len(models)))
            for f, own in training.items():
                all_[:, own] += total[f]
            yield pa.record_batch([pa.array([0], pa.int32()), pa.array([all_.ravel().tolist()], pa.list_(pa.float64()))], ["key", "v"])

        g = summed(blocks.mapInArrow(gradient, "key int, v array<double>"), tasks).get(0, np.zeros((d + 1) * len(models))).reshape(d + 1, len(models))
        step = 0.16 / (1 + 0.012 * e)
        w -= step * (use * (g[:d] - mean * g[d]) / sd / np.maximum(n, 1) + 0.012 * w)
        b -= step * g[d] / np.maximum(n, 1)
    blocks.unpersist()
    v = w / sd
    return {k: (v[:, i], float(b[i] - (mean[:, i] * v[:, i]).sum() - v[:, i] @ shift)) for i, k in enumerate(models)}


def predictions(df: DataFrame, columns: list[str], models: dict, fold: str, label: str, logistic: bool, weight: str | None = None) -> DataFrame:
    """set_id, label, p (and `weight`, if given): every row once for each set, by the model that didn't see its fold; a projection."""
    def p(s: str) -> Column:
        value = None
        for (name, f), (w, b) in models.items():
            if name == s:
                z = F.lit(b)
                for c, x in zip(columns, w):
                    z = z + F.lit(float(x)) * F.col(c) if x else z
                z = 1 / (1 + F.exp(-F.least(F.lit(35.0), F.greatest(F.lit(-35.0), z)))) if logistic else z
                value = F.when(F.col(fold) == f, z) if value is None else value.when(F.col(fold) == f, z)
        return value

    each = [F.struct(F.lit(s).alias("set_id"), F.col(label).cast("double").alias("label"), p(s).alias("p"), *([F.col(weight)] if weight else [])) for s in dict.fromkeys(s for s, _ in models)]
    return df.select(F.inline(F.array(*each)))


_METRICS = (
    "set_id string, score double, score_label string, secondary double, secondary_label string, loss double, loss_label string, "
    "cv_folds int, validation_samples long, proxy_ops int"
)


def evaluate_subsets(
    df: DataFrame, columns: list[str], label: str, task: str, sets: dict[str, list[int]], id_col: str, folds: int = 3, max_samples: int | None = None, steps: int = 64, seed: int = 91
) -> DataFrame:
    """Cross-validated scores of several sets of inputs (name -> numbers of columns), one row a set: AUC, accuracy and log loss
    of a small logistic model, or R^2 and RMSE of a linear one; and folds, rows and 2m + 1 operations a row.

    All sets get the same rows (all, or a stratified sample of `max_samples`) and the same folds, and equal sets are
    scored once. For a classification equal rows of a fold are one with a weight. Logistic models of all sets train together, linear ones follow from one pass of moments. An empty set is an error."""
    if not sets or not all(sets.values()):
        raise ValueError("every set needs at least one input")
    spark = df.sparkSession
    distinct = {tuple(sorted(set(s))): None for s in sets.values()}
    names = {key: str(i) for i, key in enumerate(distinct)}
    strata = label if task == "classification" else None
    rows = complete(df.select(id_col, label, *columns), [label, *columns])
    if max_samples:
        rows = positions.validation_sample(rows, max_samples, seed, id_col, strata)
    rows = positions.assign_folds(rows, folds, seed, id_col, strata)
    weight = ROWS if task == "classification" else None
    if weight:
        rows = merged(rows, [label, *columns, "fold"]).persist()
    m = moments(rows, columns, label, "fold", weight)
    n, of = int(m.total()[0]), {name: list(key) for key, name in names.items()}
    if task == "classification":
        models = fit_logistic(rows, m, of, "fold", steps, weight)
        pred = predictions(rows, columns, models, "fold", label, True, weight)
        ranges = max(spark.sparkContext.defaultParallelism, -(-n * len(of) // SCORES_A_TASK))
        found = {r["set_id"]: r for r in classification_metrics(pred, weight=weight).join(auc(pred, partitions=ranges, weight=weight), "set_id").collect()}  # one row a set
        rows.unpersist()
        values = {s: (r["auc"], "ROC AUC", r["accuracy"], "Accuracy", r["log_loss"], "Log loss") for s, r in found.items()}
    else:
        values = {s: (r2, "R²", rmse, "RMSE", rmse, "RMSE") for s, (r2, rmse) in linear_scores(m, of, steps).items()}
    out = [(s, *values[names[key]], folds, n, 2 * len(key) + 1) for s, key in ((s, tuple(sorted(set(x)))) for s, x in sets.items())]
    return spark.createDataFrame(out, _METRICS)
