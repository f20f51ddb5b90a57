"""The whole job: from a table to a chosen set of inputs and its comparison with plain rankings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from featsel.operators import evaluate, objective, report, search, stats
from featsel.operators.positions import sample_rows
from featsel.operators.prepare import Prepared, prepare, row_id
from featsel.sinks.shared import written

#: Folds and steps of the comparison; every set gets the same.
FOLDS, STEPS = 3, 64


@dataclass
class Result:
    """Small tables, except `data`, which is the prepared table.

    selection: the chosen set; features: every input; benchmark: chosen, greedy and all inputs; insight: the difference; frontier:
    sets of other sizes; terms: the objective with names; trace: the best run; inputs and notes: of the preparation.

    benchmark, insight and frontier need the models of all sets, which are trained once, when the first of these is asked for."""

    data: DataFrame
    selection: DataFrame
    features: DataFrame
    terms: DataFrame
    trace: DataFrame
    inputs: DataFrame
    notes: DataFrame
    compare: Callable[[], tuple[DataFrame, DataFrame, DataFrame]] = field(repr=False)

    @cached_property
    def _compared(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return self.compare()

    @property
    def benchmark(self) -> DataFrame:
        return self._compared[0]

    @property
    def insight(self) -> DataFrame:
        return self._compared[1]

    @property
    def frontier(self) -> DataFrame:
        return self._compared[2]

    def tables(self) -> dict[str, DataFrame]:
        """All tables by name."""
        names = ("data", "selection", "features", "benchmark", "insight", "frontier", "terms", "trace", "inputs", "notes")
        return {name: getattr(self, name) for name in names}


def choose(spark: SparkSession, m: stats.Moments, k: int, lam: float, quality: str, seed: int) -> tuple[DataFrame, DataFrame, dict[int, dict], dict[int, list[int]]]:
    """relevance, redundancy, and for k and every size of the frontier the best run (selected, energy, trace, reads, feasible_reads)
    and the top of the plain ranking. All sizes are searched in one job."""
    rel, red = stats.relevance(spark, m), stats.redundancy(spark, m)
    n = len(m.names) - 1
    if quality not in search.QUALITY:
        raise ValueError("quality must be fast, balanced or deep")
    if not 1 <= k <= n:
        raise ValueError(f"k must be between 1 and {n}")
    if not 0 <= lam <= 2:
        raise ValueError("lam must be between 0 and 2")
    reads, sweeps = search.QUALITY[quality]
    # relevance and redundancy are the driver's already; so are the terms of every size
    jobs = []
    for size in sorted({k, *objective.frontier_sizes(n, k)}):
        effort = (reads, sweeps, seed) if size == k else (max(7, reads // 3), max(80, sweeps // 2), seed + 13 * size)
        jobs.append((size, objective.matrix(m, size, lam), objective.offset(size), *effort))
    best = {r["k"]: r.asDict(recursive=True) for r in search.best_reads(search.search_all(spark, jobs)).collect()}
    order = objective.ranking(m)
    return rel, red, best, {size: order[:size] for size in best}


def select_features(
    df: DataFrame, target: str, k: int, task: str = "auto", lam: float = objective.LAMBDA, quality: str = "balanced", seed: int = 42,
    id_col: str | None = None, max_rows: int | None = None, max_features: int | None = None, max_samples: int | None = None,
) -> Result:
    """Chooses k inputs of a table that are tied to the target and repeat each other little, and compares them with the k most
    relevant ones and with all, on the same folds; and sets of other sizes (the frontier).

    All rows count; `max_rows` takes a repeatable sample first, `max_features` keeps the strongest inputs, and `max_samples`
    bounds the rows of the comparison. Rows are read for: the preparation, one pass of moments, and the comparison of all sets together."""
    if max_rows:
        keyed = df if id_col else df.withColumn("_id", row_id(df))
        df = sample_rows(keyed, max_rows, seed, id_col or "_id")
        df = df if id_col else df.drop("_id")
    return selected(prepare(df, target, task, id_col, max_features), k, lam, quality, seed, max_samples)


def selected(ready: Prepared, k: int, lam: float = objective.LAMBDA, quality: str = "balanced", seed: int = 42, max_samples: int | None = None) -> Result:
    """`select_features` for a prepared table."""
    spark, columns, n = ready.data.sparkSession, ready.columns, len(ready.features)
    data = written(ready.data)
    m = stats.moments(data, columns, "label")
    m.names[:-1] = [name for name, *_ in ready.features]
    rel, red, best, top = choose(spark, m, k, lam, quality, seed)

    pair = spark.createDataFrame([("chosen", i) for i in best[k]["selected"]] + [("greedy", i) for i in top[k]], "set_id string, idx int")
    energy = spark.createDataFrame([("chosen", best[k]["energy"])], "set_id string, energy double")
    chosen = pair.where("set_id = 'chosen'")
    summary = report.selection_summary(chosen, rel, red, energy).drop("set_id")

    def compare() -> tuple[DataFrame, DataFrame, DataFrame]:
        sets = {f"QUBO {size}": best[size]["selected"] for size in best} | {f"Top relevance {size}": top[size] for size in top} | {"all": list(range(n))}
        metrics = evaluate.evaluate_subsets(data, columns, "label", ready.task, sets, "id", FOLDS, max_samples, STEPS, seed + 49)
        metrics = spark.createDataFrame(metrics.collect(), metrics.schema)  # a row a set
        rows = [(f"{method} {size}", size, method, [int(i) for i in sets[f"{method} {size}"]]) for size in objective.frontier_sizes(n, k) for method in ("QUBO", "Top relevance")]
        frontier_sets = spark.createDataFrame(rows, "set_id string, k int, method string, selected array<int>")
        benchmark = report.benchmark_table(metrics, {f"QUBO {k}": "qubo", f"Top relevance {k}": "greedy", "all": "all_features"})
        overlap = dict(map(tuple, stats.average_redundancy(pair, red).collect()))
        score = {r["set_id"]: r["score"] for r in metrics.collect()}
        both = [(score[f"QUBO {k}"], overlap["chosen"], score[f"Top relevance {k}"], overlap["greedy"])]
        both = spark.createDataFrame(both, "score double, redundancy double, greedy_score double, greedy_redundancy double")
        return benchmark, report.insight(both), report.frontier_table(frontier_sets, red, metrics, n)

    terms = objective.exported_terms(objective.build_terms(rel, red, k, lam), rel)
    trace = [(best[k]["read"], best[k]["reads"], best[k]["feasible_reads"], t["sweep"], round(t["energy"], 6)) for t in best[k]["trace"]]
    trace = spark.createDataFrame(trace, "read long, reads long, feasible_reads long, sweep int, energy double")
    return Result(data, summary, report.feature_table(rel, red, best[k]["selected"], top[k]), terms, trace, ready.feature_table(), ready.note_table(), compare)
