"""Work that stays bounded: passes for many columns, merges of many partial results, ranges of skewed scores, many features."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from featsel.operators import evaluate, prepare, search, stats


def jobs(spark, run):
    tracker, group = spark.sparkContext.statusTracker(), f"g{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    out = run()
    n = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("", "")
    return out, n


def test_medians_of_many_columns_take_no_more_passes(spark):
    r = random.Random(3)
    make = {0: lambda: r.gauss(0, 1), 1: lambda: float(r.randint(0, 3)), 2: lambda: 5.0, 3: lambda: r.choice([1.0, 2.0]) if r.random() < 0.9 else r.random(), 4: lambda: r.random() * 1e-9 + 7, 5: lambda: 2.0 ** r.randint(-900, 900)}
    data = [[None if r.random() < 0.1 else make[k % 6]() for k in range(24)] for _ in range(1_500)]
    df = spark.createDataFrame(data, ", ".join(f"c{k} double" for k in range(24))).repartition(4)
    few, n_few = jobs(spark, lambda: prepare.exact_medians(df, {f"c{k}": F.col(f"c{k}") for k in range(6)}, together=40))
    same, n_same = jobs(spark, lambda: prepare.exact_medians(df, {f"d{k}": F.col(f"c{k % 6}") for k in range(48)}, together=40))
    all_ = prepare.exact_medians(df, {f"c{k}": F.col(f"c{k}") for k in range(24)}, together=40)
    for k in range(24):
        assert all_[f"c{k}"] == float(np.median([row[k] for row in data if row[k] is not None])), k
    assert all(few[c] == all_[c] for c in few) and all(same[f"d{k}"] == few[f"c{k % 6}"] for k in range(48)) and n_same == n_few


def test_a_hundred_thousand_parts_merge_level_by_level():
    rng = np.random.default_rng(1)
    parts = rng.normal(3.0, 2.0, (100_000, 5, 3))
    stack = np.array([np.concatenate([[5.0], p.mean(axis=0), ((p - p.mean(axis=0)).T @ (p - p.mean(axis=0))).ravel()]) for p in parts])
    whole = parts.reshape(-1, 3)
    while len(stack) > 1:  # as `summed` does
        stack = np.stack([stats.chan(stack[k : k + stats.FAN_IN]) for k in range(0, len(stack), stats.FAN_IN)])
    assert stack[0][0] == len(whole) and np.allclose(stack[0][1:4], whole.mean(axis=0), rtol=1e-12)
    assert np.allclose(stack[0][4:].reshape(3, 3) / len(whole), np.cov(whole.T, bias=True), rtol=1e-10, atol=1e-12)


def test_merges_of_many_tasks(spark):
    wide = spark.range(0, 4_000, 1, 1_100).selectExpr("int(id % 2) key", "array(cast(id as double), 1d) v")
    got = stats.summed(wide)
    assert {k: v.tolist() for k, v in got.items()} == {0: [3998000.0, 2000.0], 1: [4000000.0, 2000.0]}


def test_auc_of_skewed_scores(spark):
    r = random.Random(5)
    score = lambda: r.choice([0.5, 0.5, 0.5 + r.random() * 1e-9, r.random(), 1 / 3])
    data = [(s, int(r.random() < 0.3), score()) for s in ("a", "b") for _ in range(4_000 if s == "a" else 50)] + [("none", 0, 0.1), ("none", 0, 0.2)]
    pred = spark.createDataFrame(data, "set_id string, label int, p double").repartition(5)
    want = {"none": 0.5}
    for s in "ab":
        pos, neg = (np.array([p for x, y, p in data if x == s and y == c]) for c in (1, 0))
        want[s] = float(((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg)))
    for partitions in (None, 1, 7):
        got = {x["set_id"]: x["auc"] for x in evaluate.auc(pred, partitions=partitions).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    ties = pred.groupBy("set_id", "p").count().repartitionByRange(7, "set_id", "p")
    sizes = [x["count"] for x in ties.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 2.5 * sum(sizes) / 7


def test_five_hundred_features_in_seconds():
    rng = np.random.default_rng(2)
    n, k = 500, 20
    r, red = rng.random(n), np.triu(rng.random((n, n)), 1)
    q = np.diag(-r + 2.5 * (1 - 2 * k)) + np.triu(0.65 / (k - 1) * red + 5.0, 1)
    began = time.time()
    chosen, low, trace = search._anneal(q, k, 210, rng)
    assert time.time() - began < 5 and len(set(chosen)) == k and trace[-1][1] <= trace[0][1]
    x = np.zeros(n)
    x[chosen] = 1
    assert abs(x @ q @ x - low) < 1e-6
    top = np.zeros(n)
    top[np.argsort(-r)[:k]] = 1
    assert low <= top @ q @ top + 1e-9


def test_runs_that_leave_the_size(spark):
    """Runs may pass through every size. Terms that make another size cheap leave some without a set of size k, and these are repaired."""
    from itertools import combinations

    rng = np.random.default_rng(4)
    n, k = 12, 5
    q = np.triu(rng.normal(size=(n, n)))
    energy = lambda c: sum(q[i, j] for i in c for j in c)
    low = min(energy(c) for c in combinations(range(n), k))
    runs = search.search_all(spark, [(k, q, 1.0, 12, 60, 3)]).collect()
    assert all(len(r["selected"]) == k and abs(r["energy"] - 1.0 - energy(r["selected"])) < 1e-9 for r in runs)
    assert abs(min(r["energy"] for r in runs) - 1.0 - low) < 1e-9
    # every feature in is far cheaper than any five
    eager = q - np.diag(np.full(n, 1e6))
    runs = search.search_all(spark, [(k, eager, 0.0, 12, 60, 3)])
    found, best = runs.collect(), search.best_reads(runs).first()
    kept = [r["feasible"] for r in found]
    assert 0 < sum(not x for x in kept) and best["feasible_reads"] == sum(kept) and best["reads"] == 12
    assert all(len(set(r["selected"])) == k and abs(r["energy"] - sum(eager[i, j] for i in r["selected"] for j in r["selected"])) < 1e-3 for r in found)
    assert all([t["sweep"] for t in r["trace"]] == [60] for r in found if not r["feasible"])
    assert search.search_all(spark, [(n, q, 0.0, 2, 5, 1)]).where(f"size(selected) = {n}").count() == 2


def test_repair_and_settling_against_all_sets():
    from itertools import combinations

    rng = np.random.default_rng(9)
    for trial in range(20):
        n = int(rng.integers(2, 9))
        k = int(rng.integers(1, n + 1))
        q = np.triu(rng.normal(size=(n, n)))
        energy = lambda c: sum(q[i, j] for i in c for j in c)  # noqa: B023, E731
        got = search.repaired(np.flatnonzero(rng.random(n) < 0.5).tolist(), q, k)
        assert len(got) == k
        swaps = [sorted({*got} - {i} | {j}) for i in got for j in range(n) if j not in got]
        assert all(energy(got) <= energy(c) + 1e-9 for c in swaps)
        dear = q + np.triu(np.full((n, n), 4.0), 1) + np.diag(np.full(n, 2.0 * (1 - 2 * k)))  # 2 (size - k)^2 without its constant
        chosen, low, _ = min((search._anneal(dear, k, 80, rng) for _ in range(4)), key=lambda r: (len(r[0]) != k, r[1]))
        assert energy(chosen) <= min(energy(c) for c in combinations(range(n), k)) + 1e-9 and abs(low + 2.0 * k * k - energy(chosen)) < 1e-9
