"""Preparation and the whole job on small tables whose results are known."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from featsel.functions import text
from featsel.jobs.selection import select_features
from featsel.operators import evaluate, objective, positions, prepare, report, search, stats
from featsel.sinks.tables import csv_columns, write_csv, write_report


def rows(df):
    return [tuple(r) for r in df.collect()]


def people(spark, n=36):
    data = [("" if i == 3 else str(20 + i), ("north", "south", "west")[i % 3], str(i % 7), "yes" if i % 2 else "no") for i in range(n)]
    return spark.createDataFrame(data, "age string, region string, signal string, outcome string")


def test_preparation_of_gaps_and_categories(spark):
    ready = prepare.prepare(people(spark), "outcome")
    assert [f[0] for f in ready.features] == ["age", "region = north", "region = south", "region = west", "signal"]
    assert ready.task == "classification" and ready.rows == 36
    got = rows(ready.data.select("label", "f_0"))
    assert sum(y for y, _ in got) == 18 and sorted(a for _, a in got)[18] == 38.0 and sum(a == 38.0 for _, a in got) == 2
    assert ("age", "missing or invalid numbers were filled with the median") in ready.notes
    strongest = prepare.prepare(people(spark), "outcome", max_features=2)
    assert len(strongest.features) == 2 and ready.note_table().count() == len(ready.notes)


def test_free_text(spark):
    data = [(20 + i, f"Device report {i} has repeated thermal warning words" if i % 2 else f"Device report {i} shows stable normal operation", "yes" if i % 2 else "no") for i in range(40)]
    ready = prepare.prepare(spark.createDataFrame(data, "age int, review string, outcome string"), "outcome")
    names = [f[0] for f in ready.features]
    words = ["normal", "operation", "repeated", "shows", "stable", "thermal"]
    assert names == ["age", "review · text length", "review · word count", "review · digit share", *[f'review · contains "{w}"' for w in words]]
    by_label = rows(ready.data.groupBy("label").agg(F.sum("f_4"), F.sum("f_6")).orderBy("label"))
    assert by_label == [(0.0, 20.0, 0.0), (1.0, 0.0, 20.0)]


def test_kinds_and_odd_columns(spark):
    n = 60
    data = [(i, f"2024-01-{i % 28 + 1:02}", f"K{i:05}", None, True, "same", {"b": i % 3}, float("nan") if i == 5 else i * 0.5, f"v{i % 8}", " NA " if i % 4 else "x", i % 2) for i in range(n)]
    df = spark.createDataFrame(data, "id int, day string, code string, gone string, flag boolean, same string, nested map<string,int>, num double, many string, few string, y int")
    ready = prepare.prepare(df, "y", id_col="id")
    of = {}
    for name, source, kind in ready.features:
        of.setdefault(source, []).append((name, kind))
    assert set(of) == {"day", "nested", "num", "many", "few"}  # identifiers, empty and constant columns are left out
    assert of["day"] == [("day · date", "date")] and len(of["nested"]) == 3 and of["nested"][0][0] == 'nested = {"b":0}'
    assert [x for x, _ in of["many"]] == [f"many = v{i}" for i in range(7)] + ["many = other"] and of["few"] == [("few = x", "category")]
    assert rows(ready.data.where("id = 5").select(f"f_{[f[0] for f in ready.features].index('num')}"))[0][0] == 15.0
    weird = df.select("id", F.col("num").alias("a.b `c`"), F.col("many").alias("select"), "y")
    assert len(prepare.prepare(weird, "y", id_col="id").features) == 9


def test_target_rules(spark):
    few = spark.createDataFrame([(1, 2, 0), (2, 4, 1)], "x int, z int, y int")
    with pytest.raises(ValueError, match="at least 30 rows"):
        prepare.prepare(few, "y")
    df = spark.range(50).selectExpr("id x", "id % 7 z", "if(id < 5, null, id % 3) three", "'1' one", "if(id = 9, 'a', 'b') two", "if(id = 9, 'x', string(id)) mixed")
    assert prepare.infer_task(df, "three") == "regression" and prepare.infer_task(df, "two") == "classification"
    for target, task, message in (("three", "classification", "exactly two"), ("one", "auto", "more than one"), ("mixed", "auto", "a number in every row"), ("two", "regression", "number"), ("two", "guess", "must be auto")):
        with pytest.raises(ValueError, match=message):
            prepare.infer_task(df, target, task)
    kept, gone, n = prepare.drop_missing_target(df, "three")
    assert (gone, n, kept.count()) == (5, 45, 45)
    with pytest.raises(ValueError, match="no target"):
        prepare.prepare(df, "nothing")
    with pytest.raises(ValueError, match="two usable"):
        prepare.prepare(df.select("x", "one", "two"), "two")
    look = prepare.inspect(df, "three")
    assert look.summary.first()["task"] == "regression" and look.summary.first()["error"] is None and look.preview.count() == 4
    look = prepare.inspect(df)  # the last column is no good target
    assert look.summary.first()["target"] == "mixed" and "number" in look.summary.first()["error"] and look.features.count() == 0


def test_exact_median(spark):
    r = random.Random(2)
    for values in ([], [3.0], [1.0, 2.0], [5.0] * 40 + [7.0] * 40, [r.choice([1.0, 2.0, 9.0]) for _ in range(99)], [r.gauss(0, 1) for _ in range(2001)], [2.0**r.randint(-900, 900) for _ in range(500)]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 3, "x double").repartition(5)
        got = prepare.exact_median(df, F.col("x"), together=10)
        assert got == (float(np.median(values)) if values else None)


def test_statistics_leave_out_gaps(spark):
    data = [(float(i), float(i * i % 11), i % 2) for i in range(40)]
    gaps = [*data, (None, 1.0, 1), (2.0, float("nan"), 0), (3.0, 4.0, None)]
    schema = "a double, b double, y int"
    one, two = (stats.moments(spark.createDataFrame(d, schema), ["a", "b"], "y") for d in (data, gaps))
    assert one.total()[0] == two.total()[0] == 40 and np.allclose(stats.correlations(one), stats.correlations(two))
    none = stats.moments(spark.createDataFrame([], schema), ["a", "b"], "y")
    assert none.total()[0] == 0 and not stats.correlations(none).any()
    wide = spark.range(3000).repartition(90).selectExpr("spark_partition_id() % 2 key", "array(cast(id as double), 1d) v")
    assert {k: v.tolist() for k, v in stats.summed(wide).items()} == {k: v.tolist() for k, v in stats.summed(wide.coalesce(5), 5).items()}


def test_significant_digits(spark):
    values = [0.0, 1.0, -2.5, 1234567.891, 1.23456789012, 12345678901.0, 9999999999.9, 9999999998.0, 1e10, 0.0001, 0.00001234, 1e-300, 123456.7890123, 100.0, 1 / 3]
    got = rows(spark.createDataFrame([(v,) for v in values], "v double").select("v", prepare.significant(F.col("v"))))
    assert got == [(v, f"{v:.10g}") for v in values]
    assert rows(spark.createDataFrame([(None,)], "v double").select(prepare.significant(F.col("v")))) == [(None,)]


def test_quotas(spark):
    def quotas(sizes, n):
        return {r["label"]: r["quota"] for r in positions.quotas(spark.createDataFrame(list(sizes.items()), "label int, rows long"), n).collect()}

    assert quotas({0: 30, 1: 10}, 100) == {0: 30, 1: 10}
    for sizes, n in (({0: 333, 1: 167}, 50), ({0: 997, 1: 3}, 10), ({c: 1 + c for c in range(60)}, 50), ({c: 1000 if c == 0 else 1 for c in range(40)}, 50)):
        q = quotas(sizes, n)
        assert sum(q.values()) == max(n, len(sizes)) and all(1 <= q[c] <= sizes[c] for c in q)
    assert quotas({0: 333, 1: 167}, 50) == {0: 33, 1: 17} and quotas({0: 1000, **{c: 1 for c in range(1, 40)}}, 50)[0] == 11


def test_positions_are_bounded_for_skewed_keys(spark):
    # keys that share long beginnings, and one group of three quarters of all rows
    df = spark.range(4_000).selectExpr("id", "if(id % 4 = 0, 'b', 'a') g", "concat(if(id % 8 = 0, '00000000000000', '000000000000'), lpad(hex(id * 7919 % 4001), 4, '0')) k").repartition(5)
    found, longest = positions.prefixes(df, "g", "k", 300)
    assert longest > 8 and max(r["_n"] for r in found.collect()) <= 300
    out = positions.positions(df, "g", "k", 300)
    got = {}
    for r in out.collect():
        got.setdefault(r["g"], []).append((r["position"], r["k"]))
    assert all([p for p, _ in sorted(v)] == list(range(1, len(v) + 1)) and [k for _, k in sorted(v)] == sorted(k for _, k in v) for v in got.values())
    pieces = out.select("g", F.spark_partition_id().alias("p")).count()
    assert pieces == 4_000


def test_large_samples_need_no_sort(spark):
    df = spark.range(30_000).select("id").repartition(6)
    small = {r["id"] for r in positions.sample_rows(df, 7_001, 3, "id").collect()}
    large = positions.sample_rows(df, 7_001, 3, "id", together=50)
    assert {r["id"] for r in large.collect()} == small and len(small) == 7_001
    assert positions.sample_rows(df, 99_999, 3, "id", together=50).count() == 30_000


def test_samples_have_their_size(spark):
    df = spark.range(500).selectExpr("id", "int(id % 50 = 0) c", "id % 40 d").repartition(7)
    for label in ("c", "d"):
        a, b = (rows(positions.validation_sample(x, 50, 1, "id", label).orderBy("id")) for x in (df, df.repartition(3)))
        assert len(a) == 50 and a == b
    assert len(rows(positions.validation_sample(df, 35, 1, "id"))) == 35
    with pytest.raises(ValueError, match="classes"):
        positions.validation_sample(df, 10, 1, "id", "id", classes=100)


def test_runs(spark):
    r = np.random.default_rng(1)
    n, k = 9, 4
    q = np.triu(r.normal(size=(n, n)))
    e = lambda s: q[np.ix_(s, s)].sum()
    runs = search.search_all(spark, [(k, q, 1.0, 8, 120, 5), (2, q, 0.0, 3, 120, 6)])
    best = {x["k"]: x for x in search.best_reads(runs).collect()}
    from itertools import combinations

    for size, extra in ((k, 1.0), (2, 0.0)):
        low = min(e(list(s)) for s in combinations(range(n), size))
        assert abs(best[size]["energy"] - low - extra) < 1e-9 and len(best[size]["selected"]) == size
    assert best[k]["reads"] == best[k]["feasible_reads"] == 8 and best[k]["trace"][-1]["sweep"] == 120 and len(best[k]["trace"]) <= 62
    assert len(search.repaired([0, 1, 2, 3, 4, 5], q, 3)) == 3 and len(search.repaired([], q, 3)) == 3
    with pytest.raises(ValueError, match="too many"):
        objective.all_states(spark, 40)
    assert [objective.frontier_sizes(*x) for x in ((4, 2), (18, 6), (16, 13))] == [[1, 2, 3, 4], [1, 5, 6, 8, 12], [1, 5, 8, 12]]


def experiment(spark):
    data = []
    for i in range(72):
        first, second = (i % 11) / 10, ((i * 7) % 13) / 12
        data.append((first, second, first * 0.96 + second * 0.02, ((i * 17) % 19) / 18, int(first + second > 1.0)))
    return spark.createDataFrame(data, "first double, second double, duplicate double, noise double, label int")


def test_whole_job(spark, tmp_path):
    out = select_features(experiment(spark), "label", 2, quality="fast", seed=3)
    s = out.selection.first()
    assert s["names"] == ["second", "duplicate"] and s["energy"] == -1.745955 and s["feature_reduction"] == 50 and s["search_space_label"] == "6"
    f = {r["name"]: r for r in out.features.collect()}
    assert [r["name"] for r in out.features.orderBy("position").collect()] == ["duplicate", "second", "first", "noise"]
    assert f["first"]["relevance"] == 0.980506 and f["noise"]["relevance"] == 0.000945 and f["duplicate"]["greedy"] and f["first"]["greedy"] and not f["second"]["greedy"]
    assert f["second"]["selected_redundancy"] == 0.113619
    assert sorted({(r["k"], r["method"]) for r in out.frontier.collect()}) == [(k, m) for k in (1, 2, 3, 4) for m in ("QUBO", "Top relevance")]
    b = {r["method"]: r for r in out.benchmark.collect()}
    assert set(b) == {"qubo", "greedy", "all_features"} and all(r["cv_folds"] == 3 and r["validation_samples"] == 72 for r in b.values()) and b["qubo"]["proxy_ops"] == 5
    assert out.frontier.where("k = 2 and method = 'QUBO'").first()["score"] == b["qubo"]["score"]
    i = out.insight.first()
    assert abs(i["redundancy_delta"] - (0.113619 - 0.999789)) < 1e-6 and i["finding"] in (1, 2)
    assert out.terms.count() == 10 and out.trace.first()["feasible_reads"] == 10
    names = write_report(out, str(tmp_path / "report"))
    assert {"selection", "features", "benchmark", "insight", "frontier", "terms", "trace", "data"} <= set(names)
    back = spark.read.json(str(tmp_path / "report/selection")).first()
    assert back["names"] == ["second", "duplicate"] and json.loads(spark.read.text(str(tmp_path / "report/insight")).first()[0])["finding"] == i["finding"]


def test_job_with_bounds_and_regression(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(400, 5))
    y = 3 * x[:, 0] - 2 * x[:, 1] + 0.1 * r.normal(size=400)
    data = [(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, "id int, a double, b double, c double, d double, e double, y double")
    out = select_features(df, "y", 2, quality="fast", id_col="id", max_samples=150)
    b = {m["method"]: m for m in out.benchmark.collect()}
    assert out.selection.first()["names"] == ["a", "b"] and b["qubo"]["score_label"] == "R²" and b["qubo"]["validation_samples"] == 150 and b["qubo"]["score"] > 0.97
    small = select_features(df, "y", 1, quality="fast", id_col="id", max_rows=90)
    assert small.data.count() == 90
    for bad in ({"k": 0}, {"k": 6}, {"k": 2, "lam": 2.5}, {"k": 2, "quality": "best"}):
        with pytest.raises(ValueError):
            select_features(df, "y", **bad, id_col="id")


def test_equal_sets_are_scored_once(spark):
    df = experiment(spark).withColumn("id", F.monotonically_increasing_id())
    out = evaluate.evaluate_subsets(df, ["first", "second", "duplicate", "noise"], "label", "classification", {"x": [0, 1], "y": [1, 0], "z": [2]}, "id", steps=20)
    got = {r["set_id"]: r for r in out.collect()}
    assert got["x"]["score"] == got["y"]["score"] and got["x"]["proxy_ops"] == 5 and got["z"]["proxy_ops"] == 3
    with pytest.raises(ValueError):
        evaluate.evaluate_subsets(df, ["first"], "label", "classification", {"x": []}, "id")


def test_csv_of_a_prepared_table(spark, tmp_path):
    ready = prepare.prepare(people(spark), "outcome")
    write_csv(ready, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.columns == ["age", "region = north", "region = south", "region = west", "signal", "outcome"] and back.count() == 36
    assert {r["outcome"] for r in back.collect()} == {"0", "1"} and csv_columns(ready).where("age = '38'").count() == 2


def test_names_and_digits(spark):
    df = spark.createDataFrame([("net__load-b",), ("--",), ("",), (None,), ("éa",)], "v string")
    assert [r[0] for r in rows(df.select(text.display_name(F.col("v"))))] == ["Net load b", "the selected target", "the selected target", "the selected target", "Éa"]
    m = text.text_measures(spark.createDataFrame([("a1 ² ٣x",)], "t string"), "t").first()
    assert m["digit_share"] == 3 / 7
    assert report.count_label(math.comb(40, 20)) == "1.38 × 10^11" and report.count_label(12345) == "12,345"
