import numpy as np

from featsel.functions import text
from featsel.operators import evaluate, objective, positions, prepare, search, stats
from featsel.sources.tables import read_delimited, read_json_lines


def rows(df):
    return [tuple(r) for r in df.collect()]


def four(spark):
    rel = spark.createDataFrame([(0, "a", 1.0), (1, "b", 0.92), (2, "c", 0.78), (3, "d", 0.2)], "idx int, name string, r double")
    red = spark.createDataFrame([(0, 1, 0.96), (0, 2, 0.08), (0, 3, 0.02), (1, 2, 0.06), (1, 3, 0.04), (2, 3, 0.15)], "i int, j int, value double")
    return rel, red


def test_objective_of_four_features(spark):
    rel, red = four(spark)
    terms = objective.build_terms(rel, red, 2, 0.9)
    q = {(i, j): round(c, 6) for i, j, c in rows(terms)}
    assert q[0, 0] == -8.5 and q[3, 3] == -7.7 and q[0, 1] == 5.864 and q[2, 3] == 5.135
    states = objective.all_states(spark, 4)
    a = dict(rows(objective.energies(states, terms, objective.offset(2), 4)))
    b = dict(rows(objective.direct_objective(states, rel, red, 2, 4, 0.9)))
    assert len(a) == 16 and all(abs(a[s] - b[s]) < 1e-9 for s in a) and abs(a[0b101] + 1.708) < 1e-9
    runs = search.search(spark, terms, 2, 5, 40, constant=objective.offset(2))
    best = search.best_read(runs).first()
    assert best["selected"] == [0, 2] and rows(runs.orderBy("read")) == rows(search.search(spark, terms, 2, 5, 40, constant=10.0).orderBy("read"))
    for k in (0, 5):
        try:
            objective.build_terms(rel, red, k)
            raise AssertionError
        except ValueError:
            pass


def test_scalar_rules(spark):
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        values = {"2024-01-02": 19724, "2024/01/02": 19724, "1/2/2024": 19724, "13/2/2024": 19766, "2024-01-02T06:00:00": 19724.25, "2/30/2024": None, "2024": None}
        got = dict(rows(spark.createDataFrame([(v,) for v in values], "v string").select("v", text.as_days(text.F.col("v")))))
        assert got == values
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    values = {"1,234": 1234, "12%": 0.12, "1e3": 1000, "inf": None, "1d": None, "abc": None, " 7 %": 0.07}
    got = dict(rows(spark.createDataFrame([(v,) for v in values], "v string").select("v", text.as_number(text.F.col("v")))))
    assert all(got[k] == v or abs(got[k] - v) < 1e-12 for k, v in values.items())
    df = spark.createDataFrame([("",), (" NA ",), ("NULL",), ("?",), (None,), ("x",)], "v string")
    assert [r[0] for r in rows(df.select(text.is_missing(text.F.col("v"))))] == [True] * 5 + [False]
    assert text.clean_headers([" a", "a", "", "a_2"]) == ["a", "a_2", "column_3", "a_2_2"]


def test_positions_and_folds(spark):
    df = spark.range(500).selectExpr("id", "id % 3 = 0 c").repartition(7)
    keyed = df.withColumn("k", positions.order_key(1, "id"))
    got = {(i): p for i, _, _, p in rows(positions.positions(keyed, "c", "k"))}
    import hashlib

    key = lambda i: hashlib.md5(f"1:{i}".encode()).hexdigest()
    for c in (True, False):
        ids = sorted((i for i in range(500) if (i % 3 == 0) == c), key=key)
        assert [got[i] for i in ids] == list(range(1, len(ids) + 1))
    folds = rows(positions.assign_folds(df, 3, 1, "id", "c").groupBy("c", "fold").count())
    assert max(n for *_, n in folds if n < 100) - min(n for *_, n in folds if n < 100) <= 1
    sample = rows(positions.validation_sample(df, 50, 1, "id", "c"))
    assert len(sample) == 50 and abs(sum(c for _, c in sample) - 17) <= 1
    assert len(rows(positions.sample_rows(df, 35, 9, "id"))) == 35


def test_models_against_direct_loops(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 3)) * [1, 5, 0.1] + [0, 100, 3]
    y = x @ [1.0, 0.3, 4.0] + r.normal(size=300)
    data = [(*map(float, a), float(b), float(b > y.mean()), i % 3) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, "a double, b double, c double, y double, z double, fold int").repartition(5)
    fold = np.arange(300) % 3

    def loops(sub, target, logistic):
        p = np.zeros(300)
        for f in range(3):
            tr, te = fold != f, fold == f
            mu, sd = x[tr][:, sub].mean(0), x[tr][:, sub].std(0)
            a, t = (x[:, sub] - mu) / sd, target.copy()
            ym, ys = (0, 1) if logistic else (t[tr].mean(), t[tr].std())
            t = (t - ym) / ys
            w, b = np.zeros(len(sub)), 0.0
            for e in range(64):
                z = a[tr] @ w + b
                err = (1 / (1 + np.exp(-z)) if logistic else z) - t[tr]
                s, ridge = (0.16 / (1 + 0.012 * e), 0.012) if logistic else (0.075 / (1 + 0.009 * e), 0.01)
                w, b = w - s * (a[tr].T @ err / tr.sum() + ridge * w), b - s * err.mean()
            z = a[te] @ w + b
            p[te] = 1 / (1 + np.exp(-z)) if logistic else z * ys + ym
        return p

    m = stats.moments(df, ["a", "b", "c"], "y", "fold")
    got = evaluate.linear_scores(m, {"s": [0, 2]})["s"]
    p = loops([0, 2], y, False)
    assert abs(got[0] - (1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())) < 1e-9
    m = stats.moments(df, ["a", "b", "c"], "z", "fold")
    models = evaluate.fit_logistic(df, m, {"s": [0, 1], "t": [2]}, "fold")
    pred = evaluate.predictions(df, ["a", "b", "c"], models, "fold", "z", True)
    z = (y > y.mean()).astype(float)
    for s, sub in (("s", [0, 1]), ("t", [2])):
        q = loops(sub, z, True)
        part = pred.where(f"set_id = '{s}'")
        assert abs(rows(part.agg(evaluate.F.sum("p")))[0][0] - q.sum()) < 1e-6
        want = np.mean([(a > b) + 0.5 * (a == b) for a in q[z == 1] for b in q[z == 0]])
        assert abs(evaluate.auc(part).first()["auc"] - want) < 1e-9


def test_preparation(spark, tmp_path):
    data = [(str(20 + i) if i != 3 else "", ["north", "south", "west"][i % 3], str(i % 7), "yes" if i % 2 else "no") for i in range(36)]
    path = tmp_path / "t.csv"
    path.write_text("age;region;signal;outcome\n" + "\n".join(";".join(r) for r in data))
    df = read_delimited(spark, str(path))
    assert df.columns == ["age", "region", "signal", "outcome"] and df.count() == 36
    kinds = dict(rows(prepare.infer_kinds(prepare.profile_columns(df), prepare.distinct_counts(df, df.columns))))
    assert kinds == {"age": "numeric", "region": "category", "signal": "numeric", "outcome": "category"}
    assert prepare.infer_task(df, "outcome") == "classification"
    out = prepare.encode_target(prepare.expand_categories(df, "region"), "outcome", "classification")
    out = prepare.fill_median(out.withColumn("age", text.as_number(text.F.col("age"))), ["age"])
    assert out.where("signal = '3' and label = 1").count() and 38.0 in {r[0] for r in rows(out.select("age"))}
    assert [c for c in out.columns if "=" in c] == ["region = north", "region = south", "region = west"]
    (tmp_path / "t.jsonl").write_text('{"b": 1, "a": {"x": 2}}\n{"a": null, "c": true}\n')
    assert rows(read_json_lines(spark, str(tmp_path / "t.jsonl"))) == [("1", '{"x": 2}', None), (None, None, "true")]
