"""Equal rows are one with a weight: models, moments and metrics as if they were repeated."""

import random

import numpy as np
from pyspark.sql import functions as F

from featsel.operators import evaluate, stats


def test_weights_are_repeated_rows(spark):
    r = random.Random(2)
    data = [(float(r.randint(0, 9)), r.gauss(0, 1), float(r.random() < 0.4), k % 3, float(r.randint(1, 4))) for k in range(300)]
    one = spark.createDataFrame(data, "a double, b double, label double, fold int, n double")
    many = one.select("*", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n", "col")
    back = evaluate.merged(many, ["a", "b", "label", "fold"])
    assert back.agg(F.count("*"), F.sum(evaluate.ROWS)).first() == (300, sum(x[4] for x in data))
    m, w = stats.moments(many, ["a", "b"], "label", "fold"), stats.moments(one, ["a", "b"], "label", "fold", "n")
    assert m.total()[0] == w.total()[0] and np.allclose(m.centred(but=1), w.centred(but=1), rtol=1e-10)
    sets = {"a": [0], "both": [0, 1]}
    models, weighted = evaluate.fit_logistic(many, m, sets, "fold", 8), evaluate.fit_logistic(one, w, sets, "fold", 8, "n")
    assert models.keys() == weighted.keys() and all(np.allclose([*models[k][0], models[k][1]], [*weighted[k][0], weighted[k][1]], rtol=1e-9) for k in models)
    pred = evaluate.predictions(many, ["a", "b"], models, "fold", "label", True).withColumn("p", F.round("p", 3))
    same = evaluate.predictions(one, ["a", "b"], models, "fold", "label", True, "n").withColumn("p", F.round("p", 3))
    for metric in (evaluate.classification_metrics, evaluate.auc):
        x, y = (sorted(map(tuple, found.collect())) for found in (metric(pred), metric(same, weight="n")))
        assert [v[0] for v in x] == [v[0] for v in y] and np.allclose([v[1:] for v in x], [v[1:] for v in y], rtol=1e-12)
