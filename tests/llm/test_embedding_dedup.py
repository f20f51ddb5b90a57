import numpy as np
import pytest

from featsel.llm import embedding_dedup as ed
from tests.llm.helpers import rows


def brute(data, t):
    """(vec_id, n_links, component_id) of (vec_id, vector) by all pairs."""
    good = [k for k, (_, v) in enumerate(data) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    up = list(range(len(data)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    n = [0] * len(data)
    for i in good:
        for j in good:
            a, b = (np.array(data[k][1], float) for k in (i, j))
            if i < j and len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= t:
                n[i] += 1
                n[j] += 1
                x, y = find(i), find(j)
                up[max(x, y, key=lambda k: data[k][0])] = min(x, y, key=lambda k: data[k][0])
    return sorted((d[0], n[k], data[find(k)][0]) for k, d in enumerate(data))


def test_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 10))
    data = [base[i % 12] + rng.normal(size=10) * rng.choice([0.05, 0.3, 2.0]) for i in range(150)]
    data = [(int(i), np.float32(v).astype(float).tolist()) for i, v in zip(rng.permutation(400), data)]
    turn = [[np.cos(a), np.sin(a), *[0.0] * 8] for a in np.arange(0, 3.1, 0.3)]  # a chain of links
    data += [(500 + i, np.float32(v).astype(float).tolist()) for i, v in enumerate(turn)]
    data += [(700 + i, data[5][1]) for i in range(40)] + [(800 + i, [x * 2 ** (i - 5) for x in data[7][1]]) for i in range(10)]  # copies; scaled ones
    data += [(900, [3.0, 4.0]), (901, [3.0, 4.1]), (902, [-3.0, -4.0])]  # another length
    odd = [(1000, None), (1001, []), (1002, [0.0] * 10), (1003, [1.0, None] * 5), (1004, [float("nan")] * 10), (1005, [float("-inf")] * 10)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in data + odd + [data[0], (None, data[0][1])]], "vec_id long, embedding array<float>, label int, kept string").repartition(5)
    for tile in (8, 4096):
        out = rows(ed.near_duplicates(df, 0.9, tile), "vec_id", "n_links", "component_id", "kept")
        assert sorted(r[:3] for r in out) == brute(data + odd, 0.9) and all(k == (i == c) for i, _, c, k in out)


def test_shared_ids_and_empty(spark):
    data = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (0, [1.0, 0.01])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    assert sorted(rows(ed.near_duplicates(df), "vec_id", "n_links", "component_id")) == [(0, 1, 0), (1, 1, 0), (1, 1, 1), (2, 1, 1)]
    assert ed.near_duplicates(df.limit(0)).count() == 0
    none = spark.createDataFrame([(5, None)], "vec_id long, embedding array<double>")
    assert rows(ed.near_duplicates(none), "vec_id", "n_links", "component_id", "kept") == [(5, 0, 5, True)]
    with pytest.raises(ValueError):
        ed.near_duplicates(df, 0.0)


def test_bounds_lose_no_link_and_large_groups_emit_no_pairs(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 24)) * np.linspace(3, 0.1, 24)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i, j in zip(*np.nonzero(u @ u.T >= 0.9)) if i < j}
    got = [set(zip(i.tolist(), j.tolist())) for i, j in ed.linked(x, None, ed.axes(u), 0.9, rows=64)]
    assert set().union(*got) == want and sum(map(len, got)) == len(want)
    cross = [set(zip(i.tolist(), j.tolist())) for i, j in ed.linked(x[:250], x[250:], ed.axes(u), 0.9, rows=64)]
    assert set().union(*cross) == {(i, j - 250) for i, j in want if i < 250 <= j}
    near = [(i, (np.ones(8) + rng.normal(size=8) * 0.01).tolist()) for i in range(900)]
    reps = spark.createDataFrame([(i, v, 1) for i, v in near], "gid long, vec array<double>, n long")
    found = ed._links(reps, 8, 0.9, 128).collect()
    assert len(found) <= 900 * 9 and sum(r["links"] for r in found) == 900 * 899
