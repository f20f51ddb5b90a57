import hashlib
import math

import numpy as np

from featsel.llm import vector_codes as vc
from tests.llm.helpers import rows


def brute(data, parts, entries, rounds):
    """(vec_id, codes, error) by comparing everything, in Python integers."""
    data = sorted(data, key=lambda d: (d[0] is None, d[0] or 0, d[1]))
    x = [[math.floor(256 * v) for v in vec] for _, vec in data]
    w = len(x[0]) // parts
    cut = [[tuple(v[p * w : p * w + w]) for p in range(parts)] for v in x]
    books = [[cut[i][p] for i in range(min(entries, len(x)))] for p in range(parts)]
    dist = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b))

    def assign():
        return [[min(range(len(books[p])), key=lambda c: (dist(row[p], books[p][c]), c)) for p in range(parts)] for row in cut]

    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for c in range(len(books[p])):
                own = [row[p] for row, code in zip(cut, codes) if code[p] == c]
                if own:
                    books[p][c] = tuple(sum(col) // len(own) for col in zip(*own))
    codes = assign()
    text = ",".join(str(v) for p in range(parts) for e in books[p] for v in e)
    return sorted(((d[0], bytes(c), sum(dist(row[p], books[p][c[p]]) for p in range(parts))) for d, c, row in zip(data, codes, cut)), key=str), hashlib.sha256(text.encode()).hexdigest()


def coded(out):
    return sorted(((i, bytes(c), e) for i, c, e in rows(out, "vec_id", "codes", "error")), key=str)


def test_against_all_distances_with_ties_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    data = [(int(i), (rng.integers(-3, 4, 8) / 64).tolist()) for i in rng.permutation(120)]
    data += [(None, data[0][1]), data[1], (7, data[2][1])]  # no id, a repeated row, an id with two vectors
    odd = [(1000, None), (1001, []), (1002, [1.0, None] * 4), (1003, [float("nan")] * 8), (1004, [float("inf")] * 8), (1005, [1e30] * 8), (1006, [1.0] * 4), (1007, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, None if i is None else i % 3, b"x") for i, v in data + odd], "vec_id long, embedding array<float>, label int, codes binary").repartition(5)
    out, books = vc.encode(df, parts=4, entries=16, rounds=3)
    want, digest = brute([(i, np.float32(v).astype(float).tolist()) for i, v in data], 4, 16, 3)
    assert coded(out) == want and books.sha256() == digest


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(3, [0.5, -0.51], None), (1, [0.1, 0.2], None)], "vec_id long, embedding array<double>, label string")
    out, books = vc.encode(df, parts=2, entries=64, rounds=2)
    assert coded(out) == [(1, b"\0\0", 0), (3, b"\1\1", 0)] and books.entries.tolist() == [[[25], [128]], [[51], [-131]]]
    out, books = vc.encode(df.limit(0))
    assert out.count() == 0 and books is None


def test_bounds_give_the_nearest_and_scan_less():
    rng = np.random.default_rng(0)
    x = rng.integers(-200, 200, (3000, 4))
    book = x[:64].copy()
    groups = vc.Codebooks(book[None]).groups()[0]
    assert sorted(np.concatenate(groups).tolist()) == list(range(64))
    state, counted = vc.first_state(x, book, groups), []
    for _ in range(6):
        new = np.array([x[state.code == c].sum(axis=0) // max(1, (state.code == c).sum()) if (state.code == c).any() else book[c] for c in range(64)])
        drift, book = np.sqrt(((new - book) ** 2).sum(axis=1).astype(float)), new
        state = vc.next_state(x, state, book, drift, groups, counted)
        d = vc._distances(x, book)
        assert (state.code == d.argmin(axis=1)).all() and (state.upper**2 >= d.min(axis=1)).all()
        d = d.astype(float)
        d[np.arange(len(x)), state.code] = np.inf
        assert all((state.lower[:, g] <= np.sqrt(d[:, m].min(axis=1))).all() for g, m in enumerate(groups))
    assert sum(counted) < 0.6 * 6 * len(x) * 64
