"""Many seeded annealing runs in parallel: each run is a row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Effort as (reads, sweeps).
QUALITY = {"fast": (10, 110), "balanced": (22, 210), "deep": (40, 340)}
#: About so many checkpoints of a run are traced.
CHECKPOINTS = 48


class _State:
    """A set of features under change. field[i] is what feature i adds to the energy beside the chosen ones, so taking it in or out
    is judged by one number, and done in one row of the terms."""

    def __init__(self, q: np.ndarray, selected):
        self.q, self.off = q, q + q.T
        np.fill_diagonal(self.off, 0.0)
        self.chosen = np.zeros(len(q), bool)
        self.chosen[list(selected)] = True
        self.size = int(self.chosen.sum())
        self.field = np.diag(q) + self.off[:, self.chosen].sum(axis=1)

    def flip(self, i: int) -> None:
        out = self.chosen[i]
        self.chosen[i] = not out
        self.size += -1 if out else 1
        self.field += -self.off[i] if out else self.off[i]

    def energy(self) -> float:
        return float(self.chosen @ self.q @ self.chosen)

    def resize(self, k: int) -> None:
        """Size k by single changes, each the one that costs least (the first feature wins ties)."""
        while self.size != k:
            grow = self.size < k
            cost = self.field if grow else -self.field
            self.flip(int(np.where(self.chosen == grow, np.inf, cost).argmin()))

    def settle(self) -> None:
        """The best swap of a chosen for another feature, until none lowers the energy."""
        while 0 < self.size < len(self.q):
            inside, outside = np.flatnonzero(self.chosen), np.flatnonzero(~self.chosen)
            change = self.field[outside] - self.field[inside][:, None] - self.off[np.ix_(inside, outside)]
            i, j = np.unravel_index(change.argmin(), change.shape)
            if change[i, j] >= -1e-9:
                return
            self.flip(int(inside[i]))
            self.flip(int(outside[j]))


def _anneal(q: np.ndarray, k: int, sweeps: int, rng: np.random.Generator) -> tuple[list[int], float, list[tuple[int, float]]]:
    """Take single features in or out, whatever the size becomes, from a random set of about k. Every sweep offers each feature once,
    then as many swaps as features are chosen, which still move when the terms make another size dear.

    Returns the best set of size k seen, improved by swaps, its energy, and the best energy so far after some of the sweeps. If none
    was of size k: the last set, of another size, its energy, and no trace."""
    n = len(q)
    s = _State(q, np.flatnonzero(rng.random(n) < k / n))
    e, best, low, trace, every = s.energy(), None, np.inf, [], max(1, sweeps // CHECKPOINTS)

    def seen():
        nonlocal best, low
        if s.size == k and e < low - 1e-12:
            best, low = s.chosen.copy(), e

    seen()
    hot = max(1.0, float(np.abs(s.off).max()) / 2)  # then a change of size by one is common
    for sweep, t in enumerate(np.geomspace(hot, 0.005, sweeps), 1):
        # a change for the worse by d is made with probability exp(-d / t)
        for i, gate in zip(rng.permutation(n).tolist(), t * rng.standard_exponential(n)):
            d = -s.field[i] if s.chosen[i] else s.field[i]
            if d <= gate:
                s.flip(i)
                e += d
                seen()
        inside, outside = (np.flatnonzero(x).tolist() for x in (s.chosen, ~s.chosen))
        if inside and outside:
            m = len(inside)
            for a, b, gate in zip(rng.integers(0, m, m), rng.integers(0, n - m, m), t * rng.standard_exponential(m)):
                i, j = inside[a], outside[b]
                d = s.field[j] - s.off[i, j] - s.field[i]
                if d <= gate:
                    s.flip(i)
                    s.flip(j)
                    inside[a], outside[b] = j, i
                    e += d
                    seen()
        if best is not None and (sweep % every == 0 or sweep == sweeps):
            trace.append((sweep, float(low)))
    if best is None:
        return np.flatnonzero(s.chosen).tolist(), s.energy(), []
    s = _State(q, np.flatnonzero(best))
    s.settle()
    trace[-1] = (sweeps, s.energy())
    return np.flatnonzero(s.chosen).tolist(), s.energy(), trace


def repaired(selected: list[int], q: np.ndarray, k: int) -> list[int]:
    """A set made into one of size k, by the single changes that cost least, and improved by swaps."""
    s = _State(q, selected)
    s.resize(k)
    s.settle()
    return np.flatnonzero(s.chosen).tolist()


_RUN = "k int, read long, selected array<int>, energy double, feasible boolean, trace array<struct<sweep:int,energy:double>>"


def search_all(spark: SparkSession, jobs: list[tuple[int, np.ndarray, float, int, int, int]]) -> DataFrame:
    """All runs of several searches in one job. jobs: (k, terms as an upper triangular matrix, constant, reads, sweeps, seed) with
    different k. Returns k, read, selected, energy, feasible, trace (sweep, best energy so far at size k) for every run. A run that
    met no set of size k isn't feasible; its last set is made into one of size k.

    A run's random numbers depend on (seed, k, read) alone, never on the partition. The matrices are as large as the
    number of features squared and go to every task."""
    of = {k: rest for k, *rest in jobs}
    runs = [(k, read) for k, _, _, reads, _, _ in jobs for read in range(reads)]

    def run(batches):
        for pdf in batches:
            out = []
            for i in pdf["id"]:
                k, read = runs[int(i)]
                q, constant, _, sweeps, seed = of[k]
                chosen, low, trace = _anneal(q, k, sweeps, np.random.default_rng([seed, k, read]))
                feasible = len(chosen) == k
                if not feasible:
                    chosen = repaired(chosen, q, k)
                    low = _State(q, chosen).energy()
                    trace = [(sweeps, low)]
                out.append((k, read, chosen, low + constant, feasible, [{"sweep": a, "energy": b + constant} for a, b in trace]))
            yield pd.DataFrame(out, columns=["k", "read", "selected", "energy", "feasible", "trace"])

    return spark.range(len(runs)).repartition(max(1, len(runs))).mapInPandas(run, _RUN)


def matrix(terms: DataFrame) -> np.ndarray:
    """Terms (i <= j) as an upper triangular matrix on the driver."""
    rows = terms.select("i", "j", "coeff").collect()
    q = np.zeros((1 + max(r["j"] for r in rows),) * 2)
    for r in rows:
        q[r["i"], r["j"]] = r["coeff"]
    return q


def search(spark: SparkSession, terms: DataFrame, k: int, reads: int, sweeps: int, seed: int = 42, constant: float = 0.0) -> DataFrame:
    """read, selected, energy, feasible, trace for every run of one search (see `search_all`)."""
    return search_all(spark, [(k, matrix(terms), constant, reads, sweeps, seed)]).drop("k")


def best_read(runs: DataFrame) -> DataFrame:
    """The run of lowest energy; the first one wins ties."""
    return runs.orderBy(F.round("energy", 9), "read").limit(1)


def best_reads(runs: DataFrame) -> DataFrame:
    """For each k the run of lowest energy (the first one wins ties), with `reads` and `feasible_reads`."""
    rank = F.struct(F.round("energy", 9), F.col("read"))
    row = F.struct("read", "selected", "energy", "trace")
    best = runs.groupBy("k").agg(F.min_by(row, rank).alias("best"), F.count("*").alias("reads"), F.count_if("feasible").alias("feasible_reads"))
    return best.select("k", "best.*", "reads", "feasible_reads")
