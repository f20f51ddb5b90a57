"""Vector codes: product codebooks trained by Yinyang Lloyd rounds, in exact integer arithmetic."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featsel.llm.common import Scratch, table, written

#: Components are scaled by this and rounded down.
SCALE = 256
#: Larger components (of either sign) aren't representable here: their squares would pass 64 bits.
LARGEST = 2.0**18
#: Entries of a codebook that share a lower bound, about.
GROUP = 10
#: What rounding may do to a bound, relative to it.
ROUNDING = 1e-6


@dataclass(frozen=True)
class Codebooks:
    """entries[p, c]: the integer components of entry c of part p."""

    entries: np.ndarray

    def text(self) -> str:
        return ",".join(map(str, self.entries.ravel().tolist()))

    def sha256(self) -> str:
        return hashlib.sha256(self.text().encode()).hexdigest()

    def groups(self) -> list[list[np.ndarray]]:
        """For each part the entries in groups of near ones (a few rounds of k-means over the entries themselves)."""
        out, k = [], max(1, -(-self.entries.shape[1] // GROUP))
        for e in self.entries.astype(np.float64):
            centres = e[:: max(1, len(e) // k)][:k].copy()
            for _ in range(5):
                of = ((e[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
                for g in range(len(centres)):
                    if (of == g).any():
                        centres[g] = e[of == g].mean(axis=0)
            out.append([np.flatnonzero(of == g) for g in range(len(centres)) if (of == g).any()])
        return out


def _distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances (rows, entries), exact."""
    return sum((x[:, None, k] - entries[None, :, k]) ** 2 for k in range(x.shape[1]))


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 + ROUNDING)).astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    x = np.minimum(x, 1e30)  # a group without other entries has no distances at all
    return np.nextafter((x - np.abs(x) * ROUNDING).astype(np.float32), np.float32(-np.inf))


@dataclass
class State:
    """Of one part of some rows: the nearest entry, an upper bound of its distance, and of each group a lower bound of the
    distances of all its other entries."""

    code: np.ndarray
    upper: np.ndarray
    lower: np.ndarray


def first_state(x: np.ndarray, entries: np.ndarray, groups: list[np.ndarray]) -> State:
    """By all distances."""
    d = _distances(x, entries)
    code = d.argmin(axis=1)
    best = np.take_along_axis(d, code[:, None], 1)[:, 0]
    lower = np.empty((len(x), len(groups)), np.float32)
    rest = d.astype(np.float64)
    np.put_along_axis(rest, code[:, None], np.inf, 1)
    for g, members in enumerate(groups):
        lower[:, g] = _down(np.sqrt(rest[:, members].min(axis=1)))
    return State(code, _up(np.sqrt(best)), lower)


def next_state(x: np.ndarray, was: State, entries: np.ndarray, drift: np.ndarray, groups: list[np.ndarray], counted: list[int] | None = None) -> State:
    """After the entries moved by `drift` each: bounds are adjusted, and only groups whose lower bound no longer exceeds
    the (tightened) upper bound are scanned. Nearness among what is scanned is decided by integers, ties by the lower index."""
    moved = np.array([drift[m].max() for m in groups])
    lower = _down(was.lower.astype(np.float64) - moved * (1 + ROUNDING))
    upper = _up(was.upper.astype(np.float64) + drift[was.code])
    code = was.code.copy()
    rows = np.flatnonzero(lower.min(axis=1) <= upper)
    if not len(rows):
        return State(code, upper, lower)
    y, old = x[rows], code[rows]
    own = ((y - entries[old]) ** 2).sum(axis=1)
    best, at = own.copy(), old.copy()
    tight = _up(np.sqrt(own))
    scan = lower[rows] <= tight[:, None]
    group_of = np.empty(len(entries), np.int64)
    for g, members in enumerate(groups):
        group_of[members] = g
    seen = []
    for g, members in enumerate(groups):
        some = np.flatnonzero(scan[:, g])
        if not len(some):
            continue
        if counted is not None:
            counted.append(len(some) * len(members))
        d = _distances(y[some], entries[members])
        k = d.argmin(axis=1)
        near, which = np.take_along_axis(d, k[:, None], 1)[:, 0], members[k]
        better = (near < best[some]) | (near == best[some]) & (which < at[some])
        best[some[better]], at[some[better]] = near[better], which[better]
        seen.append((g, members, some, d))
    low = lower[rows]
    for g, members, some, d in seen:
        rest = np.where(members[None, :] == at[some][:, None], np.inf, d)
        low[some, g] = _down(np.sqrt(rest.min(axis=1)))
    left = np.flatnonzero((at != old) & ~scan[np.arange(len(rows)), group_of[old]])  # the entry that was left is one of its group's others now
    low[left, group_of[old[left]]] = np.minimum(low[left, group_of[old[left]]], _down(np.sqrt(own[left].astype(np.float64))))
    code[rows], upper[rows], lower[rows] = at, _up(np.sqrt(best)), low
    return State(code, upper, lower)


def _integers(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return np.floor(x * SCALE).astype(np.int64)


def _assigned(rows: DataFrame, books: Codebooks, before: Codebooks | None, grouping: list[list[np.ndarray]], size: int = 2048) -> DataFrame:
    """(row, vec, codes and bounds so far) with new codes and bounds; without `before`, from all distances. The groups stay those of the first pass."""
    parts, entries, _ = books.entries.shape
    drift = None if before is None else np.sqrt(((books.entries - before.entries) ** 2).sum(axis=2).astype(np.float64))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                x = _integers(part.column("vec")).reshape(part.num_rows, parts, -1)
                if before is None:
                    new = [first_state(x[:, p], books.entries[p], grouping[p]) for p in range(parts)]
                else:
                    codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint8).reshape(part.num_rows, parts).astype(np.int64)
                    bounds = np.frombuffer(b"".join(part.column("bounds").to_pylist()), "<f4").reshape(part.num_rows, -1)
                    new, k = [], 0
                    for p in range(parts):
                        g = len(grouping[p])
                        new.append(next_state(x[:, p], State(codes[:, p], bounds[:, k], bounds[:, k + 1 : k + 1 + g]), books.entries[p], drift[p], grouping[p]))
                        k += 1 + g
                codes = np.stack([s.code for s in new], axis=1)
                error = sum(((x[:, p] - books.entries[p][codes[:, p]]) ** 2).sum(axis=1) for p in range(parts))
                bounds = np.concatenate([b for s in new for b in (s.upper[:, None], s.lower)], axis=1).astype("<f4")
                out = [pa.array([r.tobytes() for r in codes.astype(np.uint8)], pa.binary()), pa.array([r.tobytes() for r in bounds], pa.binary()), pa.array(error, pa.int64())]
                yield pa.record_batch([*(part.column(c) for c in ("vec_id", "label", "vec")), *out], names=["vec_id", "label", "vec", "codes", "bounds", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"vec_id long, label {kinds['label']}, vec {kinds['vec']}, codes binary, bounds binary, error long")


def _moved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """Every entry replaced by the rounded-down mean of its parts. Each task adds up its rows; sums of tasks are added by Spark, one
    row for each number of the codebooks."""
    parts, entries, width = books.entries.shape

    def run(batches):
        sums, n = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = _integers(part.column("vec")).reshape(part.num_rows, parts, width)
                codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint8).reshape(part.num_rows, parts)
                for p in range(parts):
                    np.add.at(sums[p], codes[:, p], x[:, p])
                    n[p] += np.bincount(codes[:, p], minlength=entries)
        flat = np.concatenate([sums.ravel(), n.ravel()])
        there = np.flatnonzero(flat)
        yield pa.record_batch([pa.array(there.astype(np.int64)), pa.array(flat[there])], names=["at", "v"])

    found = rows.select("vec", "codes").mapInArrow(run, "at long, v long").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    flat = np.zeros(parts * entries * (width + 1), np.int64)
    flat[found.column("at").to_numpy()] = found.column("v").to_numpy()
    sums, n = flat[: books.entries.size].reshape(books.entries.shape), flat[books.entries.size :].reshape(parts, entries, 1)
    return Codebooks(np.where(n > 0, sums // np.maximum(n, 1), books.entries))


def encode(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, Codebooks | None]:
    """vec_id, label, codes (a byte for each part), error (long), and the final codebooks (None without rows).

    Vectors (vec_id, embedding, label) become integers floor(256 x), cut into `parts` equal parts. A part's codebook starts as
    that part of the first `entries` (at most 256) vectors by vec_id (ties: by vector; null ids last); each round assigns every part to its
    nearest entry (ties: the lower index) and replaces entries by the rounded-down means of their parts; unused ones
    stay. At the end parts are assigned again.

    Assignment is Yinyang Lloyd's: entries lie in groups, a row keeps an upper bound of its own and a lower bound for each
    group, and scans only groups whose bound fails after the entries' drift. Bounds are rounded outwards and integers decide, so the
    result is that of comparing everything. Codes and bounds are written between passes; only codebooks come to the driver.

    Vectors that are null, empty, or hold null, non-finite or components beyond 2^18 are left out; so are those of another
    length than the first one (by vec_id) whose length is a multiple of `parts`. Repeated rows count each; other columns are ignored."""
    if not 0 < entries <= 256:
        raise ValueError("entries must be between 1 and 256")
    kind = vectors.schema["embedding"].dataType.simpleString()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast(kind if kind in ("array<float>", "array<double>") else "array<double>").alias("vec"))
    good = F.size("vec") > 0
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > LARGEST))
    rows = rows.where(F.col("vec").isNotNull() & good & ~bad & (F.size("vec") % parts == 0))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vec")
    length = first.select(F.size("vec")).first()
    if not length:
        return rows.limit(0).select("vec_id", "label", F.lit(b"").alias("codes"), F.lit(0).cast("long").alias("error")), None
    rows = rows.where(F.size("vec") == length[0])
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(entries).select("vec").toArrow().column("vec").combine_chunks()
    books = Codebooks(np.ascontiguousarray(_integers(start).reshape(len(start), parts, -1).transpose(1, 0, 2)))
    grouping, scratch = books.groups(), Scratch(vectors.sparkSession)
    state = _assigned(rows, books, None, grouping)
    for _ in range(rounds):
        state = written(state, scratch)
        before, books = books, _moved(state, books)
        state = _assigned(state, books, before, grouping)
    out = written(state.select("vec_id", "label", "codes", "error"))
    scratch.drop()
    return out, books


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (errors summed over equal labels), codebooks_sha256."""
    coded, books = encode(table(spark, sf_dir, "embeddings"))
    by = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    at = F.col("label").eqNullSafe(F.col("other"))
    out = coded.join(by.withColumnRenamed("label", "other"), at, "left")
    return out.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"))


def _sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """All distances of every round, without bounds."""
    out = f"""with kept as (
  select row_number() over (order by vec_id nulls last, embedding) as row, vec_id, label, list_transform(embedding::double[], lambda x: floor(256 * x)::bigint) as x from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), cut as (select row, p, x[p * len(x) // {parts} + 1 : (p + 1) * len(x) // {parts}] as y from kept, range({parts}) t(p)
), book0 as (select p, row - 1 as c, y as e from cut where row <= {entries}"""
    distance = "list_sum(list_transform(list_zip(y, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint"
    for k in range(rounds + 1):
        out += f""", near{k}), code{k} as (select row, p, min(struct_pack(d := {distance}, c := c)) as best from cut join book{k} using (p) group by row, p""".replace(f", near{k})", ")")
        if k < rounds:
            out += f"""), mean{k} as (select p, c, list(m order by i) as m from (
  select p, best.c as c, i, ((sum(y[i + 1]) - ((sum(y[i + 1]) % count(*)) + count(*)) % count(*)) // count(*))::bigint as m from cut join code{k} using (row, p), range(4096) t(i) where i < len(y) group by p, best.c, i
) group by p, c
), book{k + 1} as (select p, c, coalesce(m, e) as e from book{k} left join mean{k} using (p, c)"""
    out += f"""), final as (select row, string_agg(lpad(printf('%x', best.c::bigint), 2, '0'), '' order by p) as code, sum(best.d)::bigint as error from code{rounds} group by row
), digest as (select sha256(string_agg(array_to_string(e, ','), ',' order by p, c)) as codebooks_sha256 from book{rounds})
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from kept join final using (row), digest"""
    return out


ORACLE_SQL = _sql()
