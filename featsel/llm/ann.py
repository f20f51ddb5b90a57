"""Approximate nearest neighbours by multiprobe p-stable hashing, with exact reranking."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from featsel.llm.common import table, written

#: Members of a bucket, and queries of it, that meet in one task at most.
MEMBERS, QUERIES = 4096, 1024


@dataclass(frozen=True)
class Index:
    """Settings of the index. Vectors are scaled by the largest norm and get one more component that
    makes them all unit vectors, so that the largest inner product is the smallest distance. Each
    of `tables` hash functions cuts `projections` random (Gaussian, 2-stable) projections into cells of `width`;
    a query visits `probes` cells of each, its own and those it would most likely miss to."""

    tables: int = 8
    projections: int = 4
    width: float = 1.25
    probes: int = 27
    seed: int = 3

    def planes(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        shape = (self.tables, self.projections)
        return rng.normal(size=(dim + 1, *shape)).reshape(dim + 1, -1), rng.uniform(0, self.width, shape).ravel()

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell numbers (n, tables, projections), and how far into its cell each projection is (0 to 1)."""
        a, b = self.planes(unit.shape[1] - 1)
        at = ((unit @ a + b) / self.width).reshape(len(unit), self.tables, self.projections)
        cell = np.floor(at)
        return cell.astype(np.int64), at - cell

    def keys(self, cells: np.ndarray) -> np.ndarray:
        """One integer for each table's cells (..., tables, projections)."""
        out = np.zeros(cells.shape[:-1], np.int64)
        for k in range(self.projections):
            out = out * 8191 + (cells[..., k] + 4095)
        return out * self.tables + np.arange(self.tables).reshape((self.tables,) if out.ndim == 2 else (self.tables, 1))

    def visits(self, cells: np.ndarray, into: np.ndarray) -> np.ndarray:
        """Keys (n, tables, probes) of the cells to visit, likeliest first: moving by -1 or +1 along
        a projection costs the squared distance to that border of the cell."""
        moves = np.array(list(product((-1, 0, 1), repeat=self.projections)))
        cost = np.stack([into**2, np.zeros_like(into), (1 - into) ** 2], axis=-1)
        total = sum(cost[:, :, k, moves[:, k] + 1] for k in range(self.projections))
        order = np.argsort(total, axis=-1, kind="stable")[..., : self.probes]
        return self.keys(cells[:, :, None, :] + moves[order]) if len(cells) else np.empty((0, self.tables, self.probes), np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _addressed(rows: DataFrame, index: Index, largest: float, query: bool) -> DataFrame:
    """(rep, vec) -> one row for each bucket it lies in (members) or visits (queries)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = _matrix(part.column("vec"))
                norm = np.linalg.norm(x, axis=1, keepdims=True)
                if query:
                    unit = np.hstack([x / norm, np.zeros_like(norm)])
                else:
                    unit = np.hstack([x / largest, np.sqrt(np.maximum(0, 1 - (norm / largest) ** 2))])
                cells, into = index.cells(unit)
                keys = index.visits(cells, into) if query else index.keys(cells)[:, :, None]
                each = keys.shape[1] * keys.shape[2]
                who = pa.array(np.repeat(np.arange(len(x)), each))
                yield pa.record_batch([pa.array(keys.ravel()), part.column("rep").take(who), part.column("vec").take(who)], names=["key", "rep", "vec"])

    return rows.select("rep", "vec").mapInArrow(run, "key long, rep long, vec array<double>")


def _best(members: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """q, rep, score: for every query the `k` members of largest inner product in each part of each
    bucket (key) that both share. Buckets of any size are cut into parts on both sides."""
    n = members.groupBy("key").agg(F.count("*").alias("n"))
    m = queries.groupBy("key").agg(F.count("*").alias("m"))
    size = written(
        n.join(m, "key").select("key", F.ceil(F.col("n") / MEMBERS).cast("int").alias("a"), F.ceil(F.col("m") / QUERIES).cast("int").alias("b"))
    )
    part = lambda of: F.pmod(F.xxhash64("rep", F.lit(of)), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = members.join(size, "key").select("key", part("a").alias("x"), every("b").alias("y"), "rep", "vec")
    right = queries.join(size, "key").select("key", every("a").alias("x"), part("b").alias("y"), "rep", "vec")

    def run(found, asked):
        if not (found.num_rows and asked.num_rows):
            return pa.table({"q": pa.array([], pa.int64()), "rep": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        rep, q = found.column("rep").to_numpy(), asked.column("rep").to_numpy()
        order = np.argsort(rep)  # ties to the smaller id
        rep, x = rep[order], _matrix(found.column("vec").combine_chunks())[order]
        y = _matrix(asked.column("vec").combine_chunks())
        at, score = [], []
        for i in range(0, len(y), 128):
            s = y[i : i + 128] @ x.T
            if s.shape[1] > k:
                floor = np.partition(s, -k, axis=1)[:, -k, None]
                over = s > floor
                tie = s == floor
                tie &= np.cumsum(tie, axis=1) <= k - over.sum(axis=1, keepdims=True)
                keep = over | tie
            else:
                keep = np.ones_like(s, bool)
            r, c = np.nonzero(keep)
            at.append((r + i, c))
            score.append(s[r, c])
        r, c = (np.concatenate(z) for z in zip(*at))
        return pa.table({"q": pa.array(q[r]), "rep": pa.array(rep[c]), "score": pa.array(np.concatenate(score))})

    return left.groupBy("key", "x", "y").cogroup(right.groupBy("key", "x", "y")).applyInArrow(run, "q long, rep long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, index: Index = Index()) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of `queries` the `k` rows of `vectors` found with the
    largest inner product (in double precision), nearest first, ties to the smaller vec_id; rows
    with the query's own vec_id don't count. All others, if there are fewer than k.

    Both are (vec_id, embedding). Equal vectors are one entry of the index with the k + 1 smallest
    ids, and one query, so that copies, however many, meet once. Every entry is in the index; each query's
    candidates from all tables are reranked by the exact product. A query that found fewer than it should is
    compared with all entries, block by block. Recall against brute force is measured in the tests.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows with a
    null vec_id; vectors of different lengths aren't compared. Repeated rows are one; empty tables
    give no rows; other columns are ignored."""
    clean = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))

    def entries(df: DataFrame) -> DataFrame:
        df = df.select(F.col("vec_id").cast("long").alias("id"), clean.alias("vec")).where("id is not null and vec is not null")
        return df.where(~bad & F.exists("vec", lambda x: x != 0)).distinct()

    base = entries(vectors)
    base = written(base.withColumn("dim", F.size("vec")))
    asked = written(entries(queries).withColumn("dim", F.size("vec")))
    out = None
    for (dim,) in base.select("dim").distinct().orderBy("dim").collect():  # as many as there are vector lengths
        one = _nearest(base.where(F.col("dim") == dim), asked.where(F.col("dim") == dim), k, index)
        out = one if out is None else out.union(one)
    return asked.selectExpr("id query_id", "1 rank", "id vec_id", "0D score").limit(0) if out is None else out


def _nearest(base: DataFrame, asked: DataFrame, k: int, index: Index) -> DataFrame:
    # equal vectors: the smallest k + 1 ids stand for all; ids are ranked in two steps, so that no group is in one task
    salted = Window.partitionBy("h", "vec", "s").orderBy("id")
    few = base.withColumns({"h": F.xxhash64("vec"), "s": F.pmod(F.xxhash64("id"), F.lit(64))})
    few = few.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1)
    groups = few.groupBy("h", "vec").agg(F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("ids"))
    groups = written(groups.select(F.element_at("ids", 1).alias("rep"), "vec", "ids"))
    asks = written(asked.groupBy("vec").agg(F.min("id").alias("rep")))
    largest = groups.agg(F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    wanted = min(k + 1, groups.select(F.sum(F.size("ids"))).first()[0] or 0)

    members, visits = _addressed(groups, index, largest, False), _addressed(asks, index, largest, True)
    found = _best(members, visits, k + 1).groupBy("q", "rep").agg(F.max("score").alias("score"))
    found = written(_cut(found, k + 1))
    have = found.join(groups.select("rep", F.size("ids").alias("n")), "rep").groupBy("q").agg(F.sum("n").alias("n")).where(F.col("n") >= wanted)
    short = written(asks.join(have.select(F.col("q").alias("rep")), "rep", "left_anti"))
    if not short.isEmpty():
        all_ = _best(groups.select(F.lit(0).alias("key"), "rep", "vec"), short.select(F.lit(0).alias("key"), "rep", "vec"), k + 1)
        found = found.union(_cut(all_.groupBy("q", "rep").agg(F.max("score").alias("score")), k + 1)).distinct()
    of = asked.join(asks.select("vec", F.col("rep").alias("q")), "vec").select(F.col("id").alias("query_id"), "q")
    ids = found.join(groups.select("rep", "ids"), "rep").select("q", "score", F.explode("ids").alias("vec_id"))
    rank = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    ids = ids.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= k + 1).drop("r")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    rows = of.join(ids, "q").where("vec_id <> query_id").withColumn("rank", rank).where(F.col("rank") <= k)
    return rows.select("query_id", "rank", "vec_id", "score")


def _cut(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "rep"))
    return found.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
