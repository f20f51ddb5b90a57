"""Near-duplicate vectors by PCA-ordered tiles: leading dimensions first, suffix norms bound the rest."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featsel.llm.common import small, table, written
from featsel.llm.components import connected_components

#: Vectors that a tile holds at the most, and numbers (rows x length) it holds at the most.
TILE, TILE_NUMBERS = 4096, 2**23
#: Numbers (rows x length) of the hash sample that the principal axes and the tiles' borders are fitted on. They decide
#: the cost only: every pair that may link is compared whatever they are.
SAMPLE_NUMBERS = 1_500_000
#: Leading coordinates whose ranges are known of every tile.
LEADING = 8
#: Shares of the length after which the rest of a product is bounded.
STOPS = (0.25, 0.5)
#: What single precision may be off by; bounds are widened by it, and pairs that pass them are computed in double precision.
SLACK = 1e-4


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and the norms, also where squares leave the range of a double."""
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / top
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / norm, norm * top


def axes(sample: np.ndarray) -> np.ndarray:
    """The principal axes (columns) of unit vectors about the origin, most weight first."""
    _, v = np.linalg.eigh(sample.T @ sample)
    return np.ascontiguousarray(v[:, ::-1])


def splits(sample: np.ndarray, leaves: int) -> tuple | None:
    """A tree of (coordinate, border, below, above) with about `leaves` leaves: each node is cut at the median of its widest coordinate."""
    if leaves < 2 or len(sample) < 2:
        return None
    k = int(np.argmax(np.ptp(sample, axis=0)))
    border = float(np.median(sample[:, k]))
    low = sample[:, k] < border
    if not low.any():
        return None
    return k, border, splits(sample[low], leaves // 2), splits(sample[~low], leaves - leaves // 2)


def leaf_of(tree: tuple | None, x: np.ndarray) -> np.ndarray:
    """The number of the leaf that each row lies in."""
    out, after = np.zeros(len(x), np.int64), 0

    def walk(node, rows):
        nonlocal after
        if node is None:
            out[rows] = after
            after += 1
            return
        k, border, below, above = node
        low = x[rows, k] < border
        walk(below, rows[low])
        walk(above, rows[~low])

    walk(tree, np.arange(len(x)))
    return out


def joined(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Merge the classes of u[i] and v[i] in `parent`, where every node points to the smallest of its class."""
    while True:
        a, b = parent[u], parent[v]
        apart = a != b
        if not apart.any():
            return
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up


def linked(x: np.ndarray, y: np.ndarray | None, basis: np.ndarray, threshold: float, rows: int = 512):
    """(i, j) arrays, block by block, of the pairs of rows of x and y (None: of x with itself, i < j) whose cosine reaches the threshold.

    Products of the leading coordinates on the axes come first, for all pairs at once; a pair goes on only while what it has
    plus the product of the norms of both rests can reach the threshold. Survivors are computed from the original vectors."""
    d = x.shape[1]
    stops = [*dict.fromkeys(max(1, round(d * s)) for s in STOPS), d]
    own = y is None
    ux, uy = _unit(x)[0], None if own else _unit(y)[0]
    px = (ux @ basis).astype(np.float32)
    uy, py = (ux, px) if own else (uy, (uy @ basis).astype(np.float32))
    rest = lambda p, c: np.sqrt(np.sum(p[:, c:] ** 2, axis=1)) + np.float32(1e-6)
    rx, ry = [rest(px, c) for c in stops[:-1]], [rest(py, c) for c in stops[:-1]]
    low = np.float32(threshold - SLACK)
    first = stops[0] if len(stops) > 1 else d
    for at in range(0, len(x), rows):
        part = slice(at, at + rows)
        begin = at if own else 0
        s = px[part, :first] @ py[begin:, :first].T
        may = s + rx[0][part, None] * ry[0][None, begin:] >= low if rx else s >= low
        if own:
            may &= np.arange(begin, len(uy))[None, :] > np.arange(at, min(at + rows, len(x)))[:, None]
        i, j = np.nonzero(may)
        if len(i) * 8 > may.size:  # many are alike: one product of whole blocks is cheaper than pairs
            hit = (ux[part] @ uy[begin:].T >= threshold) & may
            i, j = np.nonzero(hit)
            if len(i):
                yield i + at, j + begin
            continue
        for k in range(0, len(i), 32_768):
            r, c = i[k : k + 32_768], j[k : k + 32_768]
            have = s[r, c]
            r, c = r + at, c + begin
            for a, b, wx, wy in zip(stops, stops[1:-1], rx[1:], ry[1:]):
                have = have + np.einsum("ij,ij->i", px[r, a:b], py[c, a:b])
                go = have + wx[r] * wy[c] >= low
                r, c, have = r[go], c[go], have[go]
            hit = np.einsum("ij,ij->i", ux[r], uy[c]) >= threshold
            if hit.any():
                yield r[hit], c[hit]


def _compared(left: pa.Table, right: pa.Table, basis: np.ndarray, threshold: float) -> pa.Table:
    """gid, links (rows that it links with on the other side), root (a gid of its class in this pair of tiles): one row for each
    vector with a link, however many there are."""
    none = pa.table({"gid": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
    if not (left.num_rows and right.num_rows):
        return none
    right = right.rename_columns(left.column_names)
    own = left.column("a")[0].as_py() == left.column("b")[0].as_py()
    gid, many = (np.concatenate([t.column(c).to_numpy() for t in ([left] if own else [left, right])]) for c in ("gid", "n"))
    x, y, shift = _matrix(left.column("vec")), None if own else _matrix(right.column("vec")), 0 if own else left.num_rows
    parent, links = np.arange(len(gid)), np.zeros(len(gid), np.int64)
    for i, j in linked(x, y, basis, threshold):
        j = j + shift
        np.add.at(links, i, many[j])
        np.add.at(links, j, many[i])
        joined(parent, i, j)
    found = links > 0
    return pa.table({"gid": gid[found], "links": links[found], "root": gid[parent[found]]}) if found.any() else none


def _links(reps: DataFrame, dim: int, threshold: float, tile: int) -> DataFrame:
    """gid, links, root of the different vectors (gid, vec, n) of one length: what `_compared` finds in all pairs of tiles."""
    n = reps.count()
    share = min(1.0, SAMPLE_NUMBERS / dim / max(n, 1))
    sample = reps.where(F.pmod(F.xxhash64("gid"), F.lit(1_000_000)) < math.ceil(share * 1_000_000)).select("vec").toArrow()
    unit = _unit(_matrix(sample.column("vec")))[0] if sample.num_rows else np.eye(dim)
    basis, lead = axes(unit), min(LEADING, dim)
    rows = max(2, min(tile, TILE_NUMBERS // dim))
    tree = splits((unit @ basis[:, :lead]), math.ceil(n / rows))

    def placed(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                p = _unit(_matrix(part.column("vec")))[0] @ basis[:, :lead]
                lists = pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), lead).cast(pa.list_(pa.float64()))
                yield pa.record_batch([*(part.column(c) for c in ("gid", "vec", "n")), pa.array(leaf_of(tree, p)), lists], names=["gid", "vec", "n", "leaf", "p"])

    kind = reps.schema["vec"].dataType.simpleString()
    at = written(reps.select("gid", "vec", "n").mapInArrow(placed, f"gid long, vec {kind}, n long, leaf long, p array<double>"))
    sizes = at.groupBy("leaf").agg(F.ceil(F.count("*") / rows).alias("parts"))
    part = F.pmod(F.xxhash64("gid"), F.col("parts"))
    at = at.join(small(sizes), "leaf").withColumn("tile", F.col("leaf") * 2**24 + part)

    # what may hold a pair: squared distances of linked unit vectors are 2 - 2 t at the most, so are those of their leading coordinates
    far = 2 - 2 * threshold + SLACK
    reach = math.sqrt(max(far, SLACK))
    ends = [f(F.col("p")[k]).alias(f"{o}{k}") for k in range(lead) for f, o in ((F.min, "lo"), (F.max, "hi"))]
    boxes = written(at.groupBy("tile").agg(*ends))
    cells = lambda more: F.explode(F.sequence(F.floor(F.col("lo0") / reach) - more, F.floor(F.col("hi0") / reach) + more)).alias("cell")
    one = boxes.select(F.struct("*").alias("x"), cells(0))
    two = boxes.select(F.struct("*").alias("y"), cells(1))
    gap = lambda k: F.greatest(F.lit(0.0), F.col(f"x.lo{k}") - F.col(f"y.hi{k}"), F.col(f"y.lo{k}") - F.col(f"x.hi{k}"))
    apart: Column = sum((gap(k) * gap(k) for k in range(lead)), F.lit(0.0))
    pairs = one.join(two, "cell").where((F.col("x.tile") <= F.col("y.tile")) & (apart <= far)).select(F.col("x.tile").alias("a"), F.col("y.tile").alias("b"))
    pairs = small(written(pairs.distinct()))
    left = at.join(pairs, at["tile"] == pairs["a"]).select("a", "b", "gid", "n", "vec")
    right = at.join(pairs, at["tile"] == pairs["b"]).select(*[F.col(c).alias(f"r_{c}") for c in ("a", "b", "gid", "n", "vec")])
    run = lambda x, y: _compared(x, y, basis, threshold)
    return left.groupBy("a", "b").cogroup(right.groupBy("r_a", "r_b")).applyInArrow(run, "gid long, links long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, tile: int = TILE) -> DataFrame:
    """vec_id, n_links (other rows linked directly: cosine of at least `threshold`, above 0, in double precision), component_id (the smallest
    vec_id reachable by links), kept (vec_id = component_id) for every row of `vectors` (vec_id, embedding).

    Equal vectors are one entry with a count, so copies, however many, are compared once. Entries are rotated to the principal
    axes of a sample and cut into tiles of at most `tile` entries along the leading coordinates; tiles too far apart for any link never
    meet. Inside a pair of tiles products accumulate from the leading axes on and stop when the norms of the rests can't
    bring them to the threshold (`linked`). A tile pair returns counts and the classes it found, no pairs, so a
    group of near copies costs rows in proportion to its size. The result is exact: no link is lost.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different lengths
    aren't compared. Rows without a vec_id are left out, rows that repeat id and vector are one; rows that share an id with different
    vectors stay rows of their own. Other columns are ignored. Empty tables give no rows."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    kind = vectors.schema["embedding"].dataType
    kept = kind if kind.simpleString() in ("array<float>", "array<double>") else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kept).alias("vec")).where("vec_id is not null").distinct()
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = written(rows.withColumn("good", F.coalesce(~bad & F.exists("vec", lambda x: x != 0), F.lit(False))))
    good = rows.where("good").select("vec_id", "vec")
    groups = good.groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first(F.size("vec")).alias("dim"))
    groups = written(groups.withColumn("gid", F.monotonically_increasing_id()))
    found = None
    for (dim,) in groups.select("dim").distinct().orderBy("dim").collect():  # as many as there are lengths
        one = _links(groups.where(F.col("dim") == dim), dim, threshold, tile)
        found = one if found is None else found.union(one)
    own = F.struct(F.col("vec_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    alone = rows.where("not good").select("vec_id", own.alias("o"))
    if found is None:
        out = alone
    else:
        found = written(found)
        links = found.groupBy("gid").agg(F.sum("links").alias("links"))
        label = connected_components(found.select(F.col("gid").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "gid")
        named = groups.select("gid", "rep", "n")
        least = label.join(named, "gid").groupBy("component").agg(F.min("rep").alias("least"))
        of = label.join(least, "component").select("gid", "least")
        known = groups.join(links, "gid", "left").join(of, "gid", "left")
        known = known.select("vec", F.struct(F.coalesce("least", "rep").alias("component_id"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")).alias("o"))
        out = good.join(known, "vec").select("vec_id", "o").unionByName(alone)
    return out.select("vec_id", "o.n_links", "o.component_id", (F.col("vec_id") == F.col("o.component_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as u, b.vec_id as w from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.9
), reach as (
  select vec_id as s, vec_id as t from embeddings
  union
  select s, links.w from reach join links on links.u = t
), lowest as (select s, min(t) as component_id from reach group by s), counts as (select u, count(*) as n from links group by u)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from embeddings join lowest on s = vec_id left join counts on u = vec_id
"""
