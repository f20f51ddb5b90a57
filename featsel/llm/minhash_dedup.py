"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact check."""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featsel.llm.common import Scratch, slices, small, table, written
from featsel.llm.components import connected_components
from featsel.llm.shingles import MinHash, WordHash, shingle_set

#: 32 bands of 4 rows miss a pair of similarity 0.75 with probability (1 - 0.75^4)^32 = 5e-6.
BANDS, ROWS = 32, 4
SIZE = BANDS * ROWS
#: Hashes of the longer signature that members of undecided buckets get.
LONG = 512
#: Signature hashes compared at once by the sequential test.
BATCH = 16
#: Members of a bucket that meet as many others in one task (some 10 MB of signatures).
BLOCK = 4096
#: A pair that is just similar enough is pruned with this probability at the most, over all looks together.
MISS = 1e-4


def pruned(least: tuple[int, ...], similarity: float, batch: int = BATCH) -> float:
    """Probability that a pair of this similarity has fewer matches than `least` asks at any of the looks."""
    one = np.array([comb(batch, k) * similarity**k * (1 - similarity) ** (batch - k) for k in range(batch + 1)])
    alive = np.ones(1)
    for need in least:
        alive = np.convolve(alive, one)
        alive[:need] = 0
    return 1 - alive.sum()


@lru_cache
def fewest_matches(percent: int, miss: float = MISS, size: int = SIZE, batch: int = BATCH) -> tuple[int, ...]:
    """For each number of hashes compared (batch, 2 batch, ...): the fewest matches with which
    P(similarity >= percent/100 | matches) is still at least a bound, under a uniform prior (the
    posterior is a beta distribution, integrated on a grid). Losses at the looks add up, so the bound is
    `miss` halved until a pair of similarity percent/100 is pruned with probability `miss` at the most
    over all looks (`pruned`)."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    bound = miss
    while True:
        out: list[int] = []
        for n in range(batch, size + 1, batch):
            for m in range(out[-1] if out else 0, n + 1):
                log = m * np.log(grid) + (n - m) * np.log1p(-grid)
                p = np.exp(log - log.max())
                if p[grid >= percent / 100].sum() >= bound * p.sum():
                    out.append(m)
                    break
        if pruned(tuple(out), percent / 100, batch) <= miss:
            return tuple(out)
        bound /= 2


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, digest d1 d2 of the whole shingle set, its signature
    (128 x 16 bits) and band keys. Texts without words have no digest, signature or bands."""

    def run(batches):
        hashed, minhash = WordHash(), MinHash(SIZE)
        for batch in slices(batches):
            sets = [shingle_set(t or b"", hashed) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            full = [s for s in sets if len(s)]
            sig = minhash(full) if full else np.empty((0, SIZE), np.uint32)
            keys = np.full((len(full), BANDS), np.uint64(0x51ED270B))
            keys += np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            for r in range(ROWS):
                keys ^= sig[:, r::ROWS]
                keys *= np.uint64(0x9E3779B97F4A7C15)
                keys ^= keys >> np.uint64(29)
            where = np.cumsum([len(s) > 0 for s in sets]) - 1
            has = np.array([len(s) > 0 for s in sets])
            digests = np.array([_digest(s) for s in full], np.int64).reshape(-1, 2)
            pick = lambda rows: [rows[w] if h else None for w, h in zip(where, has)]  # noqa: B023, E731
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(pick(digests[:, 0].tolist()), pa.int64()),
                    pa.array(pick(digests[:, 1].tolist()), pa.int64()),
                    pa.array(pick([s.tobytes() for s in sig.astype(np.uint16)]), pa.binary()),
                    pa.array(pick(list(keys.view(np.int64))), pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "d1", "d2", "sig", "bands"],
            )

    schema = "doc_id long, n_shingles long, d1 long, d2 long, sig binary, bands array<long>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _digest(s: np.ndarray) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _alive(u: np.ndarray, v: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Compare signatures row by row (either side may be one row), batch by batch, and drop a pair
    once it has fewer matches than its posterior needs: the places of those left, their matches."""
    n = max(len(u), len(v))
    left, found = np.arange(n), np.zeros(n, np.int64)
    for k, need in enumerate(least):
        part = slice(k * BATCH, (k + 1) * BATCH)
        a, b = (x[:, part] if len(x) == 1 and n > 1 else x[left, part] for x in (u, v))
        found[left] += (a == b).sum(axis=1)
        left = left[found[left] >= need]
        if not len(left):
            break
    return left, found[left]


def _signatures_of(column: pa.Array, size: int = SIZE) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, size)


def _long_signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> u (the doc_id), sig: LONG hashes of 16 bits; texts without words are left out."""

    def run(batches):
        hashed, minhash = WordHash(), MinHash(LONG, seed=11)
        for batch in slices(batches):
            sets = [shingle_set(t or b"", hashed) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            keep = [k for k, s in enumerate(sets) if len(s)]
            if keep:
                sig = minhash([sets[k] for k in keep]).astype(np.uint16)
                ids = batch.column("doc_id").take(pa.array(keep))
                yield pa.record_batch([ids, pa.array([s.tobytes() for s in sig], pa.binary())], names=["u", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, "u long, sig binary")


def _similar_signatures(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v, sig_u, sig_v) that the sequential test doesn't prune, with their matches."""
    least = np.array(fewest_matches(percent))

    def run(batches):
        for batch in slices(batches, 4096):
            left, found = _alive(*(_signatures_of(batch.column(c)) for c in ("sig_u", "sig_v")), least)
            keep = pa.array(left)
            yield pa.record_batch([batch.column("u").take(keep), batch.column("v").take(keep), pa.array(found)], names=["u", "v", "matches"])

    return pairs.select("u", "v", "sig_u", "sig_v").mapInArrow(run, "u long, v long, matches long")


def _between_groups(members: DataFrame, long: DataFrame, percent: int, best: bool, scratch: Scratch) -> DataFrame:
    """Pairs (u, v) of different groups inside a bucket that the sequential test doesn't prune.

    `members`: band, u, g (group); `long`: u, sig, bands (all of u's), which join once the members are dealt out. A bucket is cut into blocks of BLOCK members and every two
    of its blocks meet in a task of their own, so that a task holds two blocks however large the
    bucket is, and pairs are compared without being written; a pair that shares several buckets is
    returned in the first of its bands only. best: only the best partner of each
    member in each two blocks; else every one that is left."""
    least = np.array(fewest_matches(percent, size=LONG))
    sizes = written(members.groupBy("band").agg(F.count("*").alias("n")), scratch)
    packs = max(1, (sizes.where(f"n <= {BLOCK}").agg(F.sum("n")).first()[0] or 0) // BLOCK)
    few = F.col("n") <= BLOCK  # many small buckets share a task
    sizes = sizes.select(
        "band",
        F.when(few, F.pmod(F.xxhash64("band"), F.lit(packs))).otherwise(F.col("band")).alias("pack"),
        F.when(few, F.lit(1)).otherwise(F.ceil(F.col("n") / BLOCK)).cast("int").alias("blocks"),
    )
    rows = members.join(small(written(sizes, scratch)), "band").withColumn("block", F.pmod(F.xxhash64("u"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("*", other).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})

    def run(key, part):
        u, g, band = (part.column(c).to_numpy() for c in ("u", "g", "band"))
        sig, block = _signatures_of(part.column("sig"), LONG), part.column("block").to_numpy()
        all_bands = part.column("bands").combine_chunks().flatten().to_numpy().reshape(len(u), BANDS)
        _, lo, hi = (k.as_py() for k in key[:3])
        second = np.flatnonzero(block == hi)
        second = second[np.argsort(band[second], kind="stable")]
        bands = band[second]
        out = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i in np.flatnonzero(block == lo):
            to = second[np.searchsorted(bands, band[i]) : np.searchsorted(bands, band[i], "right")]
            to = to[g[to] != g[i]]
            if lo == hi and not best:
                to = to[u[to] > u[i]]
            if len(to):
                same = all_bands[to] == all_bands[i]
                to = to[all_bands[i][same.argmax(axis=1)] == band[i]]
            if len(to):
                left, found = _alive(sig[i : i + 1], sig[to], least)
                if best and len(left):
                    left = left[[np.lexsort((u[to[left]], -found))[0]]]
                out[0].append(np.full(len(left), u[i]))
                out[1].append(u[to[left]])
        a, b = map(np.concatenate, out)
        return pa.table({"u": pa.array(np.minimum(a, b)), "v": pa.array(np.maximum(a, b))})

    rows = rows.join(long, "u")
    return rows.groupBy("pack", "lo", "hi", "blocks").applyInArrow(run, "u long, v long").distinct()


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, the full set of shingle hashes."""

    def run(batches):
        hashed = WordHash()
        for batch in slices(batches):
            sets = [shingle_set(t or b"", hashed).view(np.int64) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
            yield pa.record_batch([batch.column("doc_id"), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets)))], names=["doc_id", "shingles"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, shingles array<long>")


def _confirmed(docs: DataFrame, pairs: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (u, v) whose full shingle sets are similar enough; both ends are doc_ids."""
    ends = written(pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct(), scratch)
    n = ends.count()
    if not n:
        return pairs.select("u", "v").limit(0)
    sets = written(shingle_sets(docs.join(small(ends), "doc_id", "left_semi")), scratch)
    of = lambda x: sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"set_{x}"))
    both = F.size(F.array_intersect("set_u", "set_v"))
    union = F.size("set_u") + F.size("set_v") - both
    linked = pairs.select("u", "v").join(of("u"), "u").join(of("v"), "v").where(100 * both >= percent * union).select("u", "v")
    return written(linked.coalesce(max(8, n // 2_000)), scratch)


def near_duplicates(docs: DataFrame, percent: int = 75, tables: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the group), kept (one row per group).

    1. Every text becomes its set of 5-word shingles; equal sets (a group of exact copies, however
       large) fall together by a 128-bit digest with map-side combining, and one representative
       goes on.
    2. Representatives that share a band are candidates. Every bucket first links its members to
       its smallest one (a star, not all pairs); signatures of the candidates are compared batch
       by batch, pruning by the posterior. Each representative's best star edge is confirmed on
       full sets, which makes the first groups.
    3. In buckets that still hold several groups the pairs between different groups are tested in
       the same way on longer signatures (pairs inside a group can't change it): first only each
       member's best partner, to join what belongs together, then every pair. A pair of similarity
       percent/100 is lost here with probability MISS at the most (and 5e-6 at 0.75 by the bands).
    4. Groups are the connected components of the confirmed links.

    A null or blank text has no shingles, links with nothing and is kept. A null doc_id takes no
    part: component_id null, kept true. Rows that share a doc_id count as one document with
    several texts. Columns other than doc_id and text are ignored; an empty table gives no rows.
    With `tables` the written tables that the result reads go when that is dropped.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scratch = Scratch(docs.sparkSession)
    seen = written(signatures(docs), tables)
    sets = written(
        seen.where("d1 is not null and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), scratch
    )
    copies = seen.join(sets.where("n > 1"), ["d1", "d2"]).where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    reps = written(
        seen.join(sets.withColumnRenamed("rep", "doc_id"), ["d1", "d2", "doc_id"], "left_semi")
        .dropDuplicates(["doc_id", "d1", "d2"]).select("doc_id", "sig", "bands"), scratch
    )
    # what is counted by band is written before it is joined back: Spark can split a join of two plain shuffles at hot keys
    buckets = reps.select(F.col("doc_id").alias("node"), F.explode("bands").alias("band"))
    hubs = written(buckets.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub < top").select("band", "hub"), scratch)
    shared = written(buckets.join(hubs, "band"), scratch)

    sig = reps.select("doc_id", "sig")
    stars = shared.where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct()
    stars = stars.join(sig.toDF("u", "sig_u"), "u").join(sig.toDF("v", "sig_v"), "v")
    best = _similar_signatures(stars, percent).groupBy("u").agg(F.max_by("v", F.struct("matches", -F.col("v"))).alias("v"))
    links = _confirmed(docs, written(best, scratch), percent, scratch)
    long = None
    for only_best in (True, False):
        groups = small(written(connected_components(links).select(F.col("node").alias("u"), F.col("component").alias("g")), scratch))
        member = written(shared.withColumnRenamed("node", "u").join(groups, "u", "left").select("band", "u", F.coalesce("g", "u").alias("g")), scratch)
        open_ = written(member.groupBy("band").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi").select("band"), scratch)
        member = member.join(small(open_), "band", "left_semi")
        if long is None:
            ids = small(written(member.select(F.col("u").alias("doc_id")).distinct(), scratch))
            long = _long_signatures(docs.join(ids, "doc_id", "left_semi"))
            long = written(long.join(reps.join(ids, "doc_id", "left_semi").select(F.col("doc_id").alias("u"), "bands"), "u"), scratch)
        left = _between_groups(written(member, scratch), long, percent, only_best, scratch)
        links = written(links.union(_confirmed(docs, written(left, scratch), percent, scratch)), scratch)

    groups = written(connected_components(links.union(copies)), tables)
    scratch.drop()
    out = seen.select("doc_id", "n_shingles").join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component", "doc_id")).drop("component")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The documents that `near_duplicates` keeps, with all their columns and every row of theirs."""
    gone = near_duplicates(docs, percent).where("not kept").select("doc_id").distinct()
    return docs.join(small(written(gone)), "doc_id", "left_anti")


def one_of_each_group(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One document of each group of `near_duplicates`, each of its texts once, with all columns.

    Rows that share a doc_id are one document: its different texts stay, each once. A row
    without doc_id is a document of its own, known by its text; of a group that has documents with an id, one of these
    stays. Blank texts are no copies of each other, but rows that also repeat a doc_id are one."""
    text, two = F.col("text").cast("string"), F.lit(2**62)
    by_text = two + F.shiftrightunsigned(F.xxhash64(text), 2)  # above any other doc_id
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), by_text).alias("_id"), text.alias("text"))
    tables = Scratch(docs.sparkSession)
    found = near_duplicates(rows.select(F.col("_id").alias("doc_id"), "text"), percent, tables)
    gone = written(found.where("not kept").select(F.col("doc_id").alias("_id")).distinct())
    tables.drop()
    rows = rows.join(small(gone), "_id", "left_anti")
    again = small(written(rows.groupBy("_id").count().where("count > 1").select("_id")))
    once = rows.join(again, "_id", "left_anti")
    # texts are told apart by 128 bits; repeats combine before they are shuffled
    first = rows.join(again, "_id", "left_semi").groupBy("_id", F.xxhash64("text"), F.xxhash64(F.lit(1), "text")).agg(F.first("row").alias("row"))
    return once.select("row.*").union(first.select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
