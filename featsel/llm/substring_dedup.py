"""Passages that repeat across the corpus, found at difference-cover anchors."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featsel.llm.common import Scratch, slices, small, table, written
from featsel.llm.shingles import WordHash, mixed

#: Words in a window.
WINDOW = 35
#: Anchors start at positions whose remainder by this is in the cover.
PERIOD = 21
_P = np.uint64(0x9E3779B97F4A7C15)
_SECOND = np.uint64(0x2545F4914F6CDD1D)


@lru_cache
def difference_cover(period: int) -> tuple[int, ...]:
    """The first smallest set of residues whose differences give every residue of `period`, so
    that for any i and j some d < period has both (i + d) and (j + d) in the set."""
    from itertools import combinations

    size = 1
    while True:
        for rest in combinations(range(1, period), size - 1):
            cover = (0, *rest)
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return cover
        size += 1


def run_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of every run of `width` consecutive items, built by doubling."""
    if len(h) < width:
        return np.empty(0, np.uint64)
    total, at, power, part, size = None, 0, _P, h, 1
    while True:
        if width & size:
            piece = part[at : at + len(h) - width + 1]
            total = piece.copy() if total is None else total * power + piece
            at += size
        size *= 2
        if size > width:
            return mixed(total)
        part = part[: len(part) - size // 2] * power + part[size // 2 :]
        power = np.uint64(int(power) ** 2 % 2**64)


def _key(words: list[bytes]) -> bytes:
    """128 bits by which a word sequence is known."""
    return xxhash.xxh3_128_digest(b" ".join(words))


@F.arrow_udf(T.BinaryType())
def _keys(texts: pa.Array) -> pa.Array:
    return pa.concat_arrays([pa.array([_key(t.split()) for t in part.cast(pa.binary()).to_pylist()], pa.binary()) for part in slices([texts])] or [pa.array([], pa.binary())])


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _row_id() -> Column:
    """The doc_id, or for a null one a hash of the text. The text's own key is checked wherever
    rows are matched by this, so rows that share it do no harm."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(_text()))


def _scan(docs: DataFrame) -> DataFrame:
    """One row per document: row_id, n_words, key (of its word sequence), sha256 of its words
    joined by a space, and the hashes of its anchors, in order of position."""
    cover, width = np.array(difference_cover(PERIOD)), WINDOW - PERIOD + 1

    def run(batches):
        hashed = WordHash()
        for batch in slices(batches):
            n, keys, shas, anchors = [], [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words = text.split()
                n.append(len(words))
                keys.append(_key(words))
                shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
                found = run_hashes(hashed.of(words), width) if len(words) >= WINDOW else np.empty(0, np.uint64)
                places = (np.arange(0, len(found), PERIOD)[:, None] + cover).ravel()
                anchors.append(found[places[places < len(found)]].view(np.int64))
            ends = pa.array(np.cumsum([0, *map(len, anchors)]), pa.int32())
            yield pa.record_batch(
                [batch.column("row_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(shas), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(anchors)))],
                names=["row_id", "n_words", "key", "sha", "anchors"],
            )

    return docs.select("row_id", "text").mapInArrow(run, "row_id long, n_words long, key binary, sha string, anchors array<long>")


def _candidate_windows(docs: DataFrame) -> DataFrame:
    """(tid, text, key, idx: places of repeated anchors) -> every window that contains one of
    them within the cover's reach: tid, its first word, and its 128-bit hash. Rows whose text has another key are left out."""
    cover, width = np.array(difference_cover(PERIOD)), WINDOW - PERIOD + 1

    def run(batches):
        hashed = WordHash()
        for batch in slices(batches, 64):
            keys, idx, tid, out = batch.column("key"), batch.column("idx"), batch.column("tid"), [[], [], [], []]
            for k, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                words = text.split()
                if _key(words) != keys[k].as_py():
                    continue
                places = idx[k].values.to_numpy(zero_copy_only=False)
                p = places // len(cover) * PERIOD + cover[places % len(cover)]
                steps = np.zeros(len(words) + 2, np.int64)
                np.add.at(steps, np.maximum(p + width - WINDOW, 0), 1)
                np.add.at(steps, p + 1, -1)
                starts = np.flatnonzero(np.cumsum(steps)[: len(words) - WINDOW + 1])
                h = hashed.of(words)
                out[0].append(np.full(len(starts), k))
                out[1].append(starts.astype(np.int32))
                out[2].append(run_hashes(h, WINDOW)[starts].view(np.int64))
                out[3].append(run_hashes(mixed(h ^ _SECOND), WINDOW)[starts].view(np.int64))
            if out[0]:
                who, *rest = map(np.concatenate, out)
                yield pa.record_batch([tid.take(pa.array(who)), *map(pa.array, rest)], names=["tid", "first", "h1", "h2"])

    return docs.select("tid", "text", "key", "idx").mapInArrow(run, "tid long, first int, h1 long, h2 long")


class Repeats:
    """Where passages repeat in `docs`.

    scanned: one row per document (row_id, n_words, key, sha, copies: documents with this word sequence)
    windows: key, firsts (first words of its repeated windows), for every word sequence that has
    any and that only one document has; a sequence that several documents have and that fills a
    window is repeated as a whole. With `scratch` these tables go when that is dropped.
    """

    def __init__(self, docs: DataFrame, scratch: Scratch | None = None):
        own = Scratch(docs.sparkSession)
        docs = docs.select("doc_id", _row_id().alias("row_id"), _text().alias("text"))
        # a number for each row, fixed by writing it; the least of its rows' numbers stands for a word sequence
        scanned = written(_scan(docs).withColumn("tid", F.monotonically_increasing_id()), scratch)
        texts = written(scanned.groupBy("key").agg(F.count("*").alias("copies"), F.min("tid").alias("tid")), scratch)
        # 1. anchors that occur more than once, in different texts or in one
        copied = texts.where("copies > 1")
        long = scanned.where(f"n_words >= {WINDOW}").select("tid", "key", "anchors")
        once = long.join(small(copied.select("key")), "key", "left_anti").unionByName(long.join(small(copied.select("tid")), "tid", "left_semi").select(long.columns))
        anchors = once.select("tid", F.posexplode("anchors").alias("idx", "anchor"))
        # what is counted is written before it is joined back: a join of two plain shuffles is one that Spark splits at hot keys
        often = written(anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), own)
        marks = written(anchors.join(often, "anchor").groupBy("tid").agg(F.collect_list("idx").alias("idx")), own)
        marks = written(marks.join(scanned.select("tid", "row_id", "key"), "tid"), own)
        # 2. the windows around them, compared as wholes
        marked = docs.join(small(marks.select("row_id").distinct()), "row_id", "left_semi").select("row_id", "text")
        windows = written(_candidate_windows(marked.join(marks, "row_id")), own)
        twice = written(windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"), own)
        found = windows.join(twice, ["h1", "h2"]).groupBy("tid").agg(F.collect_list("first").alias("firsts"))
        lone = marks.select("tid", "row_id", "key").join(small(copied.select("tid")), "tid", "left_anti")
        self.docs = docs
        self.windows = written(found.join(lone, "tid").select("key", "row_id", "firsts"), scratch)
        self.scanned = scanned.drop("anchors", "tid").join(texts.select("key", "copies"), "key")
        own.drop()

    def whole(self) -> DataFrame:
        """Documents that repeat as a whole: row_id, key."""
        return self.scanned.where(f"copies > 1 and n_words >= {WINDOW}").select("row_id", "key").distinct()

    def shortened(self) -> DataFrame:
        """row_id, key, kept (words outside repeated windows, joined by a space), n_removed, for
        the texts with entries in `windows`."""
        texts = self.docs.join(small(self.windows.select("row_id").distinct()), "row_id", "left_semi")

        def run(batches):
            for batch in slices(batches, 64):
                ids, keys, firsts = batch.column("row_id").to_pylist(), batch.column("key").to_pylist(), batch.column("firsts")
                out = []
                for k, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                    words = text.split()
                    if _key(words) != keys[k]:
                        continue
                    at = firsts[k].values.to_numpy(zero_copy_only=False)
                    steps = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + WINDOW, minlength=len(words) + 1)
                    stays = np.flatnonzero(np.cumsum(steps)[: len(words)] == 0)
                    out.append((ids[k], keys[k], b" ".join([words[i] for i in stays]), len(words) - len(stays)))
                cols = list(zip(*out)) or [[], [], [], []]
                yield pa.record_batch(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary()).cast(pa.string()), pa.array(cols[3], pa.int64())],
                    names=["row_id", "key", "kept", "n_removed"],
                )

        found = texts.select("row_id", "text").join(self.windows, "row_id").select("row_id", "text", "key", "firsts")
        return found.mapInArrow(run, "row_id long, key binary, kept string, n_removed long")


def repeated_words(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of `docs` (doc_id, text).

    A window is 35 consecutive words; a word goes if a window over it has a word sequence that
    also starts anywhere else in the input, in the same document or another. Anchors of 15 words
    are hashed only where the position modulo 21 lies in a difference cover of five residues: two
    equal windows always have an anchor at the same distance in both. Windows around anchors that
    occur more than once are then compared as wholes by 128-bit hashes, counted with map-side
    combining (no pairs). Null texts have no words; a text of under 35 words loses none; rows with
    the same words count as separate documents, also under one doc_id or a null one; an empty table
    gives no rows; columns other than doc_id and text are ignored.
    """
    found = Repeats(docs.select("doc_id", "text"))
    cut = written(found.shortened().select("key", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha")).dropDuplicates(["key"]))
    whole = f"copies > 1 and n_words >= {WINDOW}"
    ids = found.docs.select("row_id", "doc_id").where("doc_id is null").select("row_id").distinct().withColumn("no_id", F.lit(True))
    rows = found.scanned.join(cut, "key", "left").join(small(written(ids)), "row_id", "left")
    return rows.select(
        F.when(F.col("no_id").isNull(), F.col("row_id")).alias("doc_id"),
        "n_words",
        F.expr(f"case when {whole} then n_words else coalesce(n_removed, 0) end").alias("n_removed"),
        F.expr(f"case when {whole} then sha2('', 256) else coalesce(kept_sha, sha) end").alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """`docs` with the text of each document cut to its words outside repeated windows (joined by
    one space); texts that lose nothing stay as they are, and every row stays."""
    scratch = Scratch(docs.sparkSession)
    found = Repeats(docs.select("doc_id", "text"), scratch)
    cut = written(found.shortened().select("row_id", "key", "kept").union(found.whole().selectExpr("row_id", "key", "''")))
    scratch.drop()
    ids = small(cut.select("row_id").distinct())
    rows = docs.select(F.struct(*docs.columns).alias("row"), _row_id().alias("row_id"), _text().alias("text"))
    changed = rows.join(ids, "row_id", "left_semi").withColumn("key", _keys("text"))
    changed = changed.join(cut.dropDuplicates(["row_id", "key"]), ["row_id", "key"], "left")
    new = [F.coalesce("kept", "row.text").alias(c) if c == "text" else F.col(f"row.{c}") for c in docs.columns]
    return rows.join(ids, "row_id", "left_anti").select("row.*").unionByName(changed.select(new))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_words(table(spark, sf_dir, "documents"))
