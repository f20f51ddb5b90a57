"""Frequent phrases by hierarchical pair naming: a phrase is a pair of adjacent shorter phrases that have names."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from featsel.llm.common import Scratch, released, slices, table, written

#: Words of a chunk: a chunk ends with the first text (or the last piece of a long one) that brings it to so many. A task
#: holds the open chunks of all langs, this many times four words in all.
CHUNK = 1_500_000
_BORDER = re.compile(rb"[.,;:!?\x0A-\x0D]")


class _Local(dict):
    """Word -> number from 1 within a chunk; the border of a piece is 0."""

    def __init__(self):
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _chunks(docs: DataFrame, chunk: int) -> DataFrame:
    """(lang, text) -> chunk, lang, seq (numbers of words in order, 0 between pieces), words, n (of each word)."""

    def run(batches):
        open_: dict[str, tuple[_Local, list[np.ndarray], int]] = {}
        part, done = TaskContext.get().partitionId() << 32, 0

        def closed(lang):
            nonlocal done
            words, seqs, _ = open_.pop(lang)
            seq = np.concatenate(seqs)
            n = np.bincount(seq, minlength=len(words))[1:]
            done += 1
            row = {"chunk": part + done, "lang": lang, "seq": seq.astype("<i4").tobytes(), "words": [w.decode() for w in words][1:], "n": n}
            types = {"chunk": pa.int64(), "lang": pa.string(), "seq": pa.binary(), "words": pa.list_(pa.string()), "n": pa.list_(pa.int64())}
            return pa.record_batch([pa.array([row[c]], t) for c, t in types.items()], names=list(types))

        held = 0
        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = _BORDER.sub(b" . ", (text or b"").lower()).split()
                for at in range(0, len(words), 1_000_000):  # a long text goes in by parts; only its last one ends a piece
                    local, seqs, n = open_.get(lang) or (_Local(), [], 0)
                    some = words[at : at + 1_000_000]
                    ids = np.fromiter(map(local.__getitem__, some), np.int32, len(some))
                    last = at + len(some) == len(words)
                    seqs += [ids, np.zeros(1, np.int32)] if last else [ids]
                    open_[lang] = local, seqs, n + len(some)
                    if n + len(some) >= chunk and not last:  # close at the last border, carry the rest over
                        seq = np.concatenate(seqs)
                        borders = np.flatnonzero(seq == 0)
                        if len(borders):
                            cut, names = int(borders[-1]) + 1, list(local)
                            open_[lang] = local, [seq[:cut]], cut
                            yield closed(lang)
                            fresh = _Local()
                            tail = np.array([fresh[names[k]] for k in seq[cut:]], np.int32)
                            open_[lang] = fresh, [tail], len(tail)
                    elif n + len(some) >= chunk:
                        yield closed(lang)
                held += len(words)
                if held >= 4 * chunk:
                    held = sum(n for *_, n in open_.values())
                    if held >= 4 * chunk:
                        yield closed(max(open_, key=lambda x: open_[x][2]))
        for lang in list(open_):
            yield closed(lang)

    return docs.mapInArrow(run, "chunk long, lang string, seq binary, words array<string>, n array<long>")


def _paired(chunks: DataFrame, names: DataFrame, last: bool) -> DataFrame:
    """The next level: chunk, seq (number of the pair that starts at each place, else 0; null in the last level), left and right
    (the names of its two halves), n.

    chunks: chunk, seq; names: chunk, local, id of the numbers that have a name."""

    def run(found: pa.Table, named: pa.Table) -> pa.Table:
        seq = np.frombuffer(found.column("seq")[0].as_py(), "<i4") if found.num_rows else np.empty(0, np.int32)
        local, ids = named.column("local").to_numpy(), named.column("id").to_numpy()
        name = np.zeros(int(max(seq.max(initial=0), local.max(initial=0))) + 1, np.int64)
        name[local] = ids
        there = name[seq] > 0
        both = there[:-1] & there[1:]
        a, b = seq[:-1][both].astype(np.int64), seq[1:][both].astype(np.int64)
        pair, back, n = np.unique(a * len(name) + b, return_inverse=True, return_counts=True)
        out = np.zeros(max(0, len(seq) - 1), "<i4")
        out[both] = back + 1
        lists = {"left": name[pair // len(name)], "right": name[pair % len(name)], "n": n}
        one = pa.list_(pa.int64())
        chunk = found.column("chunk")[0].as_py() if found.num_rows else named.column("of")[0].as_py()
        done = pa.table({"chunk": pa.array([chunk]), "seq": pa.array([None if last else out.tobytes()], pa.binary()), **{c: pa.array([v], one) for c, v in lists.items()}})
        released()
        return done

    both = chunks.select("chunk", "seq").groupBy("chunk").cogroup(names.select(F.col("chunk").alias("of"), "local", "id").groupBy("of"))
    return both.applyInArrow(run, "chunk long, seq binary, left array<long>, right array<long>, n array<long>")


def _named(each: DataFrame, by: list[str], least: int, scratch: Scratch) -> DataFrame:
    """The rows (chunk, local, by, n) of what occurs `least` times in all, with its count a, a name of its own (id), and whether the row is its
    first (head). All rows of a key, one a chunk, meet once: they are counted and named in one shuffle."""
    key = Window.partitionBy(*by)
    rows = each.repartition(*by).withColumn("row", F.monotonically_increasing_id() + 1)
    rows = rows.withColumn("a", F.sum("n").over(key)).where(F.col("a") >= least).withColumn("id", F.min("row").over(key))
    return written(rows.select("chunk", "local", *by, "a", "id", (F.col("row") == F.col("id")).alias("head")), scratch, "zstd")


def phrases(docs: DataFrame, longest: int = 3, least: int = 10, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame, Scratch]:
    """All phrases of up to `longest` words that occur `least` times: id, size, lang, phrase, a (occurrences), first and rest (occurrences of
    its first 1, 2, ... words and of what follows each), left and right (ids of the phrase without its last and first word;
    null for words); the words of every lang (lang, n); and the folder of both, to be dropped after use.

    Texts are cut into chunks that know their own words, so a word travels once a chunk. A word that is frequent gets a
    name (a global id), and each chunk learns the names of its words by a join; then adjacent named places are pairs, which
    are counted and named alike, level by level. Names never come to the driver or to all tasks."""
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    chunks = written(_chunks(texts, chunk), scratch, "zstd")
    words = chunks.select("lang", F.aggregate("n", F.lit(0).cast("long"), lambda x, y: x + y).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    words = written(words, scratch)
    each = chunks.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "n")).alias("k", "w")).select("chunk", (F.col("k") + 1).alias("local"), "lang", "w.words", "w.n")
    named = _named(each, ["lang", "words"], least, scratch)
    none = F.array().cast("array<long>")
    level = named.where("head").select("id", F.lit(1).alias("size"), "lang", F.col("words").alias("phrase"), "a", none.alias("first"), none.alias("rest"), F.lit(None).cast("long").alias("left"), F.lit(None).cast("long").alias("right"))
    all_ = level
    for size in range(2, longest + 1):
        chunks = written(_paired(chunks, named, size == longest), scratch, "zstd")
        each = chunks.select("chunk", F.posexplode(F.arrays_zip("left", "right", "n")).alias("k", "p")).select("chunk", (F.col("k") + 1).alias("local"), "p.left", "p.right", "p.n")
        if size < longest:
            named = _named(each, ["left", "right"], least, scratch)
            counts = named.where("head").select("id", "left", "right", "a")
        else:
            counts = each.groupBy("left", "right").agg(F.sum("n").alias("a")).where(F.col("a") >= least).withColumn("id", F.monotonically_increasing_id())
        l = level.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("lp"), F.array_append("first", F.col("a")).alias("first"))  # noqa: E741
        r = level.select(F.col("id").alias("right"), F.col("phrase").alias("rp"), F.array_prepend("rest", F.col("a")).alias("rest"))
        phrase = F.concat("lp", F.lit(" "), F.element_at(F.split("rp", " "), -1))
        level = counts.join(l, "left").join(r, "right").select("id", F.lit(size).alias("size"), "lang", phrase.alias("phrase"), "a", "first", "rest", "left", "right")
        level = written(level, scratch)
        all_ = all_.unionByName(level)
    return all_, words, scratch


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, share: int = 50, top: int = 2000, chunk: int = CHUNK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of 2 to `longest` words of each lang by score.

    a, l, r are the occurrences of the phrase, of its first k words and of the rest, for the cut k of the lowest score
    floor(1000000 a a / (l r)) (ties: the smallest k); n is the number of words of the lang. Phrases that lie inside a
    longer one with at least `share` percent of their occurrences are left out. Ties go to larger a, then to the phrase in byte
    order. Numbers are exact up to 10^15 occurrences.

    Null texts are empty, a null lang is `und`; texts of any length are read whole (cut only where pieces end); repeated
    rows count each; other columns are ignored; an empty table gives no rows."""
    found, words, scratch = phrases(docs, longest, least, chunk)
    # a longer phrase that holds this one by way of others is at most as frequent as those: the next size tells
    inside = found.where("size > 2")
    inside = inside.select(F.col("size") - 1, F.explode(F.array("left", "right")).alias("id"), "a").toDF("size", "id", "longer").groupBy("size", "id").agg(F.max("longer").alias("longer"))
    kept = found.where("size > 1").join(inside, ["size", "id"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    score = "(cast(1000000 as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0)))) div (cast(x.first as decimal(15,0)) * cast(x.rest as decimal(15,0)))"
    cut = F.expr(f"array_min(transform(arrays_zip(first, rest), (x, k) -> struct({score} as score, k, x.first as l, x.rest as r)))")
    best = kept.select("lang", "phrase", "a", cut.alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    out = best.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).join(words, "lang")
    out = written(out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    scratch.drop()
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
with pieces as (
  select coalesce(lang, 'und') as lang, regexp_extract_all(unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') as w
  from documents
), places as (select lang, w, unnest(range(1, len(w) + 1)) as i from pieces
), one as (select lang, w[i] as a, count(*) as f from places group by all
), two as (select lang, w[i] as a, w[i + 1] as b, count(*) as f from places where i < len(w) group by all
), three as (select lang, w[i] as a, w[i + 1] as b, w[i + 2] as c, count(*) as f from places where i + 1 < len(w) group by all having count(*) >= 10
), words as (select lang, sum(f)::bigint as n from one group by lang
), cuts as (
  select t.lang, t.a || ' ' || t.b as phrase, t.f as a, 1 as k, x.f as l, y.f as r from two t join one x on x.lang = t.lang and x.a = t.a join one y on y.lang = t.lang and y.a = t.b where t.f >= 10
  union all
  select t.lang, t.a || ' ' || t.b || ' ' || t.c, t.f, 1, x.f, y.f from three t join one x on x.lang = t.lang and x.a = t.a join two y on y.lang = t.lang and y.a = t.b and y.b = t.c
  union all
  select t.lang, t.a || ' ' || t.b || ' ' || t.c, t.f, 2, x.f, y.f from three t join two x on x.lang = t.lang and x.a = t.a and x.b = t.b join one y on y.lang = t.lang and y.a = t.c
), scored as (select *, ((1000000::hugeint * a * a) // (l::hugeint * r))::bigint as score from cuts qualify row_number() over (partition by lang, phrase order by ((1000000::hugeint * a * a) // (l::hugeint * r)), k) = 1
), longer as (
  select lang, phrase, max(f) as longest from (select lang, a || ' ' || b as phrase, f from three union all select lang, b || ' ' || c, f from three) group by all
), kept as (select s.* from scored s left join longer o using (lang, phrase) where longest is null or 100 * longest < 50 * a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from kept join words using (lang) qualify rank <= 2000
"""
