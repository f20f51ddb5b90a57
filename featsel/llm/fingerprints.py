"""Canonical exact fingerprints of documents, in DataFrame functions only."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from featsel.llm.common import small, table, written

#: White space of Unicode, as a character class.
_SPACE = r"\s\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: Rows that one task sorts at most, on average, while finding the next document.
BLOCK_ROWS = 2048
#: Blocks at most, which bounds the table of their first rows.
BLOCKS = 65_536


@lru_cache
def _unicode_tables() -> tuple[dict[str, str], dict[str, str], dict[str, int], str]:
    """From the Unicode database: full canonical decompositions, composed pairs, combining classes,
    and a pattern that every text with something to normalise matches."""
    apart, pairs, classes, odd = {}, {}, {}, []
    for c in map(chr, range(sys.maxunicode + 1)):
        if 0xD800 <= ord(c) < 0xE000:
            continue
        if k := unicodedata.combining(c):
            classes[c] = k
        if 0xAC00 <= ord(c) < 0xD7A4:
            continue  # syllables are composed by a rule
        whole = unicodedata.normalize("NFD", c)
        if whole != c:
            apart[c] = whole
            one = unicodedata.decomposition(c).split()
            if len(one) == 2 and unicodedata.normalize("NFC", c) == c:
                pairs["".join(chr(int(x, 16)) for x in one)] = c
        if unicodedata.normalize("NFC", c) != c:
            odd.append(c)
    last = {p[1] for p in pairs if p[1] not in classes}
    spans: list[list[int]] = []
    for x in sorted({*map(ord, odd), *map(ord, last)}):
        if spans and x == spans[-1][1] + 1:
            spans[-1][1] = x
        else:
            spans.append([x, x])
    needs = r"[\p{M}ᅠ-ᇿ" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in spans) + "]"
    return apart, pairs, classes, needs


def _map(of: dict) -> Column:
    """A constant map, from one string (so that the plan holds a single value)."""
    return F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in of.items())), F.lit("\x01"), F.lit("\x02"))


def _bound(x: Column, f) -> Column:
    """f(x), with x bound to a variable, so that the plan holds it once however often f reads it."""
    return F.transform(F.array(x), f)[0]


def _decomposed(text: Column) -> Column:
    """The canonical decomposition of a text (but for Hangul syllables): n (starters up to it), k (class), i (place), c of each
    character, with marks in the order of their classes."""
    apart, _, classes, _ = _unicode_tables()
    decompose, klass = _map(apart), _map(classes)
    parts = F.filter(F.split(text, ""), lambda c: c != "")
    parts = F.flatten(F.transform(parts, lambda c: F.coalesce(F.filter(F.split(decompose[c], ""), lambda x: x != ""), F.array(c))))
    # a mark's place: number of starters up to it, then its class, then where it stands
    marks = F.transform(parts, lambda c: F.struct(F.coalesce(klass[c].cast('int'), F.lit(0)).alias("k"), c.alias("c")))
    start = F.struct(F.lit(0).alias("n"), F.lit([]).cast("array<struct<n:int,k:int,i:int,c:string>>").alias("all"))
    placed = F.aggregate(marks, start, lambda a, m: F.struct(
        (a["n"] + (m["k"] == 0).cast("int")).alias("n"),
        F.array_append(a["all"], F.struct((a["n"] + (m["k"] == 0).cast("int")).alias("n"), m["k"].alias("k"), F.size(a["all"]).alias("i"), m["c"].alias("c"))).alias("all"),
    ))["all"]
    return F.array_sort(placed)


def _composed(text: Column) -> Column:
    """NFC of a text: decompose, order marks by class, compose from left to right."""
    compose = _map(_unicode_tables()[1])
    code = lambda c: F.when(c == "", F.lit(0)).otherwise(F.ascii(c))
    char = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 4, "0")), "UTF-16BE")

    placed = _decomposed(text)

    def hangul(s: Column, c: Column) -> Column:
        a, b = code(s), code(c)
        lv = (a.between(0x1100, 0x1112)) & (b.between(0x1161, 0x1175))
        lvt = (a.between(0xAC00, 0xD7A3)) & ((a - 0xAC00) % 28 == 0) & (b.between(0x11A8, 0x11C2))
        return F.when(lv, char(((a - 0x1100) * 21 + (b - 0x1161)) * 28 + 0xAC00)).when(lvt, char(a + b - 0x11A7))

    def step(a: Column, m: Column) -> Column:
        free = (a["s"] != "") & ((a["last"] < m["k"]) | (a["last"] == 0) & (a["tail"] == ""))
        one = F.when(free, F.coalesce(compose[F.concat(a["s"], m["c"])], hangul(a["s"], m["c"])))
        kept = F.struct(a["out"].alias("out"), one.alias("s"), a["tail"].alias("tail"), a["last"].alias("last"))
        mark = F.struct(a["out"].alias("out"), a["s"].alias("s"), F.concat(a["tail"], m["c"]).alias("tail"), m["k"].alias("last"))
        new = F.struct(F.concat(a["out"], a["s"], a["tail"]).alias("out"), m["c"].alias("s"), F.lit("").alias("tail"), F.lit(0).alias("last"))
        return F.when(one.isNotNull(), kept).when(m["k"] == 0, new).otherwise(mark)

    empty = F.struct(F.lit("").alias("out"), F.lit("").alias("s"), F.lit("").alias("tail"), F.lit(0).alias("last"))
    return F.aggregate(placed, empty, step, lambda a: F.concat(a["out"], a["s"], a["tail"]))


def canonical(text: Column) -> Column:
    """Lower-cased (with one form of sigma), in Unicode normal form C, every run of white space one space, none at the ends.
    A null text counts as empty."""
    odd = _unicode_tables()[3]

    def normal(folded: Column) -> Column:
        cluster = F.regexp_extract_all(folded, F.lit(r"(?s)\P{M}[\p{M}ᅠ-ᇿ]*|[\p{M}]+"), F.lit(0))
        each = F.array_join(F.transform(cluster, lambda c: F.when(c.rlike(odd), _composed(c)).otherwise(c)), "")
        # nothing below U+0300 needs normalising; testing for that first spares most texts the long class
        return F.when(folded.rlike(r"[^\x00-\x{2FF}]") & folded.rlike(odd), each).otherwise(folded)

    def spaced(normal: Column) -> Column:
        plain = F.regexp_replace(normal, r"[ \t-\r\x1C-\x1F]{2,}|[\t-\r\x1C-\x1F]", " ")
        wide = F.regexp_replace(normal, rf"[{_SPACE}]{{2,}}|[{_SPACE}&&[^ ]]", " ")
        return F.trim(F.when(normal.rlike(r"[\x85\xA0\x{1680}-\x{3000}]"), wide).otherwise(plain))

    lower = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ς"), F.lit("σ"))
    return _bound(_bound(lower, normal), spaced)


@lru_cache
def _fold_tables() -> tuple[dict[str, str], str]:
    """From the Unicode database: what full case folding makes of the characters that lower-casing leaves as they are, and a class of
    these characters (without sharp s, which is common and replaced by itself)."""
    fold = {}
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        if not 0xD800 <= ord(c) < 0xE000 and c.lower() == c and c.casefold() != c and c != "\xdf":
            fold[c] = c.casefold()
    return fold, "[" + "".join(rf"\x{{{ord(c):X}}}" for c in fold) + "]"


def folded(text: Column) -> Column:
    """Full case folding: lower case, then what the Unicode database folds further (sharp s to ss, ligatures to their letters,
    every sigma to one). A null text counts as empty.

    Letters that marks follow are decomposed first, with the marks in canonical order: an iota below folds to a letter, behind
    which marks could no longer be put in order."""
    fold, rare = _fold_tables()
    of = _map(fold)

    def ordered(text: Column) -> Column:
        cluster = F.regexp_extract_all(text, F.lit(r"(?s)\P{M}\p{M}*|\p{M}+"), F.lit(0))
        each = F.array_join(F.transform(cluster, lambda c: F.when(c.rlike(r"\p{M}"), F.array_join(F.transform(_decomposed(c), lambda x: x["c"]), "")).otherwise(c)), "")
        return F.when(text.rlike(r"[^\x00-\x{2FF}]") & text.rlike(r"\p{M}"), each).otherwise(text)

    def rest(low: Column) -> Column:
        each = F.array_join(F.transform(F.split(low, ""), lambda c: F.coalesce(of[c], c)), "")
        # nothing below U+0149 but the micro sign folds further; testing for that first spares most texts the long class
        return F.when(low.rlike(r"[^\x00-\xB4\xB6-\x{148}]") & low.rlike(rare) | low.contains("\xb5"), each).otherwise(low)

    text = _bound(F.coalesce(text, F.lit("")), ordered)
    return _bound(F.replace(F.lower(text), F.lit("\xdf"), F.lit("ss")), rest)


def wide_hash(text: Column, bits: int = 64) -> Column:
    """128 bits as a struct of two xxhash64 with different seeds. Fewer `bits` a half are for tests."""
    cut = lambda h: h if bits == 64 else F.pmod(h, F.lit(2**bits))
    return F.struct(cut(F.xxhash64(text)).alias("a"), cut(F.xxhash64(F.lit(0x5BD1), text)).alias("b"))


def edited_text(text: Column, other: Column) -> Column:
    """`text` with its last third (floor of code points / 3) replaced by the first as many of `other`."""
    k = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - k), F.substring(other, F.lit(1), k))


def _blocks(docs: DataFrame, order: str) -> DataFrame:
    """`docs` with _block, a struct that grows with (doc_id, `order`), null doc_id first.

    Rows are cut at quantiles of doc_id. A doc_id (or null) of more rows than a block is cut out of its range, and
    then into equal ranges of `order`, a 64-bit hash."""
    n = docs.count()
    ranges = max(1, min(BLOCKS, n // BLOCK_ROWS))
    if ranges == 1:
        return docs.withColumn("_block", F.struct(F.lit(0).alias("range"), F.lit(0).alias("part"), F.lit(0).alias("piece")))
    most = max(BLOCK_ROWS, n // BLOCKS)
    double = F.col("doc_id").cast("double")
    cuts = docs.agg(F.percentile_approx(double, [k / ranges for k in range(1, ranges)], 10 * ranges)).first()[0] or []
    heavy = written(docs.groupBy("doc_id").count().where(F.col("count") > most))  # BLOCKS rows at most
    cuts = sorted({*cuts, *(r[0] for r in heavy.select(double).dropna().collect())}) or [0.0]
    split = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="_value", outputCol="_range")
    ranged = lambda df: split.transform(df.withColumn("_value", F.coalesce(double, F.lit(0.0)))).withColumn(
        "_range", F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("_range").cast("int"))
    ).drop("_value")
    one = F.struct(F.col("doc_id").alias("id"), F.ceil(F.col("count") / most).cast("int").alias("pieces"))
    heavy = ranged(heavy).groupBy("_range").agg(F.collect_list(one).alias("_heavy"))
    out = ranged(docs).join(F.broadcast(heavy), "_range", "left")
    # below the first heavy doc_id of a range 0, at it 1, between it and the second 2, ...
    upto = lambda f: F.coalesce(F.size(F.filter("_heavy", f)), F.lit(0))
    part = F.when(F.col("_heavy").isNull() | F.col("doc_id").isNull(), 0).otherwise(upto(lambda x: x["id"] <= F.col("doc_id")) + upto(lambda x: x["id"] < F.col("doc_id")))
    pieces = F.filter("_heavy", lambda x: x["id"].eqNullSafe(F.col("doc_id")))
    pieces = F.coalesce(F.get(pieces, F.lit(0))["pieces"], F.lit(1))
    piece = F.least(F.floor((F.col(order) / F.lit(2.0**64) + 0.5) * pieces).cast("int"), pieces - 1)
    block = F.struct(F.col("_range").alias("range"), part.alias("part"), F.when(pieces > 1, piece).otherwise(0).alias("piece"))
    return out.withColumn("_block", block).drop("_range", "_heavy")


def _without_copies(docs: DataFrame, order: str) -> tuple[DataFrame, DataFrame | None]:
    """`docs` with one row for every text of a (doc_id, `order`) that has more than BLOCK_ROWS rows, and the copies
    left out (None if there are none). Copies are made anew, at most BLOCK_ROWS a row, so no task gets all."""
    ids = docs.groupBy("doc_id").count().where(F.col("count") > BLOCK_ROWS).select("doc_id")
    ids = small(written(ids.withColumnRenamed("doc_id", "_id")))
    some = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    keys = written(some.groupBy("doc_id", order).count().where(F.col("count") > BLOCK_ROWS).select(F.col("doc_id").alias("_id"), F.col(order).alias("_o")))
    if keys.isEmpty():
        return docs, None
    keys = small(keys)
    is_key = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col(order) == F.col("_o"))
    ones = written(docs.join(keys, is_key, "left_semi").groupBy(*docs.columns).agg(F.count("*").alias("_n")))
    rest = docs.join(keys, is_key, "left_anti")
    parts = ones.where("_n > 1").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 2) / BLOCK_ROWS))))
    parts = parts.withColumn("_n", F.least(F.lit(BLOCK_ROWS).cast("long"), F.col("_n") - 1 - F.col("_part") * BLOCK_ROWS)).repartition("doc_id", order, "_part")
    copies = parts.withColumn("_part", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    return rest.unionByName(ones.drop("_n")), copies.select(*docs.columns)


def with_next(docs: DataFrame, order: str, carry: list[str]) -> DataFrame:
    """`docs` (with doc_id) plus next_<c> for each c of `carry`: its value in the next row in descending order
    of doc_id (null last) and `order`, a 64-bit hash of the row; the last row's next is the first.

    Rows are cut into ranges of (doc_id, `order`), so each task sorts one range; the first row of a
    range is also sent, once more, to the range that comes before it. Nothing is sorted as a whole. Of more than
    BLOCK_ROWS equal rows one takes part; each of the others has its equal as the next."""
    docs, copies = _without_copies(docs, order)
    columns = docs.columns
    docs = _blocks(docs, order)
    first = F.max(F.struct("doc_id", order)).alias("_first")
    heads = written(docs.groupBy("_block").agg(first))  # one row a range
    down, whole = Window.orderBy(F.desc("_block")), Window.partitionBy(F.lit(1))
    heads = heads.withColumn("_to", F.coalesce(F.lag("_block").over(down), F.min("_block").over(whole)))
    same = F.struct("doc_id", order).eqNullSafe(F.col("_first"))
    rows = docs.join(F.broadcast(heads), "_block")
    rows = rows.withColumn("_to", F.when(same, F.array("_block", "_to")).otherwise(F.array("_block")))
    rows = rows.select(*columns, F.posexplode("_to").alias("_again", "_block"))
    each = Window.partitionBy("_block").orderBy("_again", F.desc_nulls_last("doc_id"), F.desc(order))
    out = rows.withColumns({f"next_{c}": F.lead(c).over(each) for c in carry}).where("_again = 0").drop("_again", "_block")
    return out if copies is None else out.unionByName(copies.withColumns({f"next_{c}": F.col(c) for c in carry}))


def fingerprints(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for
    every row of `docs` (doc_id, text).

    The fingerprint is the hexadecimal 128-bit xxhash of the canonical text: case folded in full (`folded`), then `canonical`. Buckets that hold more than one
    text are compared byte by byte (grouped by hash and canonical text with map-side combining, so that
    a bucket of a million copies is one row a task): if different texts ever share a hash, the second
    and later ones in byte order get a suffix -1, -2, ... So fingerprints are equal exactly if the
    canonical texts are, and the likeness of two is 1.0 or 0.0.

    The edited text is the text whose last third is replaced by the start of the next document's, in
    descending order of doc_id. Rows of one doc_id are ordered by a hash of the text; a null doc_id
    comes last; the last document's next is the first (its own, if there is one only). A null text
    counts as empty; an empty table gives no rows; other columns are ignored."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("h", F.xxhash64("text"))
    rows = with_next(docs.withColumn("f", wide_hash(canonical(folded(F.col("text"))), bits)), "h", ["text", "f", "h", "doc_id"])
    edited = edited_text(F.col("text"), F.col("next_text"))
    rows = rows.withColumn("edited", edited)
    base = written(
        rows.select(
            "doc_id", "h", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited"), 256).alias("edited_sha256"), "f",
            wide_hash(canonical(folded(F.col("edited"))), bits).alias("e"), F.col("next_f").alias("nf"), "next_doc_id", "next_h",
        )
    )
    suffix = _collisions(docs, base, bits)
    code = lambda h: F.lower(F.concat(F.lpad(F.hex(F.col(h)["a"]), 16, "0"), F.lpad(F.hex(F.col(h)["b"]), 16, "0")))
    names = {"f": ("doc_id", "h", False), "e": ("doc_id", "h", True), "nf": ("next_doc_id", "next_h", False)}
    for name, (doc, h, is_edit) in names.items():
        base = base.withColumn(f"{name}_code", code(name))
        if suffix is not None:
            at = suffix.where("edit" if is_edit else "not edit")
            known = F.coalesce(doc, h)
            base = base.withColumns({"_k": known, "_h": F.col(h)}).join(
                at.select(F.col("k").alias("_k"), F.col("h").alias("_h"), F.concat(F.lit("-"), F.col("rank")).alias("_s")), ["_k", "_h"], "left"
            )
            base = base.withColumn(f"{name}_code", F.concat(f"{name}_code", F.coalesce("_s", F.lit("")))).drop("_k", "_h", "_s")
    same = lambda a, b: (F.col(a) == F.col(b)).cast("double")
    return base.select(
        "doc_id", "n_chars", "edited_sha256", F.col("f_code").alias("fingerprint"), F.col("e_code").alias("edited_fingerprint"),
        same("f_code", "e_code").alias("near_edited"), same("f_code", "nf_code").alias("near_next"),
    )


def _collisions(docs: DataFrame, base: DataFrame, bits: int) -> DataFrame | None:
    """k, h (key of a row), edit, rank > 0 of the texts that share a hash with another text that comes
    before them; None if there are none."""
    key = F.coalesce("doc_id", "h")
    hashes = base.select(F.col("f").alias("w")).union(base.select("e"))
    shared = small(written(hashes.groupBy("w").count().where("count > 1").select("w")))
    plain = base.select(key.alias("k"), "h", F.col("f").alias("w")).join(shared, "w", "left_semi").select("k", "h").distinct()
    edits = base.select(key.alias("k"), "h", F.coalesce("next_doc_id", "next_h").alias("nk"), F.col("next_h").alias("nh"), F.col("e").alias("w"))
    edits = written(edits.join(shared, "w", "left_semi").drop("w").distinct())
    ends = edits.select("k", "h").union(edits.select("nk", "nh"))
    needed = small(written(plain.union(ends).distinct()))
    texts = docs.select(key.alias("k"), "h", "text").join(needed, ["k", "h"], "left_semi").dropDuplicates(["k", "h"])
    whole = texts.select("k", "h", F.lit(False).alias("edit"), canonical(folded(F.col("text"))).alias("c"))
    other = texts.select(F.col("k").alias("nk"), F.col("h").alias("nh"), F.col("text").alias("next_text"))
    both = edits.join(texts, ["k", "h"]).join(other, ["nk", "nh"])
    changed = both.select("k", "h", F.lit(True).alias("edit"), canonical(folded(edited_text(F.col("text"), F.col("next_text")))).alias("c"))
    members = whole.union(changed).withColumn("w", wide_hash(F.col("c"), bits))
    distinct = members.groupBy("w", "c").agg(F.lit(1).alias("one"))
    clash = written(distinct.groupBy("w").count().where("count > 1").select("w"))
    if clash.isEmpty():
        return None
    rank = F.row_number().over(Window.partitionBy("w").orderBy("c")) - 1
    ranked = distinct.join(clash, "w", "left_semi").select("w", "c", rank.alias("rank"))
    return written(members.join(ranked, ["w", "c"]).where("rank > 0").select("k", "h", "edit", "rank"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
