"""Delimited text read by many tasks a file, also where quoted values hold line breaks."""

from __future__ import annotations

import csv
import io

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featsel.functions.text import clean_headers

_SEPARATORS = "\t,;|"
#: Characters of a text's head that are looked at to find its separator.
HEAD = 32_768
#: Bytes of a file that are read to find its header; if it is longer, eight times as many, and so on.
HEADER_BYTES = 65_536
#: Records that a task holds at once.
RECORDS = 4_096
csv.field_size_limit(2**31 - 1)


def strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def sized_files(spark: SparkSession, path: str | list[str]) -> list[tuple[str, int]]:
    """The files (not empty, with names that don't begin with . or _) at a path, pattern or folder and their bytes, through Spark's own
    file systems."""
    found = []
    for one in [path] if isinstance(path, str) else path:
        where = spark._jvm.org.apache.hadoop.fs.Path(one)
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        todo = list(fs.globStatus(where) or [])
        while todo:
            s = todo.pop()
            if s.isDirectory():
                todo += [x for x in fs.listStatus(s.getPath()) if x.getPath().getName()[0] not in "._"]
            elif s.getLen():
                found.append((s.getPath().toString(), s.getLen()))
    return sorted(found)


def files_of(spark: SparkSession, path: str | list[str]) -> list[str]:
    return [f for f, _ in sized_files(spark, path)]


def head_of(spark: SparkSession, path: str, n: int) -> bytes:
    """The first n bytes of a file, through Spark's own file systems."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    codec = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration()).getCodec(where)
    stream = codec.createInputStream(stream) if codec else stream
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def separator(head: str) -> str:
    """The separator of a delimited text, from its first characters: what the csv module finds, else the first of tab, comma,
    semicolon and bar that the first line that isn't blank holds. An error if there is none."""
    try:
        return csv.Sniffer().sniff(head, delimiters=_SEPARATORS).delimiter
    except csv.Error:
        first = next((x for x in head.splitlines() if x.strip()), "")
        for sep in _SEPARATORS:
            if sep in first:
                return sep
    raise ValueError("no comma, tab, semicolon or bar separates the columns of the header")


def marked_encoding(head: bytes) -> str | None:
    """What a mark at the beginning says, or (for two bytes a character) the zero bytes of the first characters."""
    if head.startswith(b"\xef\xbb\xbf"):
        return "utf-8-sig"
    if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16"
    some = head[:256]
    if len(some) >= 4 and b"\0" in some:
        odd, even = some[1::2].count(0), some[::2].count(0)
        return "utf-16-le" if odd > 4 * even else "utf-16-be" if even > 4 * odd else None
    return None


def header_of(spark: SparkSession, path: str, sep: str | None, encoding: str) -> tuple[list[str], str, bool]:
    """The first record that isn't blank (of any length), the separator, and whether it is the first line that isn't blank."""
    n = HEADER_BYTES
    while True:
        data = head_of(spark, path, n)
        text, whole = data.decode(encoding, "replace"), len(data) < n
        text = text.removeprefix("﻿")
        if not text.strip():
            if whole:
                raise ValueError("the table is empty")
            n *= 8
            continue
        sep = sep or separator(text[:HEAD])
        found, first = None, None
        for row in csv.reader(io.StringIO(text, newline=""), delimiter=sep):
            if found is not None:
                return found, sep, first
            if any(x.strip() for x in row):
                found, first = row, first is None and not any("\n" in x or "\r" in x for x in row)
            elif row:
                first = False
        if whole:
            if found is None:
                raise ValueError("the table has no header")
            return found, sep, first
        n *= 8


def open_after(line: str, inside: bool, sep: str) -> bool:
    """Whether a quoted value is still open after a line, given whether one was open before it. A quote opens a value only at its
    beginning, two quotes inside stand for one; what follows the closing quote up to the separator is plain."""
    at, n = 0, len(line)
    while True:
        if inside or line.startswith('"', at):
            at += not inside
            while True:
                at = line.find('"', at)
                if at < 0:
                    return True
                if not line.startswith('"', at + 1):
                    break
                at += 2
            inside = False
        at = line.find(sep, at)
        if at < 0 or at + 1 > n:
            return False
        at += 1


def _lines(spark: SparkSession, files: list[str], line_sep: str) -> DataFrame:
    """value, path, block (where the part of the file begins that the task reads); a task has the lines of a block in order."""
    return spark.read.option("lineSep", line_sep).text(files).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))


def _index(lines: DataFrame, sep: str) -> DataFrame:
    """For each block: whether a quoted value is open at its end if none (end0) or one (end1) was open at its beginning, whether it has
    a quote, whether all of it is UTF-8, whether some line of it ends the record that was open at its beginning, and whether it is blank. Lines without quotes change nothing and come without text."""

    def run(batches):
        of: dict[tuple, list[bool]] = {}
        for batch in batches:
            for text, path, block, valid, blank in zip(*(c.to_pylist() for c in batch.columns)):
                state = of.setdefault((path, block), [False, True, False, True, False, True])
                state[3] &= valid
                state[5] &= blank
                if text is not None:
                    line = text.decode("latin-1")
                    state[0], state[1], state[2] = open_after(line, state[0], sep), open_after(line, state[1], sep), True
                    state[4] |= not state[1]
        if of:
            keys, values = zip(*of.items())
            yield pa.record_batch([pa.array(x) for x in (*zip(*keys), *zip(*values))], names=["path", "block", "end0", "end1", "quotes", "valid", "leaves", "blank"])

    seen = lines.select(F.when(F.col("value").contains('"'), F.col("value").cast("binary")), "path", "block", F.is_valid_utf8("value"), F.translate("value", sep + ' \t\r"\ufeff', "") == "")
    return seen.mapInArrow(run, "path string, block long, end0 boolean, end1 boolean, quotes boolean, valid boolean, leaves boolean, blank boolean")


def starts(index: list) -> tuple[dict[tuple[str, int], int], set[tuple[str, int]], set[tuple[str, int]]]:
    """From the rows of the index: each block that begins inside a quoted value -> the block where that value's record begins; the
    blocks at whose end a value is open; and those in which the header may begin, as all before them are blank. The
    blocks' effects compose from the first of each file on."""
    owner, open_, waiting = {}, set(), set()
    inside, path, began, blank = False, None, 0, True
    for row in sorted(index, key=lambda r: (r["path"], r["block"])):
        if row["path"] != path:
            inside, path, blank = False, row["path"], True
        key = (path, row["block"])
        if blank:
            waiting.add(key)
        blank &= row["blank"]
        if inside:
            owner[key] = began
        after = row["end1"] if inside else row["end0"]
        if after:
            open_.add(key)
            began = began if inside and not row["leaves"] else row["block"]  # the whole block may lie inside one record
        inside = after
    return owner, open_, waiting


def _parsed(lines: DataFrame, width: int, sep: str, encoding: str, owner: dict, open_: set, waiting: set | None, fragments: bool) -> DataFrame:
    """Records as cells. With `fragments` only the pieces of records that lie in several blocks: path, owner (block where the record
    begins), seq (block of the piece), text, first (the record is the file's header). waiting: the blocks in which a header may begin (None: the first ones)."""

    def fit(row: list[str]) -> list[str | None]:
        return [x or None for x in row[:width]] + [None] * (width - len(row))

    def run(batches):
        out: list = []
        key, header, inside, record = None, True, False, []

        def batch_of(rows):
            if fragments:
                return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()))], names=["path", "owner", "seq", "text", "first"])
            return pa.record_batch([pa.array(rows, pa.list_(pa.string()))], names=["cells"])

        def ended():
            """A record is whole: parse it, unless it is the header."""
            nonlocal header
            text = "".join(record)
            record.clear()
            for row in csv.reader(io.StringIO(text, newline=""), delimiter=sep):
                if header:
                    header = not any(x.strip() for x in row)
                elif row and not fragments:
                    out.append(fit(row))

        def piece(begin: int):
            nonlocal header
            if fragments:
                out.append((key[0], begin, key[1], "".join(record).encode(encoding if encoding != "utf-8-sig" else "utf-8"), header))
            record.clear()

        def left_over():
            """The block ends inside a record: of an earlier block, of this one, or (without an index) where the file ends."""
            piece(owner[key]) if head else piece(key[1]) if key in open_ else ended()

        head = False  # in lines that belong to a record of an earlier block
        for batch in batches:
            for text, path, block in zip(*(c.to_pylist() for c in batch.columns)):
                if (path, block) != key:
                    if record:
                        left_over()
                    key, inside, head = (path, block), (path, block) in owner, (path, block) in owner
                    header = block == 0 if waiting is None else key in waiting
                if text is None:
                    continue
                line = text.decode(encoding, "replace")
                if block == 0 and header and not record:
                    line = line.removeprefix("﻿")
                inside = open_after(line, inside, sep) if inside or '"' in line else False
                record.append(line + "\n")
                if not inside:
                    if head:
                        piece(owner[key])
                        head = False
                    elif record[0].strip():
                        ended()
                    else:
                        record.clear()
                if len(out) >= RECORDS:
                    yield batch_of(out)
                    out.clear()
        if record:
            left_over()
        if out:
            yield batch_of(out)

    kind = "path string, owner long, seq long, text binary, first boolean" if fragments else "cells array<string>"
    return lines.select(F.col("value").cast("binary"), "path", "block").mapInArrow(run, kind)


def read_delimited(spark: SparkSession, path: str | list[str], sep: str | None = None, encoding: str | None = None, multi_line: bool = True) -> DataFrame:
    """All columns as text; a file's header is its first record that isn't blank, of any length (the first file's names count).
    Short rows are padded with null, long ones cut; blank lines are no rows; an empty value is null.

    encoding: what a mark at the beginning says, else UTF-8 if every line is, else Windows-1252.

    Quoted values may hold line breaks, and still many tasks read a file: one pass finds for each block of a file what it does to an open
    or no open quoted value; composed in order these tell where records begin, so that every task cuts its own (texts of two bytes a
    character are read by a task a file). multi_line=False leaves that pass out, and is right if no value has a line break."""
    files = files_of(spark, path)
    if not files:
        raise ValueError("the table is empty")
    head = head_of(spark, files[0], 4096)
    known = encoding or marked_encoding(head)
    wide = (known or "").lower().replace("_", "-").startswith("utf-16")
    found, sep, plain = header_of(spark, files[0], sep, known or ("utf-8" if wide or _valid_head(head) else "cp1252"))
    if wide:
        names = strings(clean_headers(found))
        return spark.read.schema(names).options(sep=sep, header=True, enforceSchema=True, escape='"', encoding=known.upper().replace("_", "-").replace("-LE", "LE").replace("-BE", "BE"), multiLine=True).csv(files)
    line_sep = "\r" if b"\r" in head and b"\n" not in head else "\n"
    lines = _lines(spark, files, line_sep)
    owner, open_, waiting, quotes = {}, set(), None, True
    if multi_line:
        index = _index(lines, sep).collect()  # a row for each block that a task reads, some 100 MB of text
        quotes = any(r["quotes"] for r in index)
        if not known and not all(r["valid"] for r in index):
            known = "cp1252"
        owner, open_, waiting = starts(index)
    elif not known:
        known = "utf-8" if lines.where(~F.is_valid_utf8("value")).isEmpty() else "cp1252"
    known = known or "utf-8"
    if known == "cp1252":
        found = header_of(spark, files[0], sep, known)[0]
    names = clean_headers(found)
    if plain and not (quotes and multi_line) and known.lower() in ("utf-8", "utf-8-sig") and line_sep == "\n":
        return spark.read.schema(strings(names)).options(sep=sep, header=True, enforceSchema=True, escape='"', multiLine=False).csv(files)
    rows = _parsed(lines, len(names), sep, known, owner, open_, waiting, False)
    if open_:
        cut = {*owner, *((p, b) for (p, _), b in owner.items()), *open_}
        at = F.struct("path", "block")
        some = [F.struct(F.lit(p).alias("path"), F.lit(b).cast("long").alias("block")) for p, b in sorted(cut)]
        pieces = _parsed(lines.withColumn("value", F.when(at.isin(*some), F.col("value"))), len(names), sep, known, owner, open_, waiting, True)
        rows = rows.unionByName(_whole(pieces, len(names), sep, known))
    return rows.select([F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])


def _whole(pieces: DataFrame, width: int, sep: str, encoding: str) -> DataFrame:
    """The records that lie in several blocks, from their pieces."""

    def run(table: pa.Table) -> pa.Table:
        text = b"".join(t for _, t in sorted(zip(table.column("seq").to_pylist(), table.column("text").to_pylist()))).decode(encoding, "replace")
        rows = [] if any(table.column("first").to_pylist()) else [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep) if r]
        return pa.table({"cells": pa.array([[x or None for x in r[:width]] + [None] * (width - len(r)) for r in rows], pa.list_(pa.string()))})

    return pieces.groupBy("path", "owner").applyInArrow(run, "cells array<string>")


def _valid_head(head: bytes) -> bool:
    try:
        head[: head.rfind(b"\n") + 1 or None].decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True
