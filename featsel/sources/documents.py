"""Large JSON documents cut into their records by many tasks a file."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a document that are read to find its list of records.
HEAD = 1_048_576
#: Records that a task holds at once.
RECORDS = 4_096
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\Z)|[\[\]{},]', re.S)
_REST = re.compile(r'(?:[^"\\]|\\.)*(?:"|\Z)', re.S)
_STEP = {"{": 1, "[": 1, "}": -1, "]": -1}


def list_place(head: str, wrappers: tuple[str, ...]) -> tuple[int, int | None] | None:
    """Where a document has its records, from its head: (depth of the list's items, the number of the object's member that is the list or
    None for a list alone); None if that can't be told."""
    text = head.lstrip("﻿ \t\r\n")
    if text.startswith("["):
        return 1, None
    if not text.startswith("{"):
        return None
    depth, member, key, found = 0, 0, None, {}
    for m in _TOKEN.finditer(text):
        token = m[0]
        if token.startswith('"'):
            if depth == 1 and len(token) > 1 and token.endswith('"') and re.match(r"\s*:", text[m.end() : m.end() + 64]):
                key = token[1:-1]
            continue
        if token == "[" and depth == 1 and key in wrappers:
            found.setdefault(key, member)
        depth += _STEP.get(token, 0)
        member += token == "," and depth == 1
    return next(((2, found[w]) for w in wrappers if w in found), None)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """value (text up to the next closing brace, without it), block (where the part of the file begins that the task reads), in order."""
    return spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_block_start").alias("block"))


def _walk(text: str, inside: bool, depth: int):
    """(position, token, depth after it) of the brackets and commas outside strings; last of all whether a string is open at the end."""
    at = 0
    if inside:
        at = _REST.match(text).end()
        if at == len(text):  # texts end with a brace: no quote closes the string
            yield at, None, depth, True
            return
    inside = False
    for m in _TOKEN.finditer(text, at):
        token = m[0]
        if token[0] == '"':
            inside = m.end() == len(text)
            continue
        depth += _STEP.get(token, 0)
        yield m.start(), token, depth, False
    yield len(text), None, depth, inside


def _index(pieces: DataFrame) -> DataFrame:
    """For each block, for a start outside (0) and inside (1) a string: whether a string is open at the end, the change of depth, the
    least depth at a closing brace or bracket, and the commas at each depth (both relative to the start)."""

    def run(batches):
        of: dict[int, list] = {}
        for batch in batches:
            for text, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text + "}"
                for s, state in enumerate(of.setdefault(block, [[False, 0, 0, {}], [True, 0, 0, {}]])):
                    for _, token, depth, open_ in _walk(text, state[0], state[1]):
                        if token == ",":
                            state[3][depth] = state[3].get(depth, 0) + 1
                        elif token in ("}", "]"):
                            state[2] = min(state[2], depth)
                    state[0], state[1] = open_, depth
        if of:
            rows = [(b, *(x for s in states for x in (s[0], s[1], s[2], list(s[3].items())))) for b, states in sorted(of.items())]
            pairs = pa.map_(pa.int32(), pa.int64())
            kinds = [pa.int64(), *[pa.bool_(), pa.int32(), pa.int32(), pairs] * 2]
            names = ["block", *[f"{n}{s}" for s in "01" for n in ("open", "delta", "low", "commas")]]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    each = "open{0} boolean, delta{0} int, low{0} int, commas{0} map<int,bigint>"
    return pieces.mapInArrow(run, f"block long, {each.format(0)}, {each.format(1)}")


def starts(index: list, level: int) -> tuple[dict[int, tuple[bool, int, int]], dict[int, int], set[int]]:
    """block -> (string open, depth, members of the object before) at its beginning; block that begins inside a record -> block where that
    begins; blocks that end inside one. The effects of the blocks compose in their order."""
    state, begin, owner, open_, began = (False, 0, 0), {}, {}, set(), 0
    for row in sorted(index, key=lambda r: r["block"]):
        inside, depth, members = begin[row["block"]] = state
        s = int(inside)
        if depth > level:
            owner[row["block"]] = began
        if depth <= level or depth + row[f"low{s}"] <= level:
            began = row["block"]
        state = row[f"open{s}"], depth + row[f"delta{s}"], members + (row[f"commas{s}"] or {}).get(1 - depth, 0)
        if state[1] > level:
            open_.add(row["block"])
    return begin, owner, open_


def records(spark: SparkSession, path: str, level: int, member: int | None) -> DataFrame:
    """value: the JSON of every object in a document's list, whose items lie at depth `level` + 1 (in the member of the object of that number).

    A file is cut at closing braces, wherever they are, so many tasks read it. One pass finds what each block does to depth and
    strings, from either start; composed in order, these tell every task where it stands. Records that lie in several blocks are put
    together from their pieces."""
    pieces = _pieces(spark, path)
    begin, owner, open_ = starts(_index(pieces).collect(), level)  # a row for each block, some 100 MB of text

    def cut(fragments: bool):
        def run(batches):
            out: list = []
            block, text_of, inside, depth, members, whose = None, None, False, 0, 0, None

            def batch_of():
                kinds = ((pa.int64(), pa.int64(), pa.string()), ("owner", "seq", "value")) if fragments else ((pa.string(),), ("value",))
                return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds[0])], names=list(kinds[1]))

            def left_over():
                if fragments and text_of:
                    out.append((whose, block, "".join(text_of)))

            for batch in batches:
                for text, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if at != block:
                        left_over()
                        block = at
                        inside, depth, members = begin[at]
                        text_of, whose = ([], owner[at]) if depth > level else (None, at)
                    if text is None:
                        text_of = None
                        continue
                    text, first = text + "}", None
                    for k, token, after, inside_after in _walk(text, inside, depth):
                        if token == "{" and after == level + 1 and text_of is None and (member is None or members == member):
                            first = k
                        if token == "]" and after == level:
                            text_of = None  # an item that is no object ends
                        members += token == "," and after == 1
                        depth, inside = after, inside_after
                    if text_of is not None:
                        text_of.append(text)
                    elif first is not None:
                        text_of, whose = [text[first:]], block
                    if depth <= level and text_of is not None:
                        if whose != block:
                            left_over()
                        elif not fragments:
                            out.append(("".join(text_of),))
                        text_of = None
                    if len(out) >= RECORDS:
                        yield batch_of()
                        out.clear()
            left_over()
            if out:
                yield batch_of()

        return run

    whole = pieces.mapInArrow(cut(False), "value string")
    if not open_:
        return whole
    some = sorted({*owner, *owner.values(), *open_})
    parts = pieces.withColumn("value", F.when(F.col("block").isin(some), F.col("value"))).mapInArrow(cut(True), "owner long, seq long, value string")
    joined = F.array_sort(F.collect_list(F.struct("seq", "value")))  # pieces of one record
    text = F.array_join(F.transform("p", lambda x: x["value"]), "")
    crossing = parts.groupBy("owner").agg(joined.alias("p")).where(F.col("p")[0]["seq"] == F.col("owner")).select(text.alias("value"))
    return whole.unionByName(crossing.where(F.col("value").startswith("{")))
