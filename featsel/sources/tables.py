"""Reading tables of text values: delimited text, JSON, workbooks, columnar files."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featsel.functions.text import as_text, clean_headers, named
from featsel.sources import documents
from featsel.sources.delimited import files_of, head_of, read_delimited, separator, sized_files, strings
from featsel.sources.workbooks import read_workbooks

__all__ = ["read_delimited", "read_json_document", "read_json_lines", "read_table", "read_workbooks", "separator"]

#: JSON records that give the order of the columns.
KEYS_OF = 500
# Where an object that wraps a table may keep its records, in this order.
WRAPPERS = ("records", "rows", "data", "items")


def keys(lines: DataFrame, keys_of: int | None) -> list[str]:
    """The keys of the objects among some lines of JSON (value): those of the first 500 as they come, then the others by name. With
    `keys_of` only those of so many first objects. The others come from one pass that combines in each task; a table has no more keys
    than it can have columns."""
    objects = lines.where(F.ltrim("value").startswith("{"))
    names: dict[str, None] = {}
    for (line,) in objects.limit(keys_of or KEYS_OF).collect():
        try:
            names |= dict.fromkeys(json.loads(line))
        except ValueError as e:
            raise ValueError(f"a line or record is no JSON: {line[:80]}") from e
    if names and not keys_of:
        late = objects.select(F.explode(F.json_object_keys("value")).alias("k")).distinct().where(~F.col("k").isin(list(names)))
        names |= dict.fromkeys(sorted(k for (k,) in late.collect()))
    return list(names)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _records(lines: DataFrame, what: str, keys_of: int | None) -> DataFrame:
    """A DataFrame (value: JSON of a record each) as a table of text. Values that are no objects are left out; what isn't JSON is an
    error when the row is read, wherever it stands. Columns are the `keys` of the records."""
    lines = lines.where(F.trim("value") != "")
    names = keys(lines, keys_of)
    if not names:
        raise ValueError(f"the {what} has no records")
    error = F.raise_error(F.concat(F.lit(f"a record of the {what} is no JSON: "), F.left(F.col("value"), F.lit(80))))
    checked = F.when(F.try_parse_json("value").isNull(), error.cast("string")).otherwise(F.col("value"))
    rows = lines.select(checked.alias("value")).where(F.ltrim("value").startswith("{"))
    return rows.select(F.from_json("value", strings(list(names))).alias("r")).select("r.*").toDF(*clean_headers(list(names)))


def read_json_lines(spark: SparkSession, path: str | list[str], keys_of: int | None = None) -> DataFrame:
    """One object a line, all values as text (nested ones as they are written); columns are the `keys` of all objects, or with `keys_of` of
    so many first ones. Lines that hold a single value are left out (a list of objects counts as these); a line that is no JSON is an error."""
    names = keys(spark.read.text(path), keys_of)
    if not names:
        raise ValueError("the JSON lines have no records")
    bad = next(n for n in ("_bad", "_bad_line", "_bad_json_line") if n not in names)
    rows = spark.read.schema(strings([*names, bad])).options(mode="PERMISSIVE", columnNameOfCorruptRecord=bad).json(path)
    line, some = F.col(bad), named(next(iter(names)))  # Spark wants a column besides the one of bad lines
    error = F.raise_error(F.concat(F.lit("a line is no JSON: "), F.left(line, F.lit(80)))).cast("boolean")
    good = F.when(line.isNull() & some.isNotNull(), True).when(line.isNull(), True).when(F.try_parse_json(line).isNotNull(), False).otherwise(error)
    return rows.where(good).drop(bad).toDF(*clean_headers(list(names)))


def _array(c: Column) -> Column:
    return F.from_json(c, "array<string>")


#: Bytes from which a document is cut into its records by many tasks.
WHOLE = 67_108_864


def read_json_document(spark: SparkSession, path: str | list[str], keys_of: int | None = None, whole: int = WHOLE) -> DataFrame:
    """A whole JSON document a file: a list of objects; an object that has one under records, rows, data or items; or an object of
    lists of equal length (a column each). All values as text. Anything else is an error.

    Documents of up to `whole` bytes are read by a task each. In larger ones the records of a list are found by many tasks
    (`documents.records`), if their first megabyte shows where the list is: so nothing bounds the size of such a document. (A
    document of columns is read by one task, up to 2 GB.)"""
    large, small = [], []
    for f, size in sized_files(spark, path):
        at = documents.list_place(head_of(spark, f, documents.HEAD).decode("utf-8", "ignore"), WRAPPERS) if size > whole else None
        (large if at else small).append((f, at))
    cut = [documents.records(spark, f, *at) for f, at in large]
    if not small and not cut:
        raise ValueError("the table is empty")
    if not small:
        return _records(_union(cut), "JSON document", keys_of)
    docs = spark.read.text([f for f, _ in small], wholetext=True)
    wrapped = F.from_json("value", strings(list(WRAPPERS)))
    inside = F.coalesce(*[F.when(F.ltrim(wrapped[w]).startswith("["), wrapped[w]) for w in WRAPPERS])
    listed = F.when(F.ltrim("value").startswith("["), F.col("value")).when(F.ltrim("value").startswith("{"), inside)
    broken = F.when(F.try_parse_json("value").isNull(), F.raise_error("the document is no JSON").cast("string")).otherwise(listed)
    docs = docs.select("value", broken.alias("list"))
    if docs.where("list is null").isEmpty():
        return _records(_union([*cut, docs.select(F.explode(_array(F.col("list"))).alias("value"))]), "JSON document", keys_of)
    columns = F.from_json("value", "map<string,string>")
    one = docs.where("list is null").select(columns.alias("m")).first()["m"]
    if not one or cut or docs.where("list is not null").count() or not all((v or "").lstrip().startswith("[") for v in one.values()):
        raise ValueError("a JSON document must be a list of objects, an object with one, or an object of lists")
    names = list(one)
    lists = docs.select(*[_array(columns[n]).alias(f"c{i}") for i, n in enumerate(names)])
    sizes = F.array(*[F.coalesce(F.size(f"c{i}"), F.lit(-1)) for i in range(len(names))])
    if lists.where(F.array_min(sizes) != F.array_max(sizes)).count():
        raise ValueError("the lists of a JSON document of columns must be of equal length")
    rows = lists.select(F.inline(F.arrays_zip(*[f"c{i}" for i in range(len(names))])))
    return rows.toDF(*clean_headers(names))


def _one_object_a_line(head: bytes, whole: bool) -> bool:
    """Whether a text that begins with { has an object of its own in its first line that isn't blank, and another line after it or no
    list inside: what separates JSON lines from a document under the same suffix."""
    lines = [x for x in head.decode("utf-8-sig", "ignore").splitlines() if x.strip()]
    if len(lines) == 1 and not whole:
        return False
    try:
        row = json.loads(lines[0])
    except ValueError:
        return False
    if not isinstance(row, dict):
        return False
    lists = any(isinstance(row.get(k), list) for k in WRAPPERS) or bool(row) and all(isinstance(v, list) for v in row.values())
    return len(lines) > 1 or not lists


#: Bytes of a file that tell its kind; where they have no whole line, so many more.
KIND_BYTES, KIND_MORE = 65_536, 1_048_576
#: Files whose first bytes are read at a time.
LOOKS = 16
_READERS = {"delimited": read_delimited, "lines": read_json_lines, "document": read_json_document}


def kind_of(spark: SparkSession, path: str) -> str:
    """What a file is, by its suffix and its first bytes: parquet, orc, workbook, lines or document (JSON), else delimited."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    suffix = name.rpartition(".")[2].lower()
    if suffix in ("parquet", "orc"):
        return suffix
    if suffix == "xls":
        raise ValueError("the old binary workbook format isn't supported")
    if suffix == "xlsx":
        return "workbook"
    if suffix in ("jsonl", "ndjson"):
        return "lines"
    head, n = head_of(spark, path, KIND_BYTES), KIND_BYTES
    if len(head) == n and b"\n" not in head and head.lstrip()[:1] in (b"[", b"{"):
        head, n = head_of(spark, path, KIND_MORE), KIND_MORE
    if head.startswith(b"PK\x03\x04"):
        return "workbook"
    if head.startswith(b"PAR1"):
        return "parquet"
    if head.startswith(b"ORC"):
        return "orc"
    if suffix == "json" or head.lstrip(b"\xef\xbb\xbf \t\r\n")[:1] in (b"[", b"{"):
        return "lines" if _one_object_a_line(head, len(head) < n) else "document"
    return "delimited"


def read_table(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """A file, a folder or a pattern, each file by its own kind (see `kind_of`; `format` overrides the suffix: parquet, orc, xlsx, jsonl, json,
    csv). JSON with an object in each line is read by lines, whatever its suffix. Files of several kinds make one table of texts: columns
    of equal names are one, in the order of the first files that have them; what a file doesn't have is null. The
    old .xls format and empty files are refused."""
    name = (format or path.rstrip("/").rsplit("/", 1)[-1].rpartition(".")[2]).lower()
    if name in ("parquet", "orc"):
        return getattr(spark.read, name)(path)
    if name == "xls":
        raise ValueError("the old binary workbook format isn't supported")
    files = files_of(spark, path)
    if not files:
        raise ValueError("the table is empty")
    given = {"xlsx": "workbook", "jsonl": "lines", "ndjson": "lines", "csv": "delimited", "tsv": "delimited"}.get((format or "").lower())
    # the files of a kind are read together; separators go with suffixes
    with ThreadPoolExecutor(LOOKS) as pool:
        kinds = [given] * len(files) if given else list(pool.map(lambda f: kind_of(spark, f), files))
    groups: dict[tuple[str, str], list[str]] = {}
    for f, kind in zip(files, kinds):
        stem, dot, suffix = f.rsplit("/", 1)[-1].rpartition(".")
        groups.setdefault((kind, (suffix if dot else stem or f) if kind == "delimited" else ""), []).append(f)
    tables = []
    for (kind, _), some in groups.items():
        if kind == "workbook":
            tables.append(read_workbooks(spark, path, some))
        elif kind in ("parquet", "orc"):
            df = getattr(spark.read, kind)(*some)
            tables.append(df if len(groups) == 1 else df.select([as_text(f).alias(f.name) for f in df.schema]))
        else:
            tables.append(_READERS[kind](spark, some))
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out
