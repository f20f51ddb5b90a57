"""Workbooks (.xlsx) as a data source: a partition a workbook, read and written in parts."""

from __future__ import annotations

import fnmatch
import io
import json
import posixpath
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from featsel.functions.text import clean_headers

#: Rows of a part of a sheet that a task holds at once.
ROWS = 2_000
_DIGITS = {chr(65 + k): "0123456789abcdefghijklmnop"[k] for k in range(26)}


def place(reference: str) -> int | None:
    """The column (from 0) of a cell such as AB12: the names of fewer letters come before, then its letters count in base 26."""
    letters = reference.rstrip("0123456789").upper()
    if not letters or any(c not in _DIGITS for c in letters):
        return None
    return (26 ** len(letters) - 26) // 25 + int("".join(map(_DIGITS.get, letters)), 26)


class Package:
    """A zip file of parts that name one another by relationships."""

    def __init__(self, file):
        self.zip = zipfile.ZipFile(file)
        self.names = set(self.zip.namelist())

    def related(self, part: str) -> dict[str, tuple[str, str]]:
        """Id -> (last word of the type, part) of the parts that a part ("" for the package) refers to; targets are relative to its folder."""
        folder, name = posixpath.split(part)
        rels = posixpath.join(folder, "_rels", f"{name}.rels")
        if rels not in self.names:
            return {}
        found = {}
        for r in ElementTree.fromstring(self.zip.read(rels)):
            if r.get("TargetMode") != "External" and r.get("Target"):
                at = posixpath.normpath(posixpath.join("/", folder, r.get("Target"))).lstrip("/")
                found[r.get("Id", "")] = (r.get("Type", "").rpartition("/")[2], at)
        return found

    def typed(self, part: str, kind: str, usual: str) -> str | None:
        """The related part of a type; else the one with the usual name, if there is one."""
        return next((at for k, at in self.related(part).values() if k == kind), usual if usual in self.names else None)


def _local(node: ElementTree.Element) -> str:
    return node.tag.rsplit("}", 1)[-1]


def _plain(node: ElementTree.Element) -> str:
    """A string item: its own text, or that of its runs; how it is pronounced doesn't count."""
    out = []
    for child in node:
        out += [child.text or ""] if _local(child) == "t" else [_plain(child)] if _local(child) == "r" else []
    return "".join(out)


def _shared(package: Package, book: str) -> list[str]:
    part = package.typed(book, "sharedStrings", posixpath.join(posixpath.dirname(book), "sharedStrings.xml"))
    if not part:
        return []
    with package.zip.open(part) as f:
        return [_plain(node) for _, node in ElementTree.iterparse(f) if _local(node) == "si"]


def sheet_rows(file) -> Iterator[list[str | None]]:
    """Rows (stripped texts, null where there is no cell) of the first visible sheet of a workbook that have a text in any cell."""
    package = Package(file)
    book = package.typed("", "officeDocument", "xl/workbook.xml")
    if not book:
        raise ValueError("this is no workbook")
    sheets = [s for s in ElementTree.fromstring(package.zip.read(book)).iter() if _local(s) == "sheet"]
    shown = next((s for s in sheets if s.get("state") not in ("hidden", "veryHidden")), None)
    if shown is None:
        raise ValueError("the workbook has no visible sheet")
    key = next((v for k, v in shown.attrib.items() if k.rsplit("}", 1)[-1] == "id"), "")
    sheet = package.related(book).get(key, ("", ""))[1]
    if sheet not in package.names:
        raise ValueError("the first visible sheet isn't in the workbook")
    strings = _shared(package, book)
    child = lambda cell, tag: next((x for x in cell if _local(x) == tag), None)
    value = lambda cell: (v.text or "") if (v := child(cell, "v")) is not None else ""
    # a cell's type -> its text
    decode = {
        "s": lambda cell: strings[int(v)] if (v := value(cell)).isdecimal() and int(v) < len(strings) else "",
        "inlineStr": lambda cell: _plain(i) if (i := child(cell, "is")) is not None else value(cell),
        "b": lambda cell: {"1": "true"}.get(value(cell), "false"),
    }
    with package.zip.open(sheet) as f:
        data = None
        for event, node in ElementTree.iterparse(f, events=("start", "end")):
            if event == "start":
                data = node if _local(node) == "sheetData" else data
                continue
            if _local(node) != "row":
                continue
            row: list[str | None] = []
            for cell in node:
                if _local(cell) == "c":
                    at = place(cell.get("r", ""))
                    at = len(row) if at is None else at
                    row += [None] * (at + 1 - len(row))
                    row[at] = decode.get(cell.get("t", ""), value)(cell).strip()
            node.clear()
            if data is not None:
                data.clear()  # rows that were read
            if any(row):
                yield row


def located(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system and the path in it of a local path or of a URI that pyarrow can open."""
    if "://" not in path and not path.startswith("file:"):
        return pa.fs.LocalFileSystem(), path
    return pa.fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def _listed(path: str) -> list[str]:
    """The workbooks at a path: a file, the files of a folder, or those of a folder whose name fits a pattern."""
    fs, at = located(path)
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    folder, name = posixpath.split(at)
    if any(c in name for c in "*?["):
        found = [i for i in fs.get_file_info(pa.fs.FileSelector(folder)) if fnmatch.fnmatchcase(i.base_name, name)]
    else:
        info = fs.get_file_info(at)
        found = fs.get_file_info(pa.fs.FileSelector(at)) if info.type == pa.fs.FileType.Directory else [info]
        found = [i for i in found if i.type == pa.fs.FileType.File and i.base_name[0] not in "._"]
    return sorted(prefix + i.path for i in found if i.type == pa.fs.FileType.File)


@dataclass
class OneFile(InputPartition):
    path: str

    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class WorkbookReader(DataSourceReader):
    def __init__(self, files: list[str], names: list[str], what: str):
        self.files, self.names, self.what = files, names, what

    def partitions(self) -> list[InputPartition]:
        return [OneFile(f) for f in self.files]

    def read(self, partition: OneFile):
        fs, at = located(partition.path)
        with fs.open_input_file(at) as f:
            rows = sheet_rows(f)
            header = next(rows, None)
            if self.what == "headers":
                yield partition.path, [x or "" for x in header or []]
                return
            if header is None:
                return
            if clean_headers([x or "" for x in header]) != self.names:
                raise ValueError(f"the workbooks have different headers: {partition.path}")
            part: list[list] = []
            for row in rows:
                part.append(row[: len(self.names)] + [""] * (len(self.names) - len(row)))
                if len(part) == ROWS:
                    yield self._batch(part)
                    part = []
            if part:
                yield self._batch(part)

    def _batch(self, rows: list[list]) -> pa.RecordBatch:
        columns = zip(*[[x or "" for x in row] for row in rows])
        return pa.record_batch([pa.array(c, pa.string()) for c in columns], names=self.names)


class WorkbookWriter(DataSourceArrowWriter):
    """Each task writes a workbook of its rows into a folder of the job; they move to their place when all are done."""

    def __init__(self, path: str, names: list[str], overwrite: bool):
        self.path, self.names, self.overwrite = path.rstrip("/"), names, overwrite
        self.aside = f"{self.path}/_part-{uuid.uuid4().hex}"

    def write(self, iterator) -> WriterCommitMessage:
        fs, at = located(self.aside)
        fs.create_dir(at)
        name = f"part-{uuid.uuid4().hex}.xlsx"
        batches, some = iter(iterator), False
        with fs.open_output_stream(f"{at}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for part, text in _SKELETON.items():
                z.writestr(part, text)
            with z.open("xl/worksheets/sheet1.xml", "w") as sheet:
                sheet.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}"><sheetData>'.encode())
                sheet.write(_row(self.names))
                for batch in batches:
                    for row in zip(*[c.cast(pa.string()).to_pylist() for c in batch.columns]):
                        some = True
                        sheet.write(_row(row))
                sheet.write(b"</sheetData></worksheet>")
        if not some:
            fs.delete_file(f"{at}/{name}")
        return _Wrote(name if some else None)

    def commit(self, messages) -> None:
        fs, at = located(self.aside)
        _, to = located(self.path)
        if self.overwrite:
            for i in fs.get_file_info(pa.fs.FileSelector(to)):
                if i.type == pa.fs.FileType.File:
                    fs.delete_file(i.path)
        for m in messages:
            if m and m.name:
                fs.move(f"{at}/{m.name}", f"{to}/{m.name}")
        fs.delete_dir(at)

    def abort(self, messages) -> None:
        fs, at = located(self.aside)
        if fs.get_file_info(at).type == pa.fs.FileType.Directory:
            fs.delete_dir(at)


@dataclass
class _Wrote(WriterCommitMessage):
    name: str | None


# Names and parts of the file format.
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_HEAD = '<?xml version="1.0" encoding="UTF-8"?>'
_SKELETON = {
    "[Content_Types].xml": f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
    '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="book" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets><sheet name="Data" sheetId="1" r:id="sheet"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="sheet" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


def _row(values) -> bytes:
    cells = "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' if v is not None else "<c/>" for v in values)
    return f"<row>{cells}</row>".encode()


class WorkbookSource(DataSource):
    """`spark.read.format("workbook").load(path)` and `df.write.format("workbook").save(path)`, once `register`ed.

    Options for reading: what = rows (all values as text, under the first row's names) or headers (path, header of each file);
    files: a JSON list of paths instead of `path`. All workbooks must have the same header. Writing makes a workbook a task."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def _files(self) -> list[str]:
        return json.loads(self.options["files"]) if "files" in self.options else _listed(self.options["path"])

    def schema(self) -> T.StructType:
        if self.options.get("what") == "headers":
            return T.StructType([T.StructField("path", T.StringType()), T.StructField("header", T.ArrayType(T.StringType()))])
        for path in self._files():
            fs, at = located(path)
            with fs.open_input_file(at) as f:
                header = next(sheet_rows(f), None)
            if header is not None:
                return T.StructType([T.StructField(n, T.StringType()) for n in clean_headers([x or "" for x in header])])
        raise ValueError("the workbook is empty")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return WorkbookReader(self._files(), schema.names, self.options.get("what", "rows"))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WorkbookWriter(self.options["path"], schema.names, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkbookSource)


def write_workbooks(df: DataFrame, path: str, mode: str = "append") -> None:
    """The rows as texts, one workbook a task, under the columns' names."""
    register(df.sparkSession)
    df.select([F.col("`" + c.replace("`", "``") + "`").cast("string").alias(c) for c in df.columns]).write.format("workbook").mode(mode).save(path)


def _openable(path: str) -> bool:
    try:
        located(path)
    except Exception:  # a store that only Spark knows
        return False
    return True


def read_workbooks(spark: SparkSession, path: str, files: list[str] | None = None) -> DataFrame:
    """The rows of all workbooks under a path (a file, folder or pattern), all values as text. The first row with a text is a workbook's
    header; all must have the same. A workbook is a partition and is read in parts of a few thousand rows.

    Only the parts of a file that are needed are read, where pyarrow can open its store; in other stores Spark loads files as
    wholes (2 GB at the most each)."""
    if not _openable((files or [path])[0]):
        return _from_wholes(spark, files or path)
    register(spark)
    given = json.dumps(files if files else _listed(path))
    if given == "[]":
        raise ValueError("the workbook is empty")
    headers = spark.read.format("workbook").options(what="headers", files=given).load().where(F.size("header") > 0).select("header").distinct().limit(2).collect()
    return spark.read.format("workbook").schema(_schema(headers)).options(files=given).load()


def _schema(headers: list) -> T.StructType:
    if not headers:
        raise ValueError("the workbook is empty")
    if len(headers) > 1:
        raise ValueError("the workbooks have different headers")
    return T.StructType([T.StructField(n, T.StringType()) for n in clean_headers(list(headers[0][0]))])


def _from_wholes(spark: SparkSession, path) -> DataFrame:
    def run(batches):
        kind = pa.list_(pa.string())
        for batch in batches:
            for content in batch.column(0):
                part: list[tuple[bool, list]] = []
                for k, row in enumerate(sheet_rows(io.BytesIO(content.as_py()))):
                    part.append((k == 0, [x or "" for x in row]))
                    if len(part) == ROWS:
                        yield pa.record_batch([pa.array([p[0] for p in part]), pa.array([p[1] for p in part], kind)], names=["head", "cells"])
                        part = []
                if part:
                    yield pa.record_batch([pa.array([p[0] for p in part]), pa.array([p[1] for p in part], kind)], names=["head", "cells"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "head boolean, cells array<string>")
    names = _schema(rows.where("head").select("cells").distinct().limit(2).collect()).names
    return rows.where("not head").select([F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(names)])
