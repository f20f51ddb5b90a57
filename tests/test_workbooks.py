"""Workbooks by the rules of their format, and the data source that reads and writes them."""

import io
import json
import zipfile

import pytest

from featsel.sinks.tables import write_document
from featsel.sources import workbooks
from featsel.sources.workbooks import place, read_workbooks, sheet_rows, write_workbooks

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    out.seek(0)
    return out


def relations(**to):
    return "<Relationships>" + "".join(f'<Relationship Id="{k}" Type="{OFFICE}/{kind}" Target="{at}"/>' for k, (kind, at) in to.items()) + "</Relationships>"


def odd_package(sheet, strings="", first="visible"):
    """A package whose parts have unusual names and places."""
    return package({
        "_rels/.rels": relations(a=("officeDocument", "/books/main.xml")),
        "books/main.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets><sheet name="0" state="veryHidden" r:id="h"/><sheet name="1" state="{first}" r:id="s"/></sheets></workbook>',
        "books/_rels/main.xml.rels": relations(h=("worksheet", "none.xml"), s=("worksheet", "../pages/one.xml"), t=("sharedStrings", "../texts.xml")),
        "pages/one.xml": f'<worksheet xmlns="{MAIN}"><sheetData>{sheet}</sheetData></worksheet>',
        "texts.xml": f'<sst xmlns="{MAIN}">{strings}</sst>',
    })


def test_places():
    names = ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA", "XFD"]
    assert [place(f"{n}7") for n in names] == [0, 25, 26, 51, 52, 701, 702, 16383] and place("") is None and place("12") is None


def test_cells_follow_the_format():
    sheet = (
        '<row/><row><c r="B1"><v> </v></c></row>'
        '<row><c r="A2" t="s"><v>0</v></c><c t="s"><v>1</v></c><c r="D2" t="inlineStr"><is><r><t>in</t></r><r><t>line</t></r></is></c></row>'
        '<row><c t="b"><v>1</v></c><c t="b"><v>0</v></c><c t="str"><v> formula </v></c><c t="s"><v>99</v></c><c><v>1.50</v></c></row>'
    )
    strings = "<si><t>na</t></si><si><r><t>run</t></r><rPh><t>spoken</t></rPh><r><t>s</t></r></si>"
    assert list(sheet_rows(odd_package(sheet, strings))) == [["na", "runs", None, "inline"], ["true", "false", "formula", "", "1.50"]]
    with pytest.raises(ValueError, match="no visible sheet"):
        list(sheet_rows(odd_package(sheet, first="hidden")))
    with pytest.raises(ValueError, match="no workbook"):
        list(sheet_rows(package({"a": "b"})))


def test_round_trip_and_parts(spark, tmp_path, monkeypatch):
    df = spark.range(5_000).selectExpr("id", "if(id % 7 = 0, null, concat('<&> \"', id, ' ')) as text", "id % 2 = 0 as even")
    at = str(tmp_path / "books")
    write_workbooks(df.repartition(3), at)
    assert sorted(p.suffix for p in (tmp_path / "books").iterdir()) == [".xlsx"] * 3
    out = read_workbooks(spark, at)
    assert out.rdd.getNumPartitions() == 3
    want = sorted((str(i), "" if i % 7 == 0 else f'<&> "{i}', str(i % 2 == 0).lower()) for i in range(5_000))
    assert sorted(map(tuple, out.collect())) == want
    write_workbooks(df.where("id < 3").coalesce(1), at, "overwrite")
    assert read_workbooks(spark, at).count() == 3 and sorted(map(tuple, spark.read.format("workbook").load(at).collect())) == [w for w in want if int(w[0]) < 3]
    # a store that only Spark opens
    monkeypatch.setattr(workbooks, "_openable", lambda path: False)
    assert sorted(map(tuple, read_workbooks(spark, at).collect())) == [w for w in want if int(w[0]) < 3]


def test_document(spark, tmp_path):
    tables = {"selection": spark.createDataFrame([(2, ["a", "b"], None)], "k int, names array<string>, energy double"), "features": spark.createDataFrame([(2, "b"), (1, "a")], "position int, name string"), "data": spark.range(3), "notes": spark.createDataFrame([], "position int, note string")}
    at = str(tmp_path / "out" / "result.json")
    write_document(tables, at)
    want = {"selection": {"k": 2, "names": ["a", "b"], "energy": None}, "features": [{"position": 1, "name": "a"}, {"position": 2, "name": "b"}], "notes": []}
    assert json.loads((tmp_path / "out" / "result.json").read_text()) == want
    assert [p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")] == ["result.json"]
    with pytest.raises(ValueError, match="exists"):
        write_document(tables, at)
    write_document({"notes": tables["notes"]}, at, overwrite=True)
    assert json.loads((tmp_path / "out" / "result.json").read_text()) == {"notes": []}
