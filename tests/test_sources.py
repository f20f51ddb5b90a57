import json
import zipfile

import pytest

from featsel.operators.prepare import prepare
from featsel.sources import synthetic, tables
from featsel.sources.workbooks import read_workbooks


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_delimited_heads_and_line_breaks(spark, tmp_path):
    at = str(tmp_path / "a.csv")
    with open(at, "w") as f:
        f.write('\n\nname,"long\nname",name\n"x, ""y""","two\nlines",3\nshort\n\n1,2,3,4\n')
    df = tables.read_delimited(spark, at)
    assert df.columns == ["name", "long\nname", "name_2"]
    assert rows(df) == [('x, "y"', "two\nlines", "3"), ("short", None, None), ("1", "2", "3")]
    (tmp_path / "b.csv").write_bytes("größe;länge\n1;ä\n2;ö\n".encode("latin-1"))
    df = tables.read_delimited(spark, str(tmp_path / "b.csv"), encoding="ISO-8859-1")
    assert df.columns == ["größe", "länge"] and rows(df) == [("1", "ä"), ("2", "ö")]
    for sep in "\t;|":
        (tmp_path / "c.txt").write_text("\n".join(sep.join(r) for r in (["a, b", "c"], ["1", "2"], ["3", "4"])))
        assert tables.read_table(spark, str(tmp_path / "c.txt")).columns == ["a, b", "c"]
    (tmp_path / "d.csv").write_text("only\n1\n")
    for name, text in (("d.csv", "only\n1\n"), ("e.csv", ""), ("f.csv", "\n \n")):
        (tmp_path / name).write_text(text)
        with pytest.raises(ValueError):
            tables.read_table(spark, str(tmp_path / name))


def test_json_lines_are_strict(spark, tmp_path):
    lines = [json.dumps({"b": i, "a": {"x": i}}) for i in range(600)]
    at = str(tmp_path / "a.jsonl")
    with open(at, "w") as f:
        f.write("\n".join([*lines, "[1, 2]", "7", '"text"', "", '{"late": 1, "b": true}']))
    df = tables.read_json_lines(spark, at)
    got = rows(df)
    assert df.columns == ["b", "a", "late"] and len(got) == 601 and ("true", None, "1") in got and ("5", '{"x": 5}', None) in got
    assert tables.read_json_lines(spark, at, keys_of=500).columns == ["b", "a"]
    with open(at, "a") as f:
        f.write("\n{broken")
    with pytest.raises(Exception, match="no JSON"):
        tables.read_json_lines(spark, at).collect()


def workbook(path, cells, hidden=False, shared=()):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    first = '<sheet name="Old" sheetId="2" state="hidden" r:id="rId2"/>' if hidden else ""
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook {ns} {rel}><sheets>{first}<sheet name="Data" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId2" Target="none.xml"/><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><r><t>{s[:1]}</t></r><r><t>{s[1:]}</t></r></si>" for s in shared) + "</sst>")
        body = "".join("<row>" + "".join(r) + "</row>" for r in cells)
        z.writestr("xl/worksheets/sheet1.xml", f'<?xml version="1.0"?><worksheet {ns}><sheetData>{body}</sheetData></worksheet>')


def test_workbooks(spark, tmp_path):
    text = lambda ref, x: f'<c r="{ref}" t="inlineStr"><is><t>{x}</t></is></c>'
    number = lambda ref, x: f'<c r="{ref}"><v>{x}</v></c>'
    head = [text("A1", "first"), text("B1", "second"), text("C1", "target")]
    workbook(tmp_path / "a.xlsx", [head, *[[number(f"A{i + 1}", i), number(f"B{i + 1}", i % 5), number(f"C{i + 1}", i % 2)] for i in range(1, 37)]])
    df = tables.read_table(spark, str(tmp_path / "a.xlsx"))
    assert df.columns == ["first", "second", "target"] and df.count() == 36
    ready = prepare(df, "target")
    assert ready.task == "classification" and [f[0] for f in ready.features] == ["first", "second"]
    (tmp_path / "plain").write_bytes((tmp_path / "a.xlsx").read_bytes())
    assert tables.read_table(spark, str(tmp_path / "plain")).count() == 36
    # hidden sheets, shared strings, booleans, sparse cells, empty rows
    workbook(tmp_path / "b.xlsx", [[], ['<c r="A2" t="s"><v>0</v></c>', text("C2", "z")], ['<c r="A3" t="b"><v>1</v></c>'], [text("C4", "end"), text("AB4", "far")]], True, ("name",))
    df = read_workbooks(spark, str(tmp_path / "b.xlsx"))
    assert df.columns == ["name", "column_2", "z"] and rows(df) == [("true", "", ""), ("", "", "end")]
    with pytest.raises(ValueError, match="different headers"):
        read_workbooks(spark, str(tmp_path / "*.xlsx"))
    with pytest.raises(ValueError, match="binary workbook"):
        tables.read_table(spark, str(tmp_path / "a.xls"))


def test_synthetic_tables(spark):
    df = synthetic.device_failure(spark.range(20_000)).toPandas()
    assert list(df.columns) == ["id", *synthetic.DEVICE_INPUTS, "fails_within_24h"]
    c = df.corr()
    assert abs(c.loc["thermal_gradient", "thermal_sensor_b"] - 0.964) < 0.01 and abs(c.loc["vibration_rms", "vibration_peak"] - 0.950) < 0.01
    assert abs(c.loc["noise_probe_a", "noise_probe_b"]) < 0.03 and abs(c.loc["rack_position", "fails_within_24h"]) < 0.03
    assert c.loc["thermal_gradient", "fails_within_24h"] > 0.3 and 0.4 < df["fails_within_24h"].mean() < 0.6
    w = synthetic.workload_cost(spark.range(20_000).repartition(7)).toPandas()
    assert abs(w["request_rate"].mean()) < 0.03 and abs(w["request_rate"].std() - 1) < 0.03 and set((w["weekday"] * 3 + 3).round().astype(int)) == set(range(7))
    assert abs(w["hourly_cost_usd"].mean() - 21) < 0.3 and w.corr().loc["request_rate", "hourly_cost_usd"] > 0.7
