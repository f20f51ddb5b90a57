"""Delimited text cut into records by many tasks, against the csv module."""

import csv
import io
import random

import pytest

from featsel.sources import delimited, tables


def rows(df):
    return [tuple(r) for r in df.collect()]


def plain(text, sep, width):
    """Records after the header as the csv module reads them: padded, cut, blank values null."""
    found = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep) if r]
    first = next(k for k, r in enumerate(found) if any(x.strip() for x in r))
    return sorted((tuple(x or None for x in r[:width]) + (None,) * (width - len(r)) for r in found[first + 1 :]), key=str)


@pytest.fixture
def small_blocks(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "1")

    def of(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))

    yield of
    for k, v in old.items():
        spark.conf.set(k, v)


def test_records_that_cross_blocks(spark, tmp_path, small_blocks):
    rng = random.Random(1)
    value = lambda: rng.choice(["a", "", 'x "y" z', "two\nlines", "a\r\n\r\nb;c", "Ü" * 9, '"', "\n\n" + "long line " * 30 + "\n" * 3, 'in"ner'])
    out = io.StringIO()
    writer = csv.writer(out, delimiter=";", lineterminator="\n")
    writer.writerows([["na\nme", "b", "c"], *[[value() for _ in range(3)] for _ in range(300)], ["stray", 'a"b', "end"]])
    text = out.getvalue() + 'p;q"uo;r\n;;\n\n"x;"" y\nz";last'
    (tmp_path / "a.csv").write_bytes(text.encode())
    for size in (60, 333, 5_000, 10**6):
        small_blocks(size)
        df = tables.read_delimited(spark, str(tmp_path / "a.csv"), sep=";")
        assert df.columns == ["na\nme", "b", "c"]
        assert sorted(rows(df), key=str) == plain(text, ";", 3), size
    small_blocks(333)
    assert tables.read_delimited(spark, str(tmp_path / "a.csv"), sep=";").rdd.getNumPartitions() > 10


def test_an_open_quote_at_the_end(spark, tmp_path, small_blocks):
    text = "a,b\n1,2\n3," + '"never closed\n' + "x,y\n" * 50
    (tmp_path / "a.csv").write_text(text)
    for size in (40, 10**6):
        small_blocks(size)
        assert sorted(rows(tables.read_delimited(spark, str(tmp_path / "a.csv"))), key=str) == plain(text, ",", 2)


def test_wide_and_blank_led_headers(spark, tmp_path, small_blocks):
    names = [f"a rather long name of column {k}" for k in range(4_000)]
    (tmp_path / "wide.csv").write_text(",".join(names) + "\n" + ",".join(map(str, range(4_000))) + "\n")
    df = tables.read_delimited(spark, str(tmp_path / "wide.csv"))
    assert df.columns == names and rows(df) == [tuple(map(str, range(4_000)))]
    (tmp_path / "led.csv").write_text(",,\n \n, ,\na,b,c\n1,2,3\na,b,c\n")
    df = tables.read_delimited(spark, str(tmp_path / "led.csv"))
    assert df.columns == ["a", "b", "c"] and sorted(rows(df)) == [("1", "2", "3"), ("a", "b", "c")]
    folder = tmp_path / "many"
    folder.mkdir()
    for k in range(5):
        (folder / f"{k}.csv").write_text(",\n" * k + f'x,y\n{k},"l\n{k}"\n')
    for size in (12, 10**6):
        small_blocks(size)
        assert sorted(rows(tables.read_delimited(spark, str(folder)))) == [(str(k), f"l\n{k}") for k in range(5)]


def test_encodings_are_found(spark, tmp_path):
    text = "größe;länge;preis\n1;ä;5 €\n2;ö;6 €\n"
    for name, encoding in (("utf", "utf-8"), ("mark", "utf-8-sig"), ("wide", "utf-16"), ("windows", "cp1252"), ("le", "utf-16-le")):
        (tmp_path / f"{name}.csv").write_bytes(text.encode(encoding))
        df = tables.read_table(spark, str(tmp_path / f"{name}.csv"))
        assert df.columns == ["größe", "länge", "preis"] and sorted(rows(df)) == [("1", "ä", "5 €"), ("2", "ö", "6 €")], encoding
    (tmp_path / "late.csv").write_bytes(b"a,b\n" + b"x,y\n" * 5_000 + "ü,z\n".encode("cp1252"))
    assert ("ü", "z") in rows(tables.read_delimited(spark, str(tmp_path / "late.csv")))


def test_open_after():
    for line, inside, want in (('a,"b', False, True), ('a"b,"', False, True), ('a,"b""', False, True), ('a,"b"""', False, False), ('x","y', True, True), ('x"y,z', True, False), ("", True, True), ('"', False, True), ('""', False, False)):
        assert delimited.open_after(line, inside, ",") is want, line


def test_a_folder_of_several_kinds(spark, tmp_path):
    from featsel.sources.workbooks import write_workbooks

    (tmp_path / "a.csv").write_text("id,name\n1,one\n2,two\n")
    (tmp_path / "b.jsonl").write_text('{"id": 3, "name": "three"}\n{"id": 4, "more": true}\n')
    (tmp_path / "c.json").write_text('[{"id": 5, "name": "five"}]')
    (tmp_path / "c2.json").write_text('{"id": 10, "name": "ten"}\n{"id": 11, "name": "eleven"}\n')
    (tmp_path / "d").write_text("id\tname\n6\tsix\n")
    write_workbooks(spark.createDataFrame([("7", "seven"), ("8", None)], "id string, name string").coalesce(1), str(tmp_path))
    spark.createDataFrame([(9, "nine")], "id int, name string").coalesce(1).write.parquet(str(tmp_path / "e"))
    got = {r["id"]: (r["name"] or None, r["more"]) for r in tables.read_table(spark, str(tmp_path)).collect()}
    names = {"1": "one", "2": "two", "3": "three", "4": None, "5": "five", "6": "six", "7": "seven", "8": None, "9": "nine", "10": "ten", "11": "eleven"}
    assert got == {k: (v, "true" if k == "4" else None) for k, v in names.items()}
