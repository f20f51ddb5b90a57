import pytest

from featsel.sources.tables import read_json_document, read_table


def test_whole_documents_are_read(spark, tmp_path):
    texts = (
        '[{"a": 1, "b": [2]}, 5, {"a": 3}]', '[\n{"a": 1, "b": [2]},\n{"a": 3}\n]', '{\n"a": [1, 3], "b": [[2], null]}',
        '{"version": 1, "records": [{"a": 1, "b": [2]}, {"a": 3}]}', '{"items": [{"a": 1, "b": [2]}, {"a": 3}], "rows": 7}', '{"a": [1, 3], "b": [[2], null]}',
    )
    for k, text in enumerate(texts):
        (tmp_path / f"{k}.json").write_text(text)
        got = read_table(spark, str(tmp_path / f"{k}.json"))
        assert [(r["a"], r["b"]) for r in got.collect()] == [("1", "[2]"), ("3", None)], text
    (tmp_path / "lines.json").write_text('{"a": 1, "b": [2]}\n\n{"a": 3}\n')
    assert [r["a"] for r in read_table(spark, str(tmp_path / "lines.json")).collect()] == ["1", "3"]


def test_other_documents_are_errors(spark, tmp_path):
    for k, text in enumerate(('{"a": [1, 2], "b": [1]}', '{"a": {"b": 1}}', "[]", "[1, 2]", '{"a": [1], "b": 2}')):
        (tmp_path / f"{k}.json").write_text(text)
        with pytest.raises(ValueError, match="JSON document"):
            read_json_document(spark, str(tmp_path / f"{k}.json"))
    (tmp_path / "broken.json").write_text('[{"a": 1}, {"a": ')
    with pytest.raises(Exception, match="no JSON"):
        read_json_document(spark, str(tmp_path / "broken.json")).collect()
