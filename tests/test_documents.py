"""Large JSON documents cut into records by many tasks, against the json module."""

import json
import random

import pytest

from featsel.sources import documents, tables


@pytest.fixture
def small_blocks(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    for k, v in old.items():
        spark.conf.set(k, v)


def value(rng, depth=0):
    kind = rng.randrange(9 if depth < 3 else 6)
    if kind < 5:
        return rng.choice([1, -2.5, None, True, "", "a}b{c", 'quote " and \\ back', "]},[{", "Ü" * 20, "x" * 90, "\\\\", '\\"', "line\nbreak"])
    if kind < 6:
        return [] if rng.random() < 0.5 else {}
    if kind < 8:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice("abc}{"): value(rng, depth + 1) for _ in range(rng.randrange(4))}


@pytest.mark.parametrize("form", range(5))
def test_records_of_large_documents(spark, tmp_path, small_blocks, form):
    rng = random.Random(form)
    rows = [{"id": i, "v": value(rng), "w": value(rng)} for i in range(60)]
    mixed = [x for r in rows for x in ([r, [{"id": "no"}, [1, "}"]], 7, "}{"] if rng.random() < 0.2 else [r])]
    doc = [mixed, {"records": mixed}, {"meta": [{"id": "no"}], "n": {"rows": [{"id": "no"}]}, "rows": mixed, "after": [{"id": "no"}]}, {"data": rows, "x": "]"}, {"items": [], "data": mixed}][form]
    at = tmp_path / "a.json"
    at.write_text(json.dumps(doc, indent=rng.choice([None, 1]), ensure_ascii=form % 2 == 0))
    for size in (600, 10**7):
        small_blocks(size)
        got = {r["id"]: (r["v"], r["w"]) for r in tables.read_json_document(spark, str(at), whole=10).collect()}
        assert got.keys() == {str(i) for i in range(60)}, size
        for r in rows:
            for key, text in zip("vw", got[str(r["id"])]):
                want = r[key]
                assert text == want if isinstance(want, str) else text is None if want is None else json.loads(text) == want
    small_blocks(600)
    level, member = documents.list_place(at.read_text(), tables.WRAPPERS)
    assert documents.records(spark, str(at), level, member).rdd.getNumPartitions() > 4


def test_places_and_errors(spark, tmp_path):
    place = lambda x: documents.list_place(x if isinstance(x, str) else json.dumps(x), tables.WRAPPERS)
    assert place([1]) == (1, None) and place({"a": [1, {"rows": [2]}], "b": 3, "rows": [4]}) == (2, 2) and place({"a": {"rows": []}}) is None
    assert place({"items": [], "records": []}) == (2, 1) and place('"x"') is None and place({"rows": {"a": 1}}) is None and place({"a": "rows", "data": []}) == (2, 1)
    (tmp_path / "b.json").write_text('[{"a": 1}, {"a": 2}, {"a": ')
    with pytest.raises(Exception, match="no JSON"):
        tables.read_json_document(spark, str(tmp_path / "b.json"), whole=3).collect()
