import random

from featsel.llm import minhash_dedup as m
from featsel.llm.components import connected_components
from tests.llm.helpers import components, rows, shingles


def test_whole_table_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sets = {i: shingles(t) for i, t in rows(docs, "doc_id", "text")}
    want = components(sets)
    got = {i: (n, c, k) for i, n, c, k in rows(m.query(spark, sf), "doc_id", "n_shingles", "component_id", "kept")}
    assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    assert sum(k for _, _, k in got.values()) < len(got)


def test_groups_of_copies_and_edge_cases(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(120)]
    docs = [(i, " ".join(base[:50] + [word()] + base[51:])) for i in range(0, 40)]
    docs += [(i, " ".join(word() for _ in range(60))) for i in range(100, 110)]
    docs += [(200, None), (201, ""), (202, " \t\n"), (203, "one two"), (204, "One  TWO"), (205, "two one")]
    docs += [(300, "x " * 3000), (301, "x " * 5), (7, docs[7][1])]
    data = spark.createDataFrame([(i, t, "c", i) for i, t in docs], "doc_id long, text string, kept string, component_id long")
    sets = {i: shingles(t) for i, t in docs}
    want = components(sets)
    got = rows(m.near_duplicates(data), "doc_id", "n_shingles", "component_id", "kept")
    assert sorted(got) == sorted((i, len(sets[i]), want[i], want[i] == i) for i, _ in docs)
    assert want[39] == 0 and want[204] == 203 and want[205] == 205 and want[301] == 300


def test_null_ids_and_no_rows(spark):
    data = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    assert sorted(rows(m.near_duplicates(data), "component_id", "kept"), key=str) == [(3, True), (None, True), (None, True)]
    assert m.near_duplicates(data.limit(0)).count() == 0
    assert m.deduplicated(data).count() == 3


def test_pruning_bounds():
    least = m.fewest_matches(75)
    assert len(least) == 8 and all(a < b for a, b in zip(least, least[1:]))
    assert 0.4 * m.SIZE < least[-1] < 0.75 * m.SIZE


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(10, 60)]
    star = [(100, i) for i in range(101, 140)]
    edges = spark.createDataFrame([*chain, *star, (5, 5), (300, 200), (200, 300)], "u long, v long")
    got = dict(rows(connected_components(edges), "node", "component"))
    assert got == {**{i: 10 for i in range(10, 61)}, **{i: 100 for i in range(100, 140)}, 200: 200, 300: 200}
