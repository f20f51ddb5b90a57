import hashlib

import pytest
import tiktoken

from featsel.llm import bpe
from tests.llm.helpers import rows

V = bpe.vocabulary()
RANKS = dict(zip(V.tokens, V.ids))
REF = tiktoken.Encoding("own", pat_str=V.pattern, mergeable_ranks=RANKS, special_tokens={})

TEXTS = [
    "", " ", "  ", "a", " a", "a  b   c", "\n\n a \t b\r\n  c ", "don't we'll I'M x's", "naïve Ångström ½ ² Ⅷ 12345",
    "　wide nbsp em \x1c sep \x85 nel", "日本語 テスト", "😀😀 👩‍👩‍👧", "<|endoftext|> x", "***&&&$$$ ### a!!", "é ée",
    " \n x \n\n\n y", "a" * 3000, "ththandwh " * 500, "\t", "a\tb c\t d", "x  y   z", "_ __ a_b 1_2 ", "Ⅷ Ⅷ9 a½b", "\x1c \x1d a", "a \x1cb",
]


def test_perfect_hash_is_minimal_and_perfect():
    h = V.hash
    assert sorted(h.index) == list(range(len(V.tokens))) and all(h.get(t) == i for i, t in enumerate(V.tokens))
    assert h.get(b"surely not a token") == -1 and bpe.PerfectHash([b"x"]).get(b"x") == 0


def test_heap_equals_reference_merges():
    for text in TEXTS:
        for piece in bpe._Pieces(V, 10).match(text):
            assert V.merged(piece.encode()) == REF.encode_ordinary(piece) or V.whole(piece.encode()) >= 0


@pytest.mark.parametrize("most", [3, 1000])
def test_stretches_encode_alike(most):
    pieces = bpe._Pieces(V, most)
    import numpy as np

    for text in TEXTS + [a + b for a in TEXTS[:14] for b in TEXTS[:14]]:
        ids = np.frombuffer(b"".join(pieces[s] for s in bpe.stretches(text)), np.int32).tolist()
        assert ids == REF.encode_ordinary(text), text


def test_whole_table(spark, sf):
    docs = rows(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in docs:
        ids = REF.encode_ordinary(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha(REF.decode_bytes(ids))))
    assert sorted(rows(bpe.query(spark, sf), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) == sorted(want)


def test_edge_rows(spark):
    data = spark.createDataFrame([(i, t, "x", 1.5) for i, t in enumerate([*TEXTS, None, None])], "doc_id long, text string, ids string, bytes double")
    coded = bpe.encode(data, V)
    back = bpe.decode(coded, V)
    got = {i: (ids, bytes(b)) for i, ids, b in rows(back, "doc_id", "ids", "bytes")}
    assert got == {i: (REF.encode_ordinary(t or ""), (t or "").encode()) for i, t in enumerate([*TEXTS, None, None])}
    assert bpe.token_digests(data.limit(0), V).count() == 0 and "bytes" in coded.columns
    with pytest.raises(Exception, match="doesn't have"):
        bpe.decode(spark.createDataFrame([([10**6],)], "ids array<int>"), V).collect()
