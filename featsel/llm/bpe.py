"""Byte-level BPE: encoding by a minimal perfect hash and a heap of merges, and decoding."""

from __future__ import annotations

import base64
import heapq
from array import array

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featsel.llm.common import slices, table

#: Ranks file of the installed tokenizer package that the registered query uses.
RANKS = "byte_bpe_multi_50k.tiktoken"
_M = 0x9E3779B97F4A7C15
_ALL = 2**64 - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> id, from a file of lines `base64 id`."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class PerfectHash:
    """Minimal perfect hash of a fixed set of byte strings: key -> place 0 .. n-1, and every place
    taken. Keys fall into buckets by a first hash; each bucket, largest first, gets the smallest
    displacement that sends its keys to free places."""

    def __init__(self, keys: list[bytes]):
        self.n, self.buckets = len(keys), max(1, len(keys) // 4)
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        groups: dict[int, list[int]] = {}
        for i, h in enumerate(hashes):
            groups.setdefault(h % self.buckets, []).append(i)
        self.shift, self.keys = np.zeros(self.buckets, np.int64).tolist(), [b""] * self.n
        self.index, free = np.zeros(self.n, np.int64).tolist(), np.ones(self.n, bool)
        singles = []
        for b, members in sorted(groups.items(), key=lambda x: -len(x[1])):
            if len(members) == 1:  # placed last, straight into what is free
                singles.append((b, members[0]))
                continue
            d = 0
            while True:
                at = [self._place(hashes[i], d) for i in members]
                if len(set(at)) == len(at) and free[at].all():
                    break
                d += 1
            self._set(b, d, members, at, keys, free)
        for (b, i), place in zip(singles, np.flatnonzero(free).tolist()):
            self._set(b, -1 - place, [i], [place], keys, free)

    def _set(self, b, d, members, at, keys, free):
        self.shift[b] = d
        for i, place in zip(members, at):
            self.keys[place], self.index[place], free[place] = keys[i], i, False

    def _place(self, h: int, d: int) -> int:
        return ((((h ^ (d * _M)) & _ALL) * _M & _ALL) >> 20) % self.n

    def get(self, key: bytes) -> int:
        """Number of the key in the list it was built from; -1 for any other bytes."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        at = -1 - d if d < 0 else self._place(h, d)
        return self.index[at] if self.keys[at] == key else -1


class Vocabulary:
    """What encoding and decoding need; its size is that of the vocabulary. Sent to the tasks once."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if missing := {i for i in range(256) if bytes([i]) not in ranks}:
            raise ValueError(f"the vocabulary lacks the single bytes {sorted(missing)}")
        self.pattern = pattern
        self.tokens = list(ranks)
        self.ids = list(ranks.values())
        self.hash = PerfectHash(self.tokens)
        self.byte = [ranks[bytes([i])] for i in range(256)]
        #: left id -> right id -> id of what they merge into; ids rank the merges.
        self.merge: list[dict[int, int]] = [{} for _ in range(max(self.ids) + 1)]
        for t, r in ranks.items():
            for k in range(1, len(t)):
                if t[:k] in ranks and t[k:] in ranks:
                    self.merge[ranks[t[:k]]][ranks[t[k:]]] = r

    def whole(self, piece: bytes) -> int:
        """Id of bytes that are in the vocabulary, else -1."""
        at = self.hash.get(piece)
        return self.ids[at] if at >= 0 else -1

    def merged(self, piece: bytes) -> list[int]:
        """Ids of bytes that are not in the vocabulary: a heap holds the possible merges (rank,
        then place), the symbols are a doubly linked list, and stale heap entries are skipped."""
        ids = [self.byte[b] for b in piece]
        n, merge = len(ids), self.merge
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := merge[ids[i]].get(ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or merge[ids[i]].get(ids[j]) != r:
                continue
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (x := merge[r].get(ids[k])) is not None:
                    heapq.heappush(heap, (x, i))
            if (h := before[i]) >= 0 and (x := merge[ids[h]].get(r)) is not None:
                heapq.heappush(heap, (x, h))
        return [x for x in ids if x >= 0]

    def decoder(self):
        """Function from an int32 array of ids to the bytes they stand for; an id that is not in
        the vocabulary is an error."""
        size = max(self.ids) + 1
        length = np.zeros(size, np.int64)
        length[self.ids] = [len(t) for t in self.tokens]
        start = np.zeros(size, np.int64)
        start[self.ids] = np.cumsum([0, *map(len, self.tokens[:-1])])
        known = np.zeros(size, bool)
        known[self.ids] = True
        flat = np.frombuffer(b"".join(self.tokens), np.uint8)

        def decode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Bytes of all ids in a row, and the length of each id's."""
            if len(ids) and (ids.min() < 0 or ids.max() >= size or not known[ids].all()):
                raise ValueError("ids that the vocabulary doesn't have")
            n = length[ids]
            ends = np.cumsum(n)
            at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[ids] - ends + n, n)
            return flat[at], n

        return decode


class _Pieces(dict):
    """Stretch of text -> the int32 bytes of its ids. Holds what was used lately: when it is full,
    it becomes the older generation, which is asked before a stretch is encoded again. Stretches of more than
    `longest` characters are not kept, so that the memory is bounded too."""

    def __init__(self, vocabulary: Vocabulary, most: int, longest: int = 64):
        self.vocabulary, self.most, self.longest, self.old = vocabulary, most, longest, {}
        self.tokens: dict[str, bytes] = {}
        self.match = regex.compile(vocabulary.pattern).findall

    def _ids(self, piece: str) -> bytes:
        """Ids of one pre-token; stretches that differ in punctuation share theirs."""
        found = self.tokens.get(piece)
        if found is None:
            data = piece.encode()
            whole = self.vocabulary.whole(data)
            found = array("i", [whole] if whole >= 0 else self.vocabulary.merged(data)).tobytes()
            if len(piece) <= self.longest:
                if len(self.tokens) >= self.most:
                    self.tokens.clear()
                self.tokens[piece] = found
        return found

    def __missing__(self, stretch: str) -> bytes:
        found = self.old.get(stretch)
        if found is None:
            found = b"".join(map(self._ids, self.match(stretch)))
        if len(stretch) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[stretch] = found
        return found


#: A blank before which any pre-token ends: one space after a character that isn't white space.
#: (A space that follows white space belongs to a run of it, which the pattern must see whole.)
_RUN = regex.compile(r"\s ")
_BLANK = regex.compile(r"(?<=\S) ")


def stretches(text: str) -> list[str]:
    """Cut a text before every space that follows a character other than white space. Every
    alternative of the pattern takes a space only at its start or inside white space, so pre-tokens
    never cross such a cut, and equal stretches encode alike wherever they stand."""
    first, *rest = _BLANK.split(text) if _RUN.search(text) else text.split(" ")
    return [first, *[" " + x for x in rest]]


def _encoded(vocabulary: Vocabulary, text: int, remember: int):
    """Function from batches to batches with one more column, the ids of the texts in column number `text`."""

    def run(batches):
        pieces = _Pieces(vocabulary, remember)
        for batch in slices(batches):
            flat, n = [], [0]
            for value in batch.column(text).to_pylist():
                flat.append(b"".join(map(pieces.__getitem__, stretches(value))) if value else b"")
                n.append(len(flat[-1]) // 4)
            ids = pa.array(np.frombuffer(b"".join(flat), np.int32))
            ids = pa.ListArray.from_arrays(pa.array(np.cumsum(n), pa.int32()), ids)
            yield pa.record_batch([*batch.columns, ids], names=[*batch.schema.names, "ids"])

    return run


def _decoded(vocabulary: Vocabulary, ids: int, most: int = 2_000_000):
    """Function from batches to batches with one more column, the bytes of the ids in column number `ids`. Rows are
    decoded together up to `most` ids, so that their bytes have 32-bit offsets whatever the batch."""

    def run(batches):
        of = vocabulary.decoder()
        for batch in slices(batches):
            sizes = batch.column(ids).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            parts = np.cumsum(sizes) // most
            for first, last in zip(*(np.searchsorted(parts, np.unique(parts), side) for side in ("left", "right"))):
                part, n = batch.slice(first, last - first), sizes[first:last]
                data, each = of(part.column(ids).flatten().to_numpy(zero_copy_only=False))
                ends = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(n)])]
                raw = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
                yield pa.record_batch([*part.columns, raw], names=[*part.schema.names, "bytes"])

    return run


def _with_text(docs: DataFrame, *new: str) -> DataFrame:
    return docs.select(*[c for c in docs.columns if c not in new]).withColumn("text", F.col("text").cast("string"))


def encode(docs: DataFrame, vocabulary: Vocabulary, remember: int = 100_000) -> DataFrame:
    """`docs` with a column `ids` (array<int>): the text's tokens, each match of the vocabulary's
    pattern encoded by itself, without special tokens. A null text counts as empty: no ids.

    Every pre-token is looked up whole in the minimal perfect hash; one that isn't in the
    vocabulary is merged by the heap. Texts of any length are encoded whole. `remember` bounds
    the stretches of text whose ids a task keeps."""
    sent, docs = docs.sparkSession.sparkContext.broadcast(vocabulary), _with_text(docs, "ids")
    at = docs.columns.index("text")
    return docs.mapInArrow(lambda batches: _encoded(sent.value, at, remember)(batches), docs.withColumn("ids", F.array().cast("array<int>")).schema)


def decode(tokens: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """`tokens` with a column `bytes` (binary): what its `ids` (array<int>) stand for; null or no
    ids: empty. Ids outside the vocabulary are an error."""
    sent, tokens = tokens.sparkSession.sparkContext.broadcast(vocabulary), tokens.select(*[c for c in tokens.columns if c != "bytes"])
    at = tokens.columns.index("ids")
    return tokens.mapInArrow(lambda batches: _decoded(sent.value, at)(batches), tokens.withColumn("bytes", F.lit(None).cast("binary")).schema)


def round_trip(docs: DataFrame, vocabulary: Vocabulary, remember: int = 100_000) -> DataFrame:
    """`docs` without its text, with `ids` and `bytes`: `encode` and then `decode` in the same task, which so holds one
    vocabulary and sends the ids to Spark once."""
    sent, docs = docs.sparkSession.sparkContext.broadcast(vocabulary), _with_text(docs, "ids", "bytes")
    at, kept = docs.columns.index("text"), [c for c in docs.columns if c != "text"]

    def run(batches):
        coded = _encoded(sent.value, at, remember)(batches)
        yield from _decoded(sent.value, len(kept))(batch.drop_columns("text") for batch in coded)

    return docs.mapInArrow(run, docs.select(*kept, F.array().cast("array<int>").alias("ids"), F.lit(None).cast("binary").alias("bytes")).schema)


def vocabulary(path: str | None = None) -> Vocabulary:
    """The vocabulary of a ranks file, by default the installed one that the query names."""
    import public_tokenizers

    return Vocabulary(read_ranks(path or public_tokenizers.path(RANKS)), public_tokenizers.PATTERN)


def token_digests(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    return round_trip(docs.select("doc_id", "text"), words).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), vocabulary())
