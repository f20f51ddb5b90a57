"""Toxicity: a bidirectional gated recurrent network over word and character inputs, in numpy."""

from __future__ import annotations

import re
import sys
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featsel.llm.common import slices, table, written

#: Words in a window, and by how many the next one starts later.
WINDOW, STEP = 32, 24
#: Character trigrams are hashed into so many rows; sizes of embeddings and of each direction's state.
TRIGRAMS, EMBED, STATE = 4096, 8, 6
#: Score from which a text is predicted toxic.
TOXIC = 0.7
#: Bytes of a word that its trigrams are made of; a longer run without blanks is cut into pieces.
LONGEST = 40
_EDGE = bytes(b for b in range(128) if not chr(b).isalnum())


def plain(word: bytes) -> bytes:
    """A word as the network reads it: lower case, without signs at its ends."""
    return word.strip(_EDGE).lower()


@lru_cache
def _between() -> re.Pattern:
    """Runs of blanks, controls and punctuation of Unicode and of ASCII signs (without apostrophes)."""
    apart = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("Cc", "Zs", "Zl", "Zp", "Pc", "Pd", "Ps", "Pe", "Pi", "Pf", "Po") or c in "$+<=>^`|~"]
    return re.compile("[" + re.escape("".join(c for c in apart if c not in "'\u2019")) + "]+")


def pieces(word: bytes) -> list[bytes]:
    """A run without blanks as steps of the network: itself, if its plain form has LONGEST bytes at most; else its parts between
    Unicode blanks and punctuation, those that are still longer cut into consecutive ones of whole characters."""
    core = plain(word)
    if len(core) <= LONGEST:
        return [word]
    out = []
    parts = [x.encode("utf-8", "surrogateescape") for x in _between().split(core.decode("utf-8", "surrogateescape")) if x]
    for part in parts or [core]:
        while len(part) > LONGEST:
            k = next((k for k in range(LONGEST, LONGEST - 4, -1) if part[k] & 0xC0 != 0x80), LONGEST)
            out.append(part[:k])
            part = part[k:]
        out.append(part)
    return out


def steps(text: bytes) -> list[bytes]:
    """The steps of a text: its words at ASCII blanks, long ones in pieces, so that all of it is read."""
    words = text.split()
    if max(map(len, words), default=0) <= LONGEST:
        return words
    return [x for w in words for x in (pieces(w) if len(w) > LONGEST else (w,))]


def windows(n: int) -> np.ndarray:
    """First words of the overlapping windows of a text of n words (the last one may end early)."""
    return np.arange(0, max(1, n - (WINDOW - STEP)), STEP) if n else np.empty(0, np.int64)


def trigram_rows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed rows of every word's character trigrams (with borders), and where each word's start."""
    flat = np.frombuffer(b"".join(b"^" + w[:LONGEST] + b"$$" for w in words), np.uint8).astype(np.uint32)
    ends = np.cumsum([min(len(w), LONGEST) + 3 for w in words])
    code = flat[:-2] * np.uint32(65599) + flat[1:-1] * np.uint32(257) + flat[2:]
    code = (code * np.uint32(2654435761)) >> np.uint32(20)
    keep = np.ones(len(code), bool)
    keep[np.concatenate([ends[:-1] - 1, ends[:-1] - 2]) if len(words) > 1 else []] = False
    counts = np.diff(np.concatenate([[0], ends])) - 2
    return code[keep].astype(np.int64) % TRIGRAMS, np.concatenate([[0], np.cumsum(counts)[:-1]])


def prefix_rows(words: list[bytes]) -> np.ndarray:
    """Hashed rows of every word's first 4, 5, 6 and 7 bytes (as many as it has), (words, 4)."""
    head = np.frombuffer(b"".join(w[:7].ljust(7, b"\0") for w in words), np.uint8).reshape(-1, 7).astype(np.uint32)
    code = np.full(len(words), np.uint32(2166136261))
    out = np.empty((len(words), 4), np.int64)
    for k in range(7):
        code = (code ^ head[:, k]) * np.uint32(16777619)
        if k >= 3:
            out[:, k - 3] = (code * np.uint32(2654435761)) >> np.uint32(20)
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    """Parameters: embeddings of known words (row 0: all others) and of trigrams and of prefixes (a word's are averaged), a
    gated recurrent unit for each direction, attention over the steps, and a logistic output."""

    words: dict[bytes, int]
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def new(cls, vocabulary: list[bytes], seed: int = 0) -> Network:
        r = np.random.default_rng(seed)
        n = lambda *s: r.normal(size=s).astype(np.float32) * 0.3
        p = {"word": n(len(vocabulary) + 1, EMBED), "tri": n(TRIGRAMS, EMBED), "pre": n(TRIGRAMS, EMBED)}
        for d in "fb":
            p |= {f"W{d}": n(3 * EMBED, 3 * STATE), f"U{d}": n(STATE, 3 * STATE), f"b{d}": np.zeros(3 * STATE, np.float32)}
        p |= {"A": n(2 * STATE, STATE), "v": n(STATE), "o": n(2 * STATE), "c": np.full(1, -1.0, np.float32)}
        return cls({w: i + 1 for i, w in enumerate(vocabulary)}, p)

    def inputs(self, words: list[bytes]) -> np.ndarray:
        """Input vectors of distinct plain words."""
        rows, starts = trigram_rows(words)
        chars = np.add.reduceat(self.p["tri"][rows], starts) / np.diff(np.append(starts, len(rows)))[:, None]
        start = self.p["pre"][prefix_rows(words)].mean(axis=1)
        return np.hstack([self.p["word"][[self.words.get(w, 0) for w in words]], chars, start]).astype(np.float32)

    def states(self, gates: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """gates (steps, batch, 3 STATE): input parts; returns states (steps, batch, STATE), in order of
        the words for both directions."""
        u, steps = self.p[f"U{d}"], range(len(gates))
        h, out = np.zeros((gates.shape[1], STATE), np.float32), np.empty((*gates.shape[:2], STATE), np.float32)
        for t in steps if d == "f" else reversed(steps):
            a = h @ u
            zr = _sigmoid(gates[t, :, : 2 * STATE] + a[:, : 2 * STATE])
            z, r = zr[:, :STATE], zr[:, STATE:]
            n = np.tanh(gates[t, :, 2 * STATE :] + r * a[:, 2 * STATE :])
            if keep is not None:
                keep.append((t, h, z, r, n, a[:, 2 * STATE :]))
            h = n + z * (h - n)
            out[t] = h
        return out

    def pooled(self, h: np.ndarray, mask: np.ndarray):
        k = np.tanh(h @ self.p["A"])
        e = np.where(mask, k @ self.p["v"], -1e9)
        w = np.exp(e - e.max(axis=0))
        w /= w.sum(axis=0)
        return k, w, (w[:, :, None] * h).sum(axis=0)

    def score(self, gates_f: np.ndarray, gates_b: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Probability for each window; gates (steps, batch, 3 STATE), mask (steps, batch)."""
        h = np.concatenate([self.states(gates_f, "f"), self.states(gates_b, "b")], axis=2)
        return _sigmoid(self.pooled(h, mask)[2] @ self.p["o"] + self.p["c"])

    def gradient(self, at: np.ndarray, rows: list[np.ndarray], mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean log loss. at (steps, batch): index of each distinct word; rows: for these, word
        rows, trigram rows, their starts, and prefix rows."""
        p, (word, tri, starts, pre) = self.p, rows
        size = np.diff(np.append(starts, len(tri)))
        x_of = np.hstack([p["word"][word], np.add.reduceat(p["tri"][tri], starts) / size[:, None], p["pre"][pre].mean(axis=1)]).astype(np.float32)
        x, keep = x_of[at], {"f": [], "b": []}
        live = mask[:, :, None]
        h = np.concatenate([self.states((x @ p[f"W{d}"] + p[f"b{d}"]) * live, d, keep[d]) for d in "fb"], axis=2)
        k, w, s = self.pooled(h, mask)
        g = {n: np.zeros_like(v) for n, v in p.items()}
        dz = ((_sigmoid(s @ p["o"] + p["c"]) - y) / len(y)).astype(np.float32)
        g["o"], g["c"] = s.T @ dz, dz.sum(keepdims=True)
        ds = dz[:, None] * p["o"]
        dh = w[:, :, None] * ds
        dw = (h * ds).sum(axis=2)
        de = w * (dw - (w * dw).sum(axis=0))
        g["v"] = (de[:, :, None] * k).sum(axis=(0, 1))
        dk = de[:, :, None] * p["v"] * (1 - k * k)
        g["A"] = np.einsum("tbi,tbj->ij", h, dk)
        dh += dk @ p["A"].T
        dx = np.zeros_like(x)
        for d, part in (("f", slice(0, STATE)), ("b", slice(STATE, None))):
            carry, u = np.zeros_like(dh[0, :, part]), p[f"U{d}"]
            for t, h0, z, r, n, a in reversed(keep[d]):
                dt = dh[t, :, part] + carry
                dn = dt * (1 - z) * (1 - n * n)
                da = np.hstack([dt * (h0 - n) * z * (1 - z), dn * a * r * (1 - r), dn])
                dg = da * live[t]
                into = np.hstack([da[:, : 2 * STATE], dn * r])
                g[f"U{d}"] += h0.T @ into
                carry = dt * z + into @ u.T
                g[f"W{d}"] += x[t].T @ dg
                g[f"b{d}"] += dg.sum(axis=0)
                dx[t] += dg @ p[f"W{d}"].T
        each = np.zeros_like(x_of)
        np.add.at(each, at.ravel(), dx.reshape(-1, 3 * EMBED))
        np.add.at(g["word"], word, each[:, :EMBED])
        np.add.at(g["tri"], tri, np.repeat(each[:, EMBED : 2 * EMBED] / size[:, None], size, axis=0))
        np.add.at(g["pre"], pre, each[:, None, 2 * EMBED :] / 4)
        return g


class Scorer:
    """Scores whole texts. Remembers the input parts of at most `most` words."""

    def __init__(self, net: Network, most: int = 250_000):
        self.net, self.most = net, most
        self.row: dict[bytes, int] = {}
        self.gates = np.zeros((1024, 6 * STATE), np.float32)

    def _rows(self, words: list[bytes]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self.row]
        if len(self.row) + len(new) > self.most and self.row:
            self.row, new = {}, list(dict.fromkeys(words))
        if new:
            at = len(self.row)
            while at + len(new) > len(self.gates):
                self.gates = np.concatenate([self.gates, np.zeros_like(self.gates)])
            for k in range(0, len(new), 50_000):
                x = self.net.inputs([plain(w) for w in new[k : k + 50_000]])
                for i, d in enumerate("fb"):
                    self.gates[at + k : at + k + len(x), i * 3 * STATE : (i + 1) * 3 * STATE] = x @ self.net.p[f"W{d}"] + self.net.p[f"b{d}"]
            self.row.update(zip(new, range(at, at + len(new))))
        return np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))

    def windows(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of all windows, and the text that each belongs to."""
        words = [steps(t) for t in texts]
        rows = self._rows([w for ws in words for w in ws])
        first, who, end, at = [], [], [], 0
        for i, ws in enumerate(words):
            s = windows(len(ws))
            first.append(at + s)
            who.append(np.full(len(s), i))
            at += len(ws)
            end.append(np.full(len(s), at))
        first, who, end = map(np.concatenate, (first, who, end))
        out = np.empty(len(first))
        for k in range(0, len(first), 4096):
            place = first[k : k + 4096] + np.arange(WINDOW)[:, None]
            mask = place < end[k : k + 4096]
            g = self.gates[rows[np.minimum(place, max(0, len(rows) - 1))]] * mask[:, :, None]
            out[k : k + 4096] = self.net.score(g[:, :, : 3 * STATE], g[:, :, 3 * STATE :], mask)
        return out, who

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        """Each text's score: the largest of its windows'; 0 without words."""
        out = np.zeros(len(texts))
        score, who = self.windows(texts)
        np.maximum.at(out, who, score)
        return out


def train(texts: list[bytes], toxic: list[int], seed: int = 0, rounds: int = 3, epochs: int = 5, known_words: int = 20_000, windows_each: int = 3) -> Network:
    """Fit the network on whole labelled texts. A label says that some window of the text is toxic, not which: the
    first round takes from each toxic text the window with the word that is most typical of toxic
    texts, later rounds the window that scores highest (texts whose best stays low count as
    mislabelled); other windows come from the rest, random ones and those that score highest.

    known_words: words that get an embedding of their own (those in most texts); windows_each: further windows of a toxic
    text, and random ones of any other, that a round trains on. Both bound the training only. Without a text nothing is learnt: every
    text with words then scores alike, below the bound of TOXIC."""
    rng = np.random.default_rng(seed)
    if not texts:
        net = Network.new([], seed)
        net.p["o"][:] = 0
        return net
    words = [[plain(w) for w in steps(t)] for t in texts]
    y = np.array(toxic, int)
    df = [{}, {}]
    for ws, label in zip(words, y):
        for w in set(ws):
            df[label][w] = df[label].get(w, 0) + 1
    n = np.bincount(y, minlength=2) + 1
    vocabulary = sorted((w for w in {*df[0], *df[1]} if df[0].get(w, 0) + df[1].get(w, 0) >= 3), key=lambda w: (-df[0].get(w, 0) - df[1].get(w, 0), w))[:known_words]
    typical = {w: c / n[1] / ((df[0].get(w, 0) + 0.5) / n[0]) for w, c in df[1].items() if c >= 3}
    net = Network.new(vocabulary, seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for round_ in range(rounds):
        chosen: list[tuple[list[bytes], int]] = []
        if round_:
            score, who = Scorer(net).windows(texts)
        for i, ws in enumerate(words):
            starts = windows(len(ws))
            if not len(starts):
                continue
            own = score[who == i] if round_ else np.array([max((typical.get(w, 0) for w in ws[s : s + WINDOW]), default=0) for s in starts])
            best = int(own.argmax())
            if y[i]:
                if own[best] >= (0.3 if round_ else 4):
                    near = [best, *np.flatnonzero(own >= (0.8 if round_ else 4))[:windows_each]]
                    chosen += [(ws[starts[k] : starts[k] + WINDOW], 1) for k in set(near)]
            else:
                some = {*rng.integers(0, len(starts), windows_each).tolist(), *([best] if round_ else [])}
                chosen += [(ws[starts[k] : starts[k] + WINDOW], 0) for k in sorted(some)]
        for _ in range(epochs):
            order = rng.permutation(len(chosen))
            for k in range(0, len(order), 96):
                part = [chosen[i] for i in order[k : k + 96]]
                # a random cut, so that the place and the length of a window say nothing
                cut = [(w[: max(1, int(rng.integers(len(w) // 2, len(w) + 1)))] if not label else w, label) for w, label in part]
                known: dict[bytes, int] = {}
                at = np.zeros((WINDOW, len(cut)), np.int64)
                mask = np.zeros((WINDOW, len(cut)), bool)
                for j, (ws, _) in enumerate(cut):
                    at[: len(ws), j] = [known.setdefault(w, len(known)) for w in ws]
                    mask[: len(ws), j] = True
                rows = [np.array([net.words.get(w, 0) if rng.random() > 0.3 else 0 for w in known]), *trigram_rows(list(known)), prefix_rows(list(known))]
                g = net.gradient(at, rows, mask, np.array([label for _, label in cut]))
                step += 1
                for name, value in net.p.items():
                    m[name] += 0.1 * (g[name] - m[name])
                    v2[name] += 0.01 * (g[name] ** 2 - v2[name])
                    value -= 0.01 * (m[name] / (1 - 0.9**step)) / (np.sqrt(v2[name] / (1 - 0.99**step)) + 1e-6)
    return net


def fit(docs: DataFrame, labels: DataFrame, positive: int = 1_000, negative: int = 2_000, longest: int = 200_000, most_bytes: int = 64 << 20) -> Network:
    """Train on a bounded sample of labelled documents: about `positive` toxic and `negative` other ones
    (all, if there are fewer), of at most `longest` characters, chosen by a hash of doc_id. The chosen rows are written; of these as many come
    to the driver, in the order of a hash, as have `most_bytes` of text together. Held-out rows are never read. Rows without a
    doc_id or label, and doc_ids with both labels, don't train; only text and label are inputs. A label that is repeated counts
    once; a doc_id with several texts trains with each. Empty tables are no error (see `train`)."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other")
    known = written(known.select("doc_id", "toxic", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("h")))
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = {k: int(min(1.0, most / max(1, n.get(k, 0))) * (1 << 30)) for k, most in ((1, positive), (0, negative))}
    ids = known.where((F.col("toxic") == 1) & (F.col("h") < share[1]) | (F.col("toxic") == 0) & (F.col("h") < share[0])).orderBy("h", "doc_id").limit(2 * (positive + negative))
    short = docs.select("doc_id", "text").where(F.coalesce(F.length("text") <= longest, F.lit(True)))
    chosen = short.join(F.broadcast(ids.select("doc_id", "toxic")), "doc_id").orderBy(F.xxhash64("doc_id", "text"), "doc_id").limit(3 * (positive + negative))
    chosen = written(chosen.withColumn("at", F.monotonically_increasing_id()))
    # four numbers of each of these bounded rows, so one window over all of them is small
    sizes = chosen.select("at", "doc_id", F.xxhash64("doc_id", "text").alias("h"), F.octet_length(F.coalesce("text", F.lit(""))).alias("size"))
    fits = sizes.withColumn("upto", F.sum("size").over(Window.orderBy("h", "doc_id", "at"))).where(F.col("upto") <= most_bytes).select("at")
    rows = chosen.join(F.broadcast(fits), "at", "left_semi").collect()
    rows = sorted(((r["doc_id"], r["text"] or "", r["toxic"]) for r in rows))
    return train([t.encode() for _, t, _ in rows], [y for _, _, y in rows])


def held_out(doc_id) -> F.Column:
    """True for rows that never train: crc32 of the doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score(docs: DataFrame, net: Network) -> DataFrame:
    """`docs` with toxicity_score and predicted (1 from a score of 0.7), each from its whole text.

    A null or blank text scores 0. Texts of any length are scored, in all their overlapping windows, and words of
    any length are read to their end (in pieces, see `steps`). Columns of
    these names are replaced; an empty table gives no rows."""
    names = [c for c in docs.columns if c not in ("toxicity_score", "predicted")]
    sent, at = docs.sparkSession.sparkContext.broadcast(net), names.index("text")

    def run(batches):
        scorer = Scorer(sent.value)
        for part in slices(batches, 128):
            s = scorer([t or b"" for t in part.column(at).cast(pa.binary()).to_pylist()])
            yield pa.record_batch([*part.columns, pa.array(s), pa.array((s >= TOXIC).astype(np.int32))], names=[*names, "toxicity_score", "predicted"])

    rows = docs.select(*names).withColumn("text", F.col("text").cast("string"))
    return rows.mapInArrow(run, T.StructType([*rows.schema, T.StructField("toxicity_score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity_score").alias("score"), "predicted")
