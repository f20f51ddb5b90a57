"""Quality classifier: heuristic labellers, their accuracies by EM, and a hashed linear scorer."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featsel.llm.common import slices, table, written

# Frequent function words of the corpus languages.
STOP_WORDS = frozenset(
    b"""a an and are as at be by for from have he in is it not of on or that the this to was what with
    au aux avec dans de des du elle en est et il la le les ne par pas pour que qui sur un une
    als auch auf das dem den der des die ein eine er es im in ist mit nicht sich sie und von zu
    al con del el en es la las lo los no para por que se su un una y""".split()
)

#: Hashed dimensions of the linear scorer.
DIMS = 1 << 16
#: Rows are kept from this score on.
KEEP = 0.5

# The classes of a byte: letter, upper-case letter, digit, blank, plain punctuation, other symbol.
_KIND = np.full(256, 5, np.uint8)
_KIND[[b for b in range(256) if chr(b).islower() or b >= 128]] = 0
_KIND[[b for b in range(128) if chr(b).isupper()]] = 1
_KIND[list(b"0123456789")] = 2
_KIND[list(b" \t\n\r\x0b\x0c")] = 3
_KIND[list(b".,;:'\"!?()-")] = 4


def measures(text: bytes) -> tuple[float, ...]:
    """What the labellers look at: number of words; shares of capitals among letters, of symbols
    among what isn't blank, of function words, of distinct words, of words without a letter or digit,
    of words that equal the one before; letters and digits a word."""
    words = text.split()
    n = len(words)
    if not n:
        return (0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=6)
    letters = kinds[0] + kinds[1]
    low = text.lower().split()
    plain = [w.strip(b".,;:'\"!?()-") for w in low]
    return (
        n,
        kinds[1] / max(1, letters),
        kinds[5] / max(1, len(text) - kinds[3]),
        sum(map(STOP_WORDS.__contains__, plain)) / n,
        len(set(low)) / n,
        sum(not w.strip(b"|*&%$#@~^=+<>/\\_[]{}`") for w in plain) / n,
        sum(map(bytes.__eq__, low, low[1:])) / max(1, n - 1),
        (letters + kinds[2]) / n,
    )


def votes(m: tuple[float, ...]) -> list[int]:
    """One vote of each labeller: 1 good, 0 bad, 2 no opinion. Seven look for one kind of junk each
    and are silent otherwise; the last knows plain prose."""
    n, upper, symbols, stops, distinct, bare, echo, letters = m
    bad = [
        upper > 0.2 and n >= 10 or upper > 0.6 and n * letters >= 4,
        symbols > 0.04,
        n >= 30 and stops < 0.02,
        n >= 40 and distinct < 0.15,
        bare > 0.15,
        n >= 5 and echo > 0.2,
        not 1.5 <= letters <= 20,
    ]
    plain = symbols < 0.02 and bare < 0.03 and echo < 0.1 and 1.5 <= letters <= 20
    prose = plain and upper < 0.15 and (stops > 0.03 or n < 30) or plain and n < 10 and upper < 0.5
    return [0 if x else 2 for x in bad] + [1 if prose else 2]


LABELLERS = 8


def vote_patterns(docs: DataFrame) -> DataFrame:
    """Number of documents with each pattern of votes (a base-3 number): 3^8 rows at most."""

    def run(batches):
        weight = 3 ** np.arange(LABELLERS)
        for batch in slices(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            yield pa.record_batch([pa.array([int(weight @ votes(measures(t or b""))) for t in texts], pa.int32())], names=["pattern"])

    return docs.select("text").mapInArrow(run, "pattern int").groupBy("pattern").count()


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, steps: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Fit how the labellers vote on good and on bad documents, and the share of good ones.

    patterns: (rows, labellers) of 0 bad, 1 good, 2 no opinion; counts: documents with each.
    Returns the posterior of good for each pattern, each labeller's accuracy where it votes, and the
    share. Starts from votes that are mostly right, which fixes which class is the good one; counts are
    smoothed, so that no labeller is ever taken as infallible."""
    n = len(patterns[0]) if len(patterns) else LABELLERS
    one = np.stack([patterns == v for v in range(3)], axis=2).astype(float)
    good = np.tile([0.05, 0.45, 0.5], (n, 1))
    bad = np.tile([0.4, 0.1, 0.5], (n, 1))
    share, post = 0.8, np.zeros(len(patterns))
    for _ in range(steps):
        log = np.log(share / (1 - share)) + (one * (np.log(good) - np.log(bad))).sum(axis=(1, 2))
        new = 1 / (1 + np.exp(-np.clip(log, -50, 50)))
        done, post = np.abs(new - post).max(initial=0) < 1e-9, new
        if done:
            break
        w, v = counts * post, counts * (1 - post)
        good = ((one * w[:, None, None]).sum(0) + 1) / (w.sum() + 3)
        bad = ((one * v[:, None, None]).sum(0) + 1) / (v.sum() + 3)
        share = (w.sum() + 1) / (counts.sum() + 2)
    right = share * good[:, 1] + (1 - share) * bad[:, 0]
    voted = share * (good[:, 0] + good[:, 1]) + (1 - share) * (bad[:, 0] + bad[:, 1])
    return post, right / voted, float(share)


# What stands for a byte in a word's shape: a letter, A, digit or blank for its class, any other byte for itself.
_SHAPE = bytes((97, 65, 48, 32, b, b)[k] for b, k in enumerate(_KIND.tolist()))
_AGAIN = re.compile(rb"(.)\1+", re.DOTALL)


def _shape(word: bytes) -> bytes:
    """Runs of letters become a, A or Aa, digits 0; symbols stay, each once in a row."""
    return _AGAIN.sub(rb"\1", word.translate(_SHAPE))


class Remembered(dict):
    """Word -> what `of` finds for it, read in full. Holds at most `most` words, of 64 bytes each at the most (some 40 MB)."""

    def __init__(self, of, most: int = 200_000):
        self.of, self.most = of, most

    def __missing__(self, word: bytes):
        found = self.of(word)
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = found
        return found


def dimensions(word: bytes) -> tuple[int, int, int]:
    """A word's hashed dimensions: the word itself, its shape and its last three bytes."""
    low, digest = word.lower(), xxhash.xxh3_64_intdigest
    return digest(b"w" + low) % DIMS, digest(b"s" + _shape(word)) % DIMS, digest(b"e" + low[-3:]) % DIMS


def extras(words: list[bytes]) -> tuple[tuple[int, float], ...]:
    """Dimensions of the text as a whole: bias, shares of repeats and of echoes."""
    n = len(words)
    repeats = 1 - len(set(words)) / n if n else 0.0
    echo = sum(map(bytes.__eq__, words, words[1:])) / n if n else 0.0
    return ((DIMS, 1.0), (DIMS + 1, repeats), (DIMS + 2, echo), (DIMS + 3, repeats**4))


def vector(text: bytes, hashed: dict) -> tuple[np.ndarray, np.ndarray]:
    """Dimensions and values: each word's dimensions by their share of the words, and the extras."""
    words = text.split()
    at, n = np.unique(np.array(list(map(hashed.__getitem__, words)), np.int32).ravel(), return_counts=True)
    more = extras(words)
    return np.concatenate([at, [i for i, _ in more]]).astype(np.int32), np.concatenate([n / max(1, len(words)), [x for _, x in more]])


@dataclass
class Model:
    """Weights of the linear scorer, and what EM found about the labellers."""

    weights: np.ndarray
    accuracies: np.ndarray
    good_share: float


def _training_rows(docs: DataFrame, total: int, sample: int) -> list:
    """(vote pattern, features at, values x) of about `sample` documents of smallest hash of (doc_id, text): hashes under
    the share that is wanted, and of these at most 2 `sample` in order of hash (rows that repeat share one). Only features
    move, as the bytes of their arrays."""

    def run(batches):
        weight, hashed = 3 ** np.arange(LABELLERS), Remembered(dimensions, 20_000)
        for batch in slices(batches):
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            p = pa.array([int(weight @ votes(measures(t))) for t in texts], pa.int64())
            at, x = zip(*(vector(t, hashed) for t in texts))
            data = (pa.array([v.astype(kind).tobytes() for v in vs], pa.binary()) for vs, kind in ((at, np.int32), (x, np.float32)))
            yield pa.record_batch([batch.column("h"), p, *data], names=["h", "p", "at", "x"])

    hashes = docs.select(F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1).alias("h"), "text")  # 63 bits
    chosen = hashes.where(F.col("h") <= F.lit(sample * 2**63 // max(1, total) - 1)) if total > sample else hashes
    rows = chosen.mapInArrow(run, "h long, p long, at binary, x binary").orderBy("h").limit(2 * sample).drop("h").collect()
    return sorted((p, bytes(at), bytes(x)) for p, at, x in rows)


def fit(docs: DataFrame, sample: int = 6_000, epochs: int = 30, seed: int = 5) -> Model:
    """Weak labels from all documents, then the scorer from a bounded sample of them.

    1. Every document's votes, counted by pattern over the whole corpus.
    2. EM on the counts gives each pattern's posterior.
    3. About `sample` documents (this bounds what reaches the driver; all documents, if there are
       fewer), chosen by a hash of doc_id and text, train a logistic model on hashed features
       against the posteriors, by Adam with an L2 penalty. No human label is read."""
    seen = written(vote_patterns(docs)).orderBy("pattern").toPandas()
    digits = (seen["pattern"].to_numpy()[:, None] // 3 ** np.arange(LABELLERS)) % 3
    post, accuracies, share = expectation_maximisation(digits, seen["count"].to_numpy(float))
    of = dict(zip(seen["pattern"].tolist(), post.tolist()))
    rows = _training_rows(docs, int(seen["count"].sum()), sample)
    weights = np.zeros(DIMS + 4)
    if rows:
        m, v, rng, t = np.zeros_like(weights), np.zeros_like(weights), np.random.default_rng(seed), 0
        data = [(np.frombuffer(at, np.int32), np.frombuffer(x, np.float32), of.get(p, share)) for p, at, x in rows]
        for _ in range(epochs):
            for part_ in np.array_split(rng.permutation(len(data)), max(1, len(data) // 64)):
                g = 1e-4 * weights
                for i in part_:
                    at, x, y = data[i]
                    p = 1 / (1 + np.exp(-np.clip(weights[at] @ x, -35, 35)))
                    np.add.at(g, at, (p - y) * x / len(part_))
                t += 1
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                weights -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(weights, accuracies, share)


def score(docs: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """`docs` with quality_score (0 to 1, higher is better) and kept (score >= keep), for every row
    from its whole text. Only the texts go to Python, and only scores come back."""
    sent = docs.sparkSession.sparkContext.broadcast(model.weights.astype(np.float64))

    @F.arrow_udf("double")
    def scores(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w = sent.value.tolist()

        def weigh(word: bytes) -> float:
            a, b, c = dimensions(word)
            return w[a] + w[b] + w[c]

        weight = Remembered(weigh)
        for batch in texts:
            out = []
            for part in slices([batch]):
                for text in part.cast(pa.binary()).to_pylist():
                    words = (text or b"").split()
                    z = sum(map(weight.__getitem__, words)) / max(1, len(words)) + sum(w[i] * x for i, x in extras(words))
                    out.append(1 / (1 + np.exp(-np.clip(z, -35, 35))) if words else 0.0)
            yield pa.array(out, pa.float64())

    rows = docs.select(*[c for c in docs.columns if c not in ("quality_score", "kept")]).withColumn("text", F.col("text").cast("string"))
    return rows.withColumn("quality_score", scores("text")).withColumn("kept", F.col("quality_score") >= F.lit(keep))


def classify(docs: DataFrame, sample: int = 6_000) -> DataFrame:
    """Fit on `docs` and score them: every row with quality_score and kept.

    A null or blank text has score 0. Nulls in other columns don't matter; repeated rows get equal scores; columns named
    quality_score or kept are replaced; an empty table gives no rows."""
    return score(docs, fit(docs, sample))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "quality_score", "kept")
