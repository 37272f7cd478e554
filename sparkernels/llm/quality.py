"""A document quality classifier: logistic regression over hashed word n-grams, trained by FTRL-proximal updates."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encoded, prepare, text_key, tidied

#: Hash buckets of the model.
BUCKETS = 1 << 18
#: At most this many labelled documents are fitted, chosen by a hash of doc_id, and no more of them once so many bytes of
#: text were: the documented bounds of the sample. No text is cut.
TRAIN_ROWS, TRAIN_BYTES = 8192, 64 << 20
THRESHOLD = 0.3
FOLDS = 5
#: Tokens of a text that are turned into features at once, and cached tokens in a worker.
BLOCK, CACHED = 1 << 16, 1 << 16

TOKEN = re.compile(r"\w+|[^\w\s]+")
_U64 = np.uint64


def shape(token: str) -> str:
    """The written form of a token: marks as they stand (3 at most), words by their case, numbers as one."""
    if not (token[0].isalnum() or token[0] == "_"):
        return token[:3]
    if token.isdigit():
        return "9"
    if token.isupper():
        return "A" if len(token) == 1 else "AA"
    return "a" if token.islower() else "Aa" if token.istitle() else "aA"


class _Hashes(dict):
    """Token to a hash, computed once; forgets all when it has grown to its bound."""

    def __init__(self, of) -> None:
        super().__init__()
        self.of = of

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHED:
            self.clear()
        self[token] = value = xxhash.xxh64_intdigest(self.of(token).encode("utf-8", "surrogatepass"))
        return value


_words, _shapes = _Hashes(str.lower), _Hashes(shape)


def _forget() -> None:
    _words.clear()
    _shapes.clear()


_SAME = _U64(xxhash.xxh64_intdigest(b"the same token again"))
_A, _B, _C = _U64(0x9E3779B97F4A7C15), _U64(0xC2B2AE3D27D4EB4F), _U64(0x165667B19E3779F9)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U64(31))) * _A
    return ((h ^ (h >> _U64(29))) & _U64(BUCKETS - 1)).astype(np.int64)


#: Tokens before a block that its n-grams reach: two, and one more that tells whether the first of them repeats it.
REACH = 3


def blocks(tokens: list[str]) -> Iterator[list[np.ndarray]]:
    """The features of all tokens, block by block; n-grams across a boundary belong to the block in which they end."""
    for i in range(0, len(tokens), BLOCK):
        before = min(i, REACH)
        yield [x[max(0, before - k) :] for x, k in zip(features(tokens[i - before : i + BLOCK]), (0, 1, 0, 1, 2), strict=True)]


def features(tokens: list[str]) -> list[np.ndarray]:
    """Buckets of the word 1- and 2-grams and of the 1-, 2- and 3-grams of the words' written forms."""
    n = len(tokens)
    w = np.fromiter(map(_words.__getitem__, tokens), _U64, n)
    s = np.fromiter(map(_shapes.__getitem__, tokens), _U64, n)
    s[1:][w[1:] == w[:-1]] = _SAME
    return [_bucket(x) for x in (w, w[:-1] * _B + w[1:], s * _C, (s[:-1] * _B + s[1:]) * _C, ((s[:-2] * _B + s[1:-1]) * _B + s[2:]) * _C)]


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # float32, BUCKETS
    bias: float

    def score(self, text: bytes) -> float:
        """The probability of label 1: a sparse dot product with each n-gram order's frequencies; empty texts get the bias."""
        total, count, tokens = np.zeros(5), np.zeros(5), TOKEN.findall(text.decode("utf-8", "replace"))
        for block in blocks(tokens):
            for k, idx in enumerate(block):
                total[k] += self.weights[idx].sum(dtype=np.float64)
                count[k] += len(idx)
        z = self.bias + float((total / np.maximum(count, 1)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


class Ftrl:
    """Follow the regularised leader, proximal: per-coordinate rates with L1 and L2 penalties."""

    def __init__(self, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, text: bytes, label: int) -> None:
        tokens = TOKEN.findall(text.decode("utf-8", "replace"))
        parts = list(blocks(tokens))
        idx, val = [np.array([BUCKETS])], [np.array([1.0])]
        for order in zip(*parts, strict=True):
            joined = np.concatenate(order)
            idx.append(joined)
            val.append(np.full(len(joined), 1 / max(1, len(joined))))
        at, where = np.unique(np.concatenate(idx), return_inverse=True)
        x = np.bincount(where, np.concatenate(val))
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip((w * x).sum(), -500, 500))) - label) * x
        root = np.sqrt(self.n[at])
        step = (np.sqrt(self.n[at] + g * g) - root) / self.alpha
        self.z[at] += g - step * w
        self.n[at] += g * g

    def model(self) -> Model:
        w = self.weights(slice(None))
        return Model(w[:-1].astype(np.float32), float(w[-1]))


def fit_rows(rows: Iterable[tuple[bytes, int]], most: int = TRAIN_BYTES) -> Model:
    """One pass over the examples, one at a time, until `most` bytes of text have been learnt."""
    learner, seen = Ftrl(alpha=16.0), 0
    for text, label in rows:
        if seen >= most:
            break
        learner.learn(text, label)
        seen += len(text)
    return learner.model()


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = fit_rows(row for batch in batches for row in zip(encoded(batch.column(0)), batch.column(1).to_pylist(), strict=True))
    yield pa.RecordBatch.from_arrays([pa.array([model.weights.astype("<f4").tobytes()]), pa.array([model.bias])], ["weights", "bias"])


def fold():
    """crc32 of doc_id as text, modulo 5; fold 0 is held out. Null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most `rows` labelled documents outside fold 0, in the order of a hash of doc_id.

    Labels with a null doc_id or quality are left out; of several labels of one doc_id the smallest counts, and of
    several texts of one doc_id the one of the least hash. Without any example the model is empty and scores 0.5.
    """
    prepare(docs.sparkSession)
    chosen = labels.where("doc_id is not null and quality is not null").where(fold() != 0).groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # The sample has at most `rows` narrow rows, so this broadcast is bounded; copies combine before the shuffle.
    examples = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    examples = examples.groupBy("doc_id").agg(F.min_by("text", text_key()).alias("text"), F.min("quality").cast("int").alias("label"))
    found = examples.withColumn("h", F.xxhash64("doc_id")).repartition(1).sortWithinPartitions("h", "doc_id").select("text", "label").mapInArrow(tidied(_fit, _forget), "weights binary, bias double").first()
    if found is None:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    return Model(np.frombuffer(found.weights, "<f4"), found.bias)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row of docs; null texts are empty."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(text) for text in encoded(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidied(run, _forget), "doc_id long, score double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out (fold 0; false for a null doc_id), score, predicted (1 if score >= 0.3)."""
    out = scored(docs, train(docs, labels))
    return out.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that the classifier does not reject."""
    model = train(docs, labels)
    at = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.score(text) >= THRESHOLD for text in encoded(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(tidied(kept, _forget), docs.schema)
