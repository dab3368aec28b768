"""Quality classifier: hashed word n-grams, logistic regression, FTRL-proximal updates.

Words are letter runs, digit runs and runs of other marks. Each n-gram of one to NGRAM words is
hashed to one of 2**BITS buckets, where a word that repeats the one before is marked as such; a document is the sparse vector of the log-scaled
frequencies, of length one. Training takes a bounded sample of labelled rows (the
TRAIN_ROWS smallest by a hash of the id), so the model has a fixed size and is broadcast;
scoring is one sparse dot product per document, over its whole text.

Defined cases: null and empty texts score by the bias; null labels are not learned from; a
document labelled several times is learned from once per label; with no labels every
score is 0.5. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxtally.llm.common import crc_mod

BITS = 18
NGRAM = 2
TRAIN_ROWS = 6000
EPOCHS = 4
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
_M = np.uint64(0x9E3779B97F4A7C15)
_DITTO = np.uint64(0x5851F42D4C957F2D)
#: Distinct words whose hash a task remembers at a time.
_REMEMBER = 200_000


class Vectors:
    """Turns texts into bucket numbers and values, remembering the hashes of words."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def _word(self, w: str) -> int:
        h = self.known.get(w)
        if h is None:
            if len(self.known) >= _REMEMBER:
                self.known.clear()
            raw = hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest()
            h = self.known[w] = int.from_bytes(raw, "little")
        return h

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = _TOKEN.findall(text or "")
        if not words:
            return np.zeros(0, np.int64), np.zeros(0)
        known = self.known
        try:
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            h = np.array([self._word(w) for w in words], np.uint64)
        with np.errstate(over="ignore"):
            parts, gram = [], h
            for n in range(1, NGRAM + 1):
                if n > 1:
                    if len(h) < n:
                        break
                    gram = (gram[:-1] * _M) ^ (h[n - 1:] >> np.uint64(n))
                    if n == 2:  # a word that follows itself is one n-gram, whatever the word
                        gram = np.where(h[1:] == h[:-1], _DITTO, gram)
                parts.append((gram * _M + np.uint64(n)) >> np.uint64(64 - BITS))
            # The same with one word between, as between full stops.
            parts.append(np.full(int((h[2:] == h[:-2]).sum()), _DITTO >> np.uint64(64 - BITS)))
        at, n = np.unique(np.concatenate(parts).astype(np.int64), return_counts=True)
        v = 1 + np.log(n)
        return at, v / np.sqrt((v * v).sum())


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def train_ftrl(rows: list[tuple[tuple[np.ndarray, np.ndarray], int]], epochs: int = EPOCHS, alpha: float = 1.0,
               beta: float = 1.0, l1: float = 0.02, l2: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and bias by follow-the-regularised-leader, one row at a time."""
    size = 2**BITS + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(i):
        w = -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(z[i]) <= l1, 0.0, w)

    for _ in range(epochs):
        for (at, v), y in rows:
            i, x = np.append(at, size - 1), np.append(v, 1.0)
            w = weights(i)
            g = (sigmoid(float(w @ x)) - y) * x
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - s * w
            n[i] += g * g
    w = weights(np.arange(size))
    return w[:-1].astype(np.float32), float(w[-1])


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """At most ``most`` labelled documents outside the held-out third: ``text, quality``."""
    marked = labels.where("quality is not null and doc_id is not null").select(
        F.col("doc_id").alias("labelled"), F.col("quality").cast("int").alias("quality"))
    marked = marked.where(crc_mod(F.col("labelled"), 3) != 1).withColumn("draw", F.xxhash64("labelled"))
    marked = marked.orderBy("draw", "labelled", "quality").limit(most)
    return (docs.select("doc_id", "text").join(marked, F.col("doc_id") == F.col("labelled"))
            .select("draw", "text", "quality"))


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """Train on the bounded sample, in one task; only the weights reach the driver.

    The vectors are made where the texts are and sent to that task instead of them.
    """
    def vectors(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vec = Vectors()
        for b in source:
            made = [vec(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("draw"), b.column("quality"), pa.array([a.astype(np.int32) for a, _ in made], pa.list_(pa.int32())),
                 pa.array([v.astype(np.float32) for _, v in made], pa.list_(pa.float32()))],
                ["draw", "quality", "at", "v"])

    def learned(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = [(draw, quality, np.asarray(at.values, np.int64), np.asarray(v.values, np.float64)) for b in source
                  for draw, quality, at, v in zip(b["draw"].to_pylist(), b["quality"].to_pylist(), b["at"], b["v"])]
        sample.sort(key=lambda r: (r[0], r[1], len(r[2])))
        w, bias = train_ftrl([((at, v), int(quality > 0)) for _, quality, at, v in sample])
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()]), pa.array([bias])], ["w", "bias"])

    sample = training_rows(docs, labels, most).mapInArrow(vectors, "draw long, quality int, at array<int>, v array<float>")
    row = sample.repartition(1).mapInArrow(learned, "w binary, bias double").first()
    # Without rows there may be no task either: then all weights are 0.
    return (np.zeros(2**BITS, np.float32), 0.0) if row is None else (np.frombuffer(row.w, np.float32), row.bias)


def _scorer(model: tuple[np.ndarray, float]) -> Callable[[pa.RecordBatch], list[float]]:
    """Scores of the texts of a batch."""
    w, bias = model
    vec = Vectors()

    def scores(batch: pa.RecordBatch) -> list[float]:
        return [sigmoid(float(w[at] @ v) + bias) for at, v in (vec(t.as_py()) for t in batch.column("text"))]

    return scores


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per document row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scores(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _scorer(sent.value)
        for b in source:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(of(b), pa.float64())],
                                             ["doc_id", "held_out", "score"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    held = crc_mod(F.col("doc_id"), 3) == 1
    return (docs.select("doc_id", held.alias("held_out"), "text")
            .mapInArrow(scores, f"doc_id {id_type}, held_out boolean, score double")
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The document rows predicted to be good, with their columns as they are, in one pass without a shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def good(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _scorer(sent.value)
        for b in source:
            yield b.filter(pa.array([x >= 0.5 for x in of(b)], pa.bool_()))

    return docs.mapInArrow(good, docs.schema)
