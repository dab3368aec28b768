"""Language identification, words first, then shorter and shorter character n-grams.

A known word adds its log frequency in each language. An unseen word is read from left to
right: at each place the longest known character n-gram (LONGEST down to 1) adds its log
frequencies. The model is fitted on a bounded sample, FIT_DOCS whole documents per
language (the smallest by a hash of the id), so it has a bounded size and is broadcast;
every whole text is scored.

Defined cases: null texts and texts without letters are ``und`` with score 0; null languages
teach nothing; if nothing can be learned all texts are ``und``. Of equal languages the first by
name wins. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxtally.llm.common import broadcast_if_small, crc_mod
from boxtally.session import cut_lineage

FIT_DOCS = 1000
#: Ranges in which the draws of a language are counted.
SAMPLE_PARTS = 4096
#: Rows of ids or languages up to which they are broadcast.
MOST_NARROW = 200_000
LONGEST = 5
_LETTERS = re.compile(r"[^\W\d_]+")
_REMEMBER = 200_000
#: Longer words are split into pieces of this length, so one endless word costs no more than many.
_PIECE = 40


def words_of(text: str | None) -> list[str]:
    # The pattern takes numerals that are no digits (², ½, ①) as well; alone they are no word.
    found = [w for w in _LETTERS.findall((text or "").lower()) if w.isalpha() or any(map(str.isalpha, w))]
    if any(len(w) > _PIECE for w in found):
        found = [w[i:i + _PIECE] for w in found for i in range(0, len(w), _PIECE)]
    return found


class Model:
    """Log frequencies per language of words and of n-grams of each length."""

    def __init__(self, langs: list[str], counts: list[Counter]) -> None:
        self.langs = langs
        vocabulary = sorted(set().union(*counts)) if counts else []
        self.word_at = {w: i for i, w in enumerate(vocabulary)}
        self.word_log = self._logs([[c[w] for w in vocabulary] for c in counts])
        self.gram_log: dict[str, np.ndarray] = {}
        for n in range(1, LONGEST + 1):
            grams = [Counter() for _ in counts]
            for g, c in zip(grams, counts):
                for w, k in c.items():
                    padded = f" {w} "
                    for i in range(len(padded) - n + 1):
                        g[padded[i:i + n]] += k
            known = sorted(set().union(*grams)) if grams else []
            logs = self._logs([[g[x] for x in known] for g in grams])
            self.gram_log.update(zip(known, logs))

    @staticmethod
    def _logs(rows: list[list[int]]) -> np.ndarray:
        if not rows or not rows[0]:
            return np.zeros((0, len(rows)))
        c = np.array(rows, float).T + 0.5
        return np.log(c / c.sum(axis=0))

    def backoff(self, word: str) -> np.ndarray:
        padded, i, out = f" {word} ", 0, np.zeros(len(self.langs))
        while i < len(padded):
            for n in range(LONGEST, 0, -1):
                logs = self.gram_log.get(padded[i:i + n])
                if logs is not None and i + n <= len(padded):
                    out += logs
                    i += n
                    break
            else:
                i += 1
        return out


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.at = dict(model.word_at)
        self.logs = np.array(model.word_log, copy=True)
        self.n = len(self.at)

    def _learned(self, word: str) -> int:
        if self.n == len(self.logs):
            self.logs = np.vstack([self.logs, np.zeros((max(1024, self.n // 2), len(self.model.langs)))])
        self.logs[self.n] = self.model.backoff(word)
        self.at[word] = self.n
        self.n += 1
        return self.n - 1

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.model.langs:
            return "und", 0.0
        if self.n > len(self.model.word_at) + _REMEMBER:
            self.at, self.n = dict(self.model.word_at), len(self.model.word_at)
        get = self.at.get
        ids = [i if (i := get(w)) is not None else self._learned(w) for w in words]
        total = self.logs[ids].sum(axis=0)
        p = np.exp(total - total.max())
        best = int(np.argmax(p))
        return self.model.langs[best], float(p[best] / p.sum())


def sample_ids(taught: DataFrame, most: int, parts: int = SAMPLE_PARTS) -> DataFrame:
    """``id2, lang2`` of the ``most`` documents of each language with the smallest draws.

    Draws are counted in ``parts`` equal ranges first, so only rows of the first ranges, about ``most`` and
    one range more, are ranked together.
    """
    span = 2**64 // parts
    drawn = taught.select("doc_id", "lang", F.xxhash64("doc_id", F.length("text")).alias("draw"))
    drawn = drawn.withColumn("range", F.floor(F.col("draw") / F.lit(span)))
    sizes = drawn.groupBy("lang", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    wanted = (sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
              .where(F.col("before") < most).groupBy("lang").agg(F.max("range").alias("last")))
    order = Window.partitionBy("lang").orderBy("draw", "doc_id")
    near = drawn.join(broadcast_if_small(wanted, MOST_NARROW), "lang").where("range <= last")
    return (near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
            .select(F.col("doc_id").alias("id2"), F.col("lang").alias("lang2")).distinct())


def fit(docs: DataFrame, most: int = FIT_DOCS) -> Model:
    """Word counts of at most ``most`` training documents per language, counted in Spark."""
    taught = docs.where("lang is not null").where(crc_mod(F.col("doc_id"), 5) != 0)
    chosen = broadcast_if_small(cut_lineage(sample_ids(taught, most)), MOST_NARROW)
    texts = taught.select("doc_id", "lang", "text").join(
        chosen, F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("lang") == F.col("lang2"))).select("lang", "text")

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            found: Counter = Counter()
            for lang, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                found.update((lang, w) for w in words_of(t))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()),
                 pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])

    rows = (texts.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word")
            .agg(F.sum("n").alias("n")).toArrow())
    langs = sorted(set(rows["lang"].to_pylist()))
    counts = {x: Counter() for x in langs}
    for lang, word, n in zip(rows["lang"].to_pylist(), rows["word"].to_pylist(), rows["n"].to_pylist()):
        counts[lang][word] = n
    return Model(langs, [counts[x] for x in langs])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` per document row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scores(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in source:
            out = [scorer(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array([x[0] for x in out], pa.string()),
                 pa.array([x[1] for x in out], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    held = crc_mod(F.col("doc_id"), 5) == 0
    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(
        scores, f"doc_id {id_type}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, fit(docs))
