"""Token counts as rollups that are kept up by signed deltas.

Documents that come add their counts, documents that go subtract them, revised ones do both.
Each batch of changes is reduced to one delta per (source, lang, tokenizer version)
and committed under its batch id; totals are the last stored total (a fold) and the deltas committed since. A batch id that is
committed already is left alone, and a batch that died half-way has no success mark, is
not read and is written anew, so a replay never counts twice.

Counts are additive, so each task adds up its rows before the shuffle and a source with a third
of all rows is no heavier than others.

Defined cases: null text counts as empty; null source and null lang are groups of their own; totals that
return to zero documents stay listed with zeros; an empty batch commits nothing but its mark.
Extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
KEYS = ["source", "lang", "tokenizer"]
SUMS = ["docs", "tokens", "chars"]
_WORD = re.compile(r"[^\x20\x09-\x0D]+")

# Fixed value: the split pattern that the rank files were made with.
BPE_PATTERN = (r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")


def rank_encoder(path: str):
    """A tiktoken encoding over a rank file."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(t): int(n) for t, n in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})


def counters(folder: str = TOKENIZERS) -> dict[str, Callable[[], Callable[[str], int]]]:
    """Tokenizer versions: a name and what makes its counter inside a task."""
    def words():
        return lambda t: len(_WORD.findall(t))

    def bpe():
        enc = rank_encoder(f"{folder}/byte_bpe_50k.tiktoken")
        return lambda t: len(enc.encode_ordinary(t))

    return {"words-1": words, "byte-bpe-50k": bpe}


def deltas(changes: DataFrame, versions: dict[str, Callable] | None = None) -> DataFrame:
    """Signed sums of ``changes`` (``text, source, lang, sign``) per group and tokenizer version."""
    made = versions or counters()
    names = list(made)

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = [made[n]() for n in names]
        for b in source:
            texts = [t or "" for t in b.column("text").to_pylist()]
            for name, f in zip(names, use):
                yield pa.RecordBatch.from_arrays(
                    [b.column("source"), b.column("lang"), pa.array([name] * len(texts), pa.string()), b.column("sign"),
                     pa.array([f(t) for t in texts], pa.int64()), pa.array([len(t) for t in texts], pa.int64())],
                    ["source", "lang", "tokenizer", "sign", "tokens", "chars"])

    counted = changes.select("text", F.col("source").cast("string").alias("source"),
                             F.col("lang").cast("string").alias("lang"), F.col("sign").cast("long").alias("sign"))
    counted = counted.mapInArrow(count, "source string, lang string, tokenizer string, sign long, tokens long, chars long")
    return counted.groupBy(*KEYS).agg(
        F.sum("sign").alias("docs"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"),
        F.sum(F.col("sign") * F.col("chars")).alias("chars"))


def inserted(docs: DataFrame) -> DataFrame:
    return docs.select("text", "source", "lang", F.lit(1).alias("sign"))


def deleted(docs: DataFrame) -> DataFrame:
    return docs.select("text", "source", "lang", F.lit(-1).alias("sign"))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    return deleted(old).unionByName(inserted(new))


class Rollup:
    """Totals in a folder that all executors share."""

    SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long, chars long"

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def committed(self, batch_id: str) -> bool:
        fs, p = self._fs(f"{self.root}/batch={batch_id}/_SUCCESS")
        return fs.exists(p)

    def commit(self, batch_id: str, changes: DataFrame, versions: dict[str, Callable] | None = None) -> bool:
        """Add a batch of signed changes; False if this batch id is in already."""
        if not re.fullmatch(r"[\w.-]+", batch_id):
            raise ValueError(f"batch id {batch_id!r}")
        if self.committed(batch_id):
            return False
        out = deltas(changes, versions)
        out.write.mode("overwrite").parquet(f"{self.root}/batch={batch_id}")
        return True

    def batches(self) -> list[str]:
        fs, p = self._fs(self.root)
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(n.removeprefix("batch=") for n in names if n.startswith("batch=")
                      and self.committed(n.removeprefix("batch=")))

    def _folds(self) -> list[int]:
        fs, p = self._fs(self.root)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        found = [int(n.removeprefix("folded=")) for n in names if n.startswith("folded=")]
        return sorted(n for n in found if fs.exists(self._fs(f"{self.root}/folded={n}/totals/_SUCCESS")[1]))

    def _parts(self) -> tuple[int, list[str], list[str]]:
        """The newest fold (0: none), the batches in it, and the folders that make up the totals."""
        newest = max(self._folds(), default=0)
        inside: list[str] = []
        if newest:
            inside = [r.batch for r in self.spark.read.schema("batch string").parquet(f"{self.root}/folded={newest}/ids").collect()]
        later = sorted(set(self.batches()) - set(inside))
        paths = [f"{self.root}/batch={b}" for b in later] + ([f"{self.root}/folded={newest}/totals"] if newest else [])
        return newest, inside + later, paths

    def _sum(self, paths: list[str]) -> DataFrame:
        read = self.spark.read.schema(self.SCHEMA)
        rows = read.parquet(*paths) if paths else self.spark.createDataFrame([], self.SCHEMA)
        return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])

    def fold(self) -> None:
        """Store the totals of all batches so far: later reads take them and only the batches that come after.

        The fold counts once its totals are written whole; the ids of its batches are written before. Batch
        folders stay as the marks that keep a replay out.
        """
        newest, batches, paths = self._parts()
        to = f"{self.root}/folded={newest + 1}"
        ids = self.spark.createDataFrame([(b,) for b in batches], "batch string")
        ids.coalesce(1).write.mode("overwrite").parquet(f"{to}/ids")
        self._sum(paths).write.mode("overwrite").parquet(f"{to}/totals")

    def totals(self) -> DataFrame:
        return self._sum(self._parts()[2])
