"""How far the sources of a language differ in their words, from bitmaps per count.

Words are runs of letters and of characters beyond ASCII, A-Z lower-cased. A language keeps the words that
at least ``min_docs`` of its documents hold (V of them). Each (language, source) group and each language gives
a kept word with ``n`` occurrences among its N the rate ``p = 1 + floor(10**9 * (n + 5) / (N + 5 * V))``.

The kept words of a language are dealt to blocks of about 512 by a hash and numbered inside their block. A
group's words that occur ``n`` times are one bitset per block, kept in words of 64 bits. For two groups the AND
of their bitsets and a popcount give how many words occur ``n`` times here and ``m`` times there, which is then
multiplied by the difference of the two rates; words that one side lacks follow by complement. So the work is per
pair of counts, not per word, and a block is small whatever the vocabulary. Sources are dealt to tiles of about
128, and a task holds two tiles in one block, so that many sources do not gather either. All numbers are whole.

Counting is one pass in tasks (a byte table lower-cases and parts the words), with one shuffle by word after it.

Defined cases: null text, language and source are read as empty; a group without kept words has the rates
of zero counts; a language without kept words has pairs of value 0 and no terms; repeated rows count as often
as they occur; an empty table has no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxtally.session import cut_lineage

MIN_DOCS = 30
TOP_TERMS = 50
SCALE = 10**9
PRIOR = 5
#: Kept words of a block and sources of a tile, about.
BLOCK_TERMS, TILE_SOURCES = 512, 128
#: Counts a task holds before it hands them on, and bytes of a text that are taken at a time.
HELD_COUNTS, PIECE = 400_000, 1 << 22

# Bytes of words stay (A-Z as a-z), all others part them.
_WORD_BYTES = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

COUNTS = "lang string, source string, term string, n long, docs long"


def _pieces(raw: bytes) -> Iterator[bytes]:
    """Parts of a separated text that end between words."""
    at = 0
    while at < len(raw):
        end = at + PIECE
        if end < len(raw):
            end = raw.find(b" ", end)
            end = len(raw) if end < 0 else end
        yield raw[at:end]
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), held in counts.items():
            terms = list(held)
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
                pa.array(terms, pa.binary()).cast(pa.string()),
                pa.array(held.values(), pa.int64()), pa.array(map(docs[lang, source].__getitem__, terms), pa.int64())],
                names=["lang", "source", "term", "n", "docs"])
        counts.clear()
        docs.clear()

    for batch in batches:
        for lang, source, raw in zip(*(batch.column(k).to_pylist() for k in range(3))):
            held, seen = counts.setdefault((lang, source), Counter()), set()
            for piece in _pieces(raw.translate(_WORD_BYTES)):
                words = piece.split()
                held.update(words)
                seen.update(words)
            docs.setdefault((lang, source), Counter()).update(seen)
        if sum(map(len, counts.values())) > HELD_COUNTS:
            yield from rows()
    yield from rows()


def kept_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang, source, term, n, total, first``: kept words by group.

    ``total`` counts the word in the language; ``first`` marks one row per word. All rows of a word come
    together in the one shuffle, which sums, filters and totals.
    """
    def whole(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(""))

    found = docs.select(whole("lang").alias("lang"), whole("source").alias("source"),
                        whole("text").cast("binary").alias("text")).mapInArrow(_count, COUNTS)
    groups = found.repartition("lang", "term").groupBy("lang", "term", "source").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    word = Window.partitionBy("lang", "term")
    return (groups.withColumns({"docs": F.sum("docs").over(word), "total": F.sum("n").over(word),
                                "first": F.col("source") == F.min("source").over(word)})
            .where(F.col("docs") >= min_docs).select("lang", "source", "term", "n", "total", "first"))


def _rate(n: str, of: str) -> Column:
    """The rate of a count; in decimals, since a billion counts leave the range of long."""
    return F.expr(f"case when v = 0 then 0L else 1L + cast(({SCALE}BD * ({n} + {PRIOR})) div "
                  f"(cast({of} as decimal(19, 0)) + {PRIOR}BD * v) as long) end")


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """``lang, source, size, v, lang_size, sources``: one row per group that occurs, with or without kept words."""
    groups = docs.groupBy(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).agg(
        F.count("*").alias("rows")).select("lang", "source")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count_if("first").alias("firsts"))
    known = groups.join(sums, ["lang", "source"], "left").na.fill(0, ["size", "firsts"])
    langs = known.groupBy("lang").agg(F.sum("firsts").alias("v"), F.sum("size").alias("lang_size"), F.count("*").alias("sources"))
    return known.join(langs, "lang").select("lang", "source", "size", "v", "lang_size", "sources")


def count_bitmaps(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """``lang, block, source, n, p, word, bits``: the words with ``n`` occurrences in a group, as bits.

    Count 0 has one row per group and block without bits, as its bitset is the complement of the others.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col("v") / BLOCK_TERMS)).cast("int")
    here = totals.select("lang", "source", "size", "v", blocks.alias("blocks"))
    numbered = (kept.join(here, ["lang", "source"])
                .withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
                .withColumn("at", F.dense_rank().over(Window.partitionBy("lang", "block").orderBy("term")) - 1))
    bit = F.expr("shiftleft(1L, cast(at % 64 as int))")
    levels = (numbered.withColumns({"p": _rate("n", "size"), "word": F.floor(F.col("at") / 64).cast("int")})
              .groupBy("lang", "block", "source", "n", "p", "word").agg(F.bit_or(bit).alias("bits")))
    zeros = here.select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source",
                        F.lit(0).cast("long").alias("n"), _rate("0", "size").alias("p"), F.lit(0).alias("word"),
                        F.lit(0).cast("long").alias("bits"))
    return levels.unionByName(zeros)


def _joint(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """For each pair of sources of two tiles: the differences of rates in this block, beyond those of two zeros."""
    lang, _, one, other = key
    rows = rows.sort_values(["source", "n", "word"])
    words = int(rows["word"].max()) + 1
    sides = []
    for source, part in rows.groupby("source", sort=True):
        zero = int(part["p"].iloc[0])  # count 0 comes first
        part = part[part["n"] > 0]
        level, at = np.unique(part["n"].to_numpy(), return_inverse=True)
        bits, p = np.zeros((len(level), words), np.uint64), np.zeros(len(level), np.int64)
        bits[at, part["word"]] = part["bits"].to_numpy().view(np.uint64)
        p[at] = part["p"]
        sides.append((source, zero, bits, p, np.bitwise_count(bits).sum(1, dtype=np.int64)))
    tiles = dict(zip(rows["source"], rows["tile"]))
    out = []
    for i, (a, za, bits_a, p_a, na) in enumerate(sides):
        for b, zb, bits_b, p_b, nb in sides[i + 1:]:
            if one != other and tiles[a] == tiles[b]:
                continue
            both = np.bitwise_count(bits_a[:, None, :] & bits_b[None, :, :]).sum(2, dtype=np.int64)
            value = (both * np.abs(p_a[:, None] - p_b[None, :])).sum()
            value += ((na - both.sum(1)) * np.abs(p_a - zb)).sum() + ((nb - both.sum(0)) * np.abs(p_b - za)).sum()
            value -= (na.sum() + nb.sum() - both.sum()) * abs(za - zb)
            out.append((lang, a, b, int(value)))
    return pd.DataFrame(out, columns=["lang", "a", "b", "value"])


def pair_values(bitmaps: DataFrame, totals: DataFrame) -> DataFrame:
    """``lang, source, item, value`` of every ordered pair of sources of a language."""
    tiles = F.ceil(F.col("sources") / TILE_SOURCES).cast("int")
    zero = _rate("0", "size").alias("zero")
    here = totals.select("lang", "source", "v", tiles.alias("tiles"), zero)
    tile = F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")
    dealt = (bitmaps.join(here.select("lang", "source", "tiles"), ["lang", "source"]).withColumn("tile", tile)
             .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
             .withColumns({"one": F.least("tile", "with"), "other": F.greatest("tile", "with")})
             .select("lang", "block", "one", "other", "source", "tile", "n", "p", "word", "bits"))
    sums = (dealt.groupBy("lang", "block", "one", "other").applyInPandas(_joint, "lang string, a string, b string, value long")
            .groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    first = here.select("lang", F.col("source").alias("a"), F.col("zero").alias("za"), "v")
    second = here.select("lang", F.col("source").alias("b"), F.col("zero").alias("zb"))
    whole = (sums.join(first, ["lang", "a"]).join(second, ["lang", "b"])
             .withColumn("value", F.col("value") + F.col("v") * F.abs(F.col("za") - F.col("zb"))))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                             F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("e")
    return whole.select("lang", both, "value").select("lang", "e.source", "e.item", "value")


def term_values(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """``lang, source, item, value`` of the words that a group has more often than its language."""
    rated = kept.join(totals, ["lang", "source"]).withColumns({"p": _rate("n", "size"), "q": _rate("total", "lang_size")})
    return rated.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: all pairs of sources and the leading terms of each group.

    The cut to ``top_terms`` is that of a report; it is taken in each task before the shuffle.
    """
    kept = cut_lineage(kept_counts(docs, min_docs))
    totals = cut_lineage(group_totals(docs, kept))
    bitmaps = cut_lineage(count_bitmaps(kept, totals))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pair_values(bitmaps, totals).withColumn("rank", F.row_number().over(order))
    terms = term_values(kept, totals).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    return (pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
            .select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")))
