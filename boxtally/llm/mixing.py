"""Mixing sources to target weights by Sainte-Laguë apportionment of token blocks.

The words of a source are laid end to end in a seeded order of its documents and
cut into blocks of equal tokens. The shards of the output get equal numbers of
seats; a seat is one block. Seats go to the source with the highest quotient
target / (2 * seats + 1). Because that method only ever adds seats as the house
grows, shard k gets what the house of k + 1 shards has more than that of k, always
whole numbers. A quota beyond a source's blocks is whole passes over it plus a
seeded choice of distinct blocks for the rest: block j is in when (a * j + b) mod n
is below the rest, with ``a`` prime to ``n``, which picks exactly that many, without
sorting or moving blocks. The same order, cut at the cumulated quotas per shard, deals the taken blocks to
the shards (``mixed_shards``).

Running totals are taken in two steps (buckets of a source, then rows of a bucket),
so a source with a third of all rows is spread over tasks.

Defined cases: null text has no words and is taken 0 times; a null source is a source
of its own, last in order; an empty table has no rows; ties in the order fall to id
and size, so rows repeated in full may swap places. Extra columns are kept by
``mixed_documents`` and ignored by ``mix``.
"""

from __future__ import annotations

from collections.abc import Callable
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxtally.llm.common import count_space_words
from boxtally.session import cut_lineage

WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
BLOCK_TOKENS = 64
SHARDS = 16
BUCKET_ROWS = 2_000


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES) -> list[float]:
    """Share the sum of all sizes by repeating weights; nobody above ``most`` times its size.

    What a capped source cannot take is shared again by weight among the others.
    """
    n, total = len(sizes), float(sum(sizes))
    weight = [weights[i % len(weights)] for i in range(n)]
    capped: set[int] = {i for i in range(n) if sizes[i] == 0}
    while True:
        left = total - sum(most * sizes[i] for i in capped)
        share = sum(weight[i] for i in range(n) if i not in capped)
        out = [float(most * sizes[i]) if i in capped else left * weight[i] / share for i in range(n)]
        above = {i for i in range(n) if i not in capped and out[i] > most * sizes[i]}
        if not above:
            return out
        capped |= above


def sainte_lague(target: list[float], seats: int, most: list[int] | None = None) -> list[int]:
    """Seats by highest quotients target / (2 s + 1); equal quotients go to the earlier source.

    Found by bisecting the divisor, so the work does not grow with the seats.
    ``most`` ends a source's claims.
    """
    n = len(target)
    most = most or [seats] * n
    seats = min(seats, sum(m for m, t in zip(most, target) if t > 0))

    def at(quotient: float) -> list[int]:
        # Seats whose quotient is at least this one.
        return [min(m, max(0, int((t / quotient + 1) // 2))) if t > 0 else 0 for t, m in zip(target, most)]

    if seats <= 0:
        return [0] * n
    low, high = 0.0, 2 * max(target) + 1
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        if sum(at(mid)) > seats:
            low = mid
        else:
            high = mid
    out = at(high)
    while sum(out) < seats:
        i = max((i for i in range(n) if target[i] > 0 and out[i] < most[i]),
                key=lambda i: (target[i] / (2 * out[i] + 1), -i))
        out[i] += 1
    return out


def plan(sizes: list[int], block: int = BLOCK_TOKENS, shards: int = SHARDS) -> list[dict]:
    """Per source: size, target, blocks, quota in blocks and quota per shard."""
    target = targets(sizes)
    blocks = [-(-s // block) for s in sizes]
    most = [MOST_PASSES * b for b in blocks]
    seats = round(sum(sizes) / block)
    houses = [sainte_lague(target, seats * (k + 1) // shards, most) for k in range(shards)]
    out = []
    for i, size in enumerate(sizes):
        per = [houses[k][i] - (houses[k - 1][i] if k else 0) for k in range(shards)]
        out.append({"source_size": size, "target": target[i], "blocks": blocks[i],
                    "quota": houses[-1][i], "per_shard": per})
    return out


def _step(n: int, seed: int) -> tuple[int, int]:
    """A multiplier prime to ``n`` and an offset, from the seed."""
    a = max(1, int(n * 0.6180339887) + seed % 7)
    while gcd(a, n) != 1:
        a += 1
    return a % n if n > 1 else 0, seed * 2654435761 % max(1, n)


def _laid_out(docs: DataFrame, seed: int) -> DataFrame:
    """``doc_id, src, size, first``: place of each document's first word in its source."""
    rows = docs.select("doc_id", F.col("source").alias("src"), count_space_words(F.col("text")).alias("size"),
                       F.xxhash64(F.lit(seed), "doc_id").alias("draw"), F.xxhash64("text").alias("text_hash"))
    rows = cut_lineage(rows)
    buckets = max(1, rows.count() // BUCKET_ROWS)
    rows = rows.withColumn("bucket", F.pmod(F.col("draw"), F.lit(buckets)))
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = (rows.groupBy("src", "bucket").agg(F.sum("size").alias("s"))
             .select(F.col("src").alias("src2"), F.col("bucket").alias("bucket2"),
                     F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base")))
    order = (Window.partitionBy("src", "bucket").orderBy("draw", "doc_id", "size", "text_hash")
             .rowsBetween(Window.unboundedPreceding, -1))
    inner = rows.withColumn("inner", F.coalesce(F.sum("size").over(order), F.lit(0)))
    return (inner.join(bases, F.col("src").eqNullSafe(F.col("src2")) & (F.col("bucket") == F.col("bucket2")))
            .select("doc_id", "src", "size", "text_hash", (F.col("base") + F.col("inner")).alias("first")))


def _source_plan(rows: DataFrame, block: int, seed: int) -> DataFrame:
    """One row per source. The number of sources, not of documents, bounds what reaches the driver."""
    spark = rows.sparkSession
    found = [(r.src, r.s) for r in rows.groupBy("src").agg(F.sum("size").alias("s")).collect()]
    found.sort(key=lambda x: (x[0] is None, x[0] or ""))
    made = []
    for i, ((src, _), p) in enumerate(zip(found, plan([s for _, s in found], block))):
        n = p["blocks"]
        a, b = _step(n, seed + i) if n else (0, 0)
        made.append((src, p["source_size"], p["target"], n, p["quota"] // n if n else 0,
                     p["quota"] % n if n else 0, a, b, p["per_shard"]))
    return spark.createDataFrame(made, "src2 string, source_size long, target double, blocks long, passes long, "
                                       "rest long, a long, b long, per_shard array<long>")


def _rank(j: Column, plan: Callable[[str], Column]) -> Column:
    """Place of block j in the drawn order of its source, from 0."""
    n = F.greatest(plan("blocks"), F.lit(1))
    small = (j * plan("a") + plan("b")) % n  # no overflow below 2**31 blocks
    large = ((j.cast("decimal(38,0)") * plan("a") + plan("b")) % n).cast("long")
    return F.when(n < 2**31, small).otherwise(large)


def _drawn(j: Column, plan: Callable[[str], Column]) -> Column:
    """Whether block j is among those of the last, partial pass."""
    return _rank(j, plan) < plan("rest")


def _passes(j: Column) -> Column:
    """How often block j is taken."""
    return F.col("passes") + _drawn(j, F.col).cast("long")


def _planned(docs: DataFrame, block: int, seed: int) -> DataFrame:
    rows = cut_lineage(_laid_out(docs, seed))
    by_source = _source_plan(rows, block, seed)
    return rows.join(by_source, F.col("src").eqNullSafe(F.col("src2")))


def mix(docs: DataFrame, block: int = BLOCK_TOKENS, seed: int = 7) -> DataFrame:
    """One row per document row: ``doc_id, size, source_size, target, taken``."""
    rows = _planned(docs, block, seed)
    end = F.col("first") + F.col("size")
    js = F.sequence(F.floor(F.col("first") / block), F.floor((end - 1) / block))
    inside = F.aggregate(js, F.lit(0).cast("long"), lambda acc, j: acc + _passes(j) * (
        F.least(end, (j + 1) * block) - F.greatest(F.col("first"), j * block)))
    taken = F.when(F.col("size") > 0, inside).otherwise(F.lit(0))
    return rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_shards(docs: DataFrame, block: int = BLOCK_TOKENS, seed: int = 7) -> DataFrame:
    """What each shard of the mix holds: ``doc_id, source, block, pass, shard, taken`` per document row and taken block.

    The taken blocks of a source, pass by pass in drawn order, are cut at its cumulated quotas per shard, so a
    shard has ``per_shard`` blocks of it. A block of several documents has a row for each.
    """
    rows = _planned(docs, block, seed).where("size > 0")
    end = F.col("first") + F.col("size")
    j, k = F.col("block"), F.col("pass")
    cut = (rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((end - 1) / block))))
           .withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(MOST_PASSES - 1))))
           .where((k < F.col("passes")) | ((k == F.col("passes")) & _drawn(j, F.col))))
    ends = F.transform("per_shard", lambda _, i: F.aggregate(F.slice("per_shard", 1, i + 1), F.lit(0).cast("long"), lambda x, y: x + y))
    seat = k * F.col("blocks") + _rank(j, F.col)
    cut = cut.withColumn("ends", ends).withColumn("seat", seat)
    return cut.select("doc_id", F.col("src").alias("source"), "block", "pass",
                      F.size(F.filter("ends", lambda e: e <= F.col("seat"))).alias("shard"),
                      (F.least(end, (j + 1) * block) - F.greatest(F.col("first"), j * block)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, block: int = BLOCK_TOKENS, seed: int = 7) -> DataFrame:
    """The mix as documents: per pass one row with the text of the words it takes.

    A document taken whole keeps its text as it is; of others the words in taken blocks stay,
    each with the white space behind it. Columns are those of ``docs``; ``n_chars`` is
    that of the new text.
    """
    planned = _planned(docs, block, seed).where("size > 0")
    plan_cols = ["first", "size", "passes", "rest", "a", "b", "blocks"]
    keyed = planned.select(F.col("doc_id").alias("_id"), F.col("src").alias("_src"), F.col("text_hash").alias("_hash"),
                           F.struct(*plan_cols).alias("_plan"),
                           F.row_number().over(Window.partitionBy("doc_id", "src", "text_hash").orderBy("first"))
                           .alias("_nth"))
    own = docs.withColumns({
        "_hash2": F.xxhash64("text"),
        "_nth2": F.row_number().over(Window.partitionBy("doc_id", "source", F.xxhash64("text")).orderBy(F.lit(0)))})
    met = own.join(keyed, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_src"))
                   & (F.col("_hash2") == F.col("_hash")) & (F.col("_nth2") == F.col("_nth")))
    met = met.withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(MOST_PASSES - 1))))
    p = F.col("_plan")

    def in_pass(k: Column) -> Column:
        return (F.col("_pass") < p["passes"]) | (
            (F.col("_pass") == p["passes"]) & _drawn(F.floor(k / block), lambda c: p[c]))

    # A piece is a word and the white space behind it; white space before the first word goes with it.
    pieces = F.split(F.regexp_replace("text", r"^[\x20\x09-\x0D]+", ""), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    cut = F.array_join(F.filter(pieces, lambda w, i: in_pass(p["first"] + i)), "")
    text = F.when(F.col("_pass") < p["passes"], F.col("text")).otherwise(
        F.when((F.col("_pass") == p["passes"]) & (p["rest"] > 0), cut).otherwise(F.lit("")))
    out = met.withColumn("text", text).where(F.length("text") > 0)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*docs.columns)
