"""Sharding by a k-d tree over metadata, with distributed weighted medians.

A node holds the rows that met all conditions on the way to it. It is split along
the dimension that is widest there, relative to the whole table, at the weighted
median: rows below the cut go left. Rows that share the cut's value are ordered by
a hash of id and text, so a value that a third of all rows share is split as well.
All nodes of a level are split together: each pass is one aggregate over narrow
rows to at most nodes x BINS sums, of which one row per node reaches the driver. The cuts of a
level (fewer than one per shard) go back as a small table, so the plan does not grow with the shards. Splitting ends at the wanted number of leaves: a given one, or as many
as the total weight needs so that a leaf holds the target bytes.

Defined cases: null text weighs 1 byte and has the checksum of the empty text; null
ids and other nulls stand at zero; rows repeated in full may stand on either side
of a cut; an empty table has no rows. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxtally.session import cut_lineage

BINS = 1024
#: A cut is final when the bin it lies in holds less than this share of the node.
TOLERANCE = 0.0005
SLOT_RUN = 20_000


@dataclass(frozen=True)
class Cut:
    """Left are the rows with ``dim < at`` or ``dim = at and tie < tie_at``; ``dim`` is a place in the list of dimensions."""
    dim: int
    at: int
    tie_at: int


def _by_node(rows: DataFrame, known: list[dict], types: dict[str, str], how: str) -> DataFrame:
    """Join what is known of a few nodes (less than twice the leaves) to their rows.

    It comes as a table: conditions spelled out node by node would double the plan of a pass with each level.
    """
    kinds = {"long": pa.int64(), "boolean": pa.bool_()}
    table = pa.Table.from_pylist(known, pa.schema([(c, kinds[t]) for c, t in types.items()]))
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(table)), "node", how)


def _value(dims: list[str]) -> Column:
    """The value of a row in the dimension that ``dim`` names."""
    return F.get(F.array(*dims), F.col("dim"))


def _search(rows: DataFrame, dims: list[str], goals: dict[int, tuple[int, int, int, int, int]]) -> dict[int, Cut]:
    """Weighted cuts of several nodes at once.

    ``goals``: node -> (dimension, lowest, highest, weight to go left, weight of the
    node). Value ranges shrink by BINS in each pass, first of the dimension, then
    of the tie among rows with the found value. A pass returns one row per node: the bin in which its goal lies.
    """
    open_ = {n: {"node": n, "dim": d, "tied": False, "low": lo, "high": hi, "goal": goal, "all": total, "at": None}
             for n, (d, lo, hi, goal, total) in goals.items()}
    done: dict[int, Cut] = {}
    types = {"tied": "boolean"} | {c: "long" for c in ("node", "dim", "low", "high", "width", "goal", "at")}
    before = Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    while open_:
        for s in open_.values():
            s["width"] = max(1, -(-(s["high"] - s["low"] + 1) // BINS))
        asked = _by_node(rows.select("node", "weight", "tie", *dims), [{c: s[c] for c in types} for s in open_.values()], types, "inner")
        binned = (asked.withColumn("value", _value(dims)).where("not tied or value = at")
                  .withColumn("value", F.when(F.col("tied"), F.col("tie")).otherwise(F.col("value"))).where("value between low and high")
                  .select("node", "goal", "weight", F.expr("(value - low) div width").alias("bin")))
        sums = (binned.groupBy("node", "goal", "bin").agg(F.sum("weight").alias("w"), F.count("*").alias("n"))
                .withColumn("below", F.coalesce(F.sum("w").over(before), F.lit(0))))
        met_at = F.min(F.when(F.col("below") + F.col("w") > F.col("goal"), F.struct("bin", "w", "n", "below")))
        found = {r.node: r for r in sums.groupBy("node").agg(F.sum("w").alias("w"), met_at.alias("met")).collect()}
        for n in list(open_):
            s, r = open_[n], found.get(n)
            met = r.met if r else None
            tied = s["tied"]
            if met is None:  # everything fits on the left
                s["goal"] -= r.w if r else 0
                edge = s["high"] + 1
            else:
                s["goal"] -= met.below
                low = s["low"] + met.bin * s["width"]
                # A bin with one row, or hardly any weight, goes to the side where more of it fits.
                if met.n > 1 and met.w > TOLERANCE * s["all"]:
                    if s["width"] > 1:
                        s |= {"low": low, "high": min(s["high"], low + s["width"] - 1)}
                        continue
                    if not tied:
                        s |= {"tied": True, "at": low, "low": 0, "high": 2**62 - 1}
                        continue
                edge = low + (s["width"] if 2 * s["goal"] >= met.w else 0)
            done[n] = Cut(s["dim"], s["at"], edge) if tied else Cut(s["dim"], edge, -2**63)
            del open_[n]
    return done


def kd_tree(rows: DataFrame, dims: list[str], leaves: int) -> DataFrame:
    """Add ``node``: the leaf (0 to ``leaves`` - 1) of each row.

    ``rows`` has the long columns ``dims``, ``weight`` and ``tie`` (0 to 2**62 - 1). Any number of leaves
    works: a node that stands for k of them sends k // 2 shares of its weight left. The plan grows with the number
    of levels, one small join each.
    """
    columns = rows.columns
    spans = [f(c).alias(f"{k}_{c}") for c in dims for k, f in (("lo", F.min), ("hi", F.max))]
    open_ = {0: leaves}  # first leaf of a node -> leaves it stands for
    rows = rows.withColumn("node", F.lit(0).cast("long"))
    whole = None
    while max(open_.values()) > 1:
        stats = {r.node: r for r in rows.groupBy("node").agg(F.sum("weight").alias("w"), *spans).collect()}
        if not stats:
            break
        whole = whole or stats[0]
        goals = {}
        for n, k in open_.items():
            if k < 2 or n not in stats:
                continue
            s = stats[n]

            def spread(c, s=s):
                return (s[f"hi_{c}"] - s[f"lo_{c}"]) / max(1, whole[f"hi_{c}"] - whole[f"lo_{c}"])

            d = max(dims, key=spread)
            goals[n] = (dims.index(d), s[f"lo_{d}"], s[f"hi_{d}"], s.w * (k // 2) // k, s.w)
        cuts = [{"node": n, "dim": c.dim, "at": c.at, "tie_at": c.tie_at, "step": open_[n] // 2}
                for n, c in _search(rows, dims, goals).items()]
        cut = _by_node(rows, cuts, dict.fromkeys(("node", "dim", "at", "tie_at", "step"), "long"), "left")
        value, at = _value(dims), F.col("at")
        left = F.col("dim").isNull() | (value < at) | ((value == at) & (F.col("tie") < F.col("tie_at")))
        rows = cut.select(*columns, F.when(left, F.col("node")).otherwise(F.col("node") + F.col("step")).alias("node"))
        after = {}
        for n, k in open_.items():
            after[n] = k // 2 if k > 1 else 1
            if k > 1:
                after[n + k // 2] = k - k // 2
        open_ = after
    return rows


def narrow(docs: DataFrame) -> DataFrame:
    """What sharding needs to know of each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    crc = F.crc32(text.cast("binary"))

    def code(c: str) -> Column:
        return (F.crc32(F.col(c).cast("string").cast("binary")) if c in docs.columns else F.lit(None)).cast("long")

    size = (F.octet_length("text") if "text" in docs.columns else F.lit(0)).cast("long")
    return docs.select("doc_id", (F.coalesce(size, F.lit(0)) + 1).cast("long").alias("size"),
                       crc.alias("text_crc32"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("by_id"),
                       F.coalesce(code("source"), F.lit(0)).alias("by_source"),
                       F.coalesce(code("lang"), F.lit(0)).alias("by_lang"),
                       F.shiftrightunsigned(F.xxhash64("doc_id", crc), 2).alias("tie"))


def shard(docs: DataFrame, shards: int = 16, target_bytes: int | None = None) -> DataFrame:
    """One row per document row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    ``law`` is ``bytes``: the shards hold nearly equal bytes. With ``target_bytes`` their number follows from
    the total, in place of ``shards``. Slots run from 0 without gaps.
    """
    rows = cut_lineage(narrow(docs)).withColumn("weight", F.col("size"))
    if target_bytes is not None:
        total = rows.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
        shards = max(1, -(-total // target_bytes))
    tree = kd_tree(rows, ["by_id", "size", "by_source", "by_lang"], shards)
    placed = cut_lineage(tree.select("doc_id", "size", "text_crc32", "tie", F.col("node").alias("shard")))
    runs = max(1, placed.count() // (shards * SLOT_RUN))
    placed = placed.withColumn("run", F.col("tie") % runs)
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = (placed.groupBy("shard", "run").agg(F.count("*").alias("n"))
              .select("shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    order = Window.partitionBy("shard", "run").orderBy("tie", "doc_id")
    return (placed.withColumn("at", F.row_number().over(order)).join(starts, ["shard", "run"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
                    (F.col("base") + F.col("at") - 1).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
