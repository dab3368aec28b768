"""Ordered greedy selection within a group, exact at every group size.

The rule: walk the rows of a group in a fixed order and keep a row unless it
conflicts with one kept before. Two plans give the same rows:

* :func:`fold_groups` gathers a group in one array and folds over it. One
  shuffle, no Python; right for groups of tens to hundreds of rows.
* :func:`settle_groups` never gathers a group. Rows are placed in grid cells, and
  each round keeps, in all cells at once, every row that no undecided row can rule
  out, then strikes out what those rule out. Right for a group that holds a large
  share of all rows.

:func:`ordered_greedy` measures the group sizes and sends each group one way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxtally.session import cut_lineage, deal

#: rows of one group that may be gathered in one array
GATHER_LIMIT = 512
#: rows of one group that are folded: each is compared with those kept before it, so the work grows with the square
FOLD_LIMIT = 64
#: rows of one grid cell that are compared with one another in a round; a row's conflicts are the bits of one word
HEAD = 64

Conflict = Callable[[Column, Column], Column]
Region = Callable[[Column], Column]
#: the same conflict on arrays of rows: columns by name, boxes as mappings, texts as codes (below 0: null)
Test = Callable[[dict, dict], np.ndarray]

GONE, OPEN, FREE, KEPT = range(4)


def large_groups(frames: Sequence[DataFrame], key: str, limit: int = GATHER_LIMIT) -> DataFrame | None:
    """Keys with more than ``limit`` rows over all frames, or None if there are none.

    Reads only the key column and counts before the shuffle.
    """
    keys = frames[0].select(key)
    for f in frames[1:]:
        keys = keys.unionByName(f.select(key))
    big = keys.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select(key)
    return None if big.isEmpty() else cut_lineage(big)


def keep_greedily(rows: Column, conflict: Conflict) -> Column:
    """Of an ordered array the rows that conflict with none kept before them."""
    none = F.slice(rows, 1, 0)
    return F.aggregate(rows, none, lambda kept, row: F.when(
        F.exists(kept, lambda k: conflict(k, row)), kept).otherwise(F.array_append(kept, row)))


def fold_groups(df: DataFrame, key: str, order: dict[str, Column], conflict: Conflict) -> DataFrame:
    """Gather each group, sort it by ``order`` and keep greedily."""
    columns = [c for c in df.columns if c != key]
    ordered = [c.alias(f"_o{i}") for i, c in enumerate(order.values())]
    packed = df.select(key, F.struct(*ordered, F.struct(*columns).alias("row")).alias("r"))
    kept = packed.groupBy(key).agg(F.transform(
        F.array_sort(F.collect_list("r")), lambda r: r["row"]).alias("rows"))
    return kept.select(key, F.inline(keep_greedily(F.col("rows"), conflict)))


def _own_level(region: Column) -> Column:
    """The first level whose cells, ``2**level`` wide, are as wide as the region."""
    return F.ceil(F.log2(F.greatest(region["x2"] - region["x1"], region["y2"] - region["y1"], F.lit(1)))).cast("int")


def _place(rows: DataFrame, region: Column, levels: list[int]) -> DataFrame:
    """A row for each grid cell that the region touches: ``_level``, ``_x``, ``_y``, and how many they are in ``_in``.

    Cells are those of the region's own level and of every coarser level in use, so there are at most four of a
    level. Two regions that share a point share a cell of the coarser one's level.
    """
    def span(low: str, high: str, level: Column) -> list[Column]:
        wide = F.pow(F.lit(2.0), level)
        return [F.floor(region[low] / wide), F.floor(region[high] / wide)]

    own, count = _own_level(region), F.lit(0).cast("long")
    for level in levels:
        x, y = span("x1", "x2", F.lit(level)), span("y1", "y2", F.lit(level))
        count = count + F.when(F.lit(level) >= own, (x[1] - x[0] + 1) * (y[1] - y[0] + 1)).otherwise(0)
    known = rows.withColumn("_in", count)
    if len(levels) == 1:
        known = known.withColumn("_level", F.lit(levels[0]))
    else:
        known = known.withColumn("_level", F.explode(F.array(*map(F.lit, levels)))).filter(F.col("_level") >= own)
    return known.withColumn("_x", F.explode(F.sequence(*span("x1", "x2", F.col("_level"))))).withColumn(
        "_y", F.explode(F.sequence(*span("y1", "y2", F.col("_level")))))


def _grid(rows: DataFrame, key: Sequence[str], region: Column, head: int) -> list[int]:
    """Levels of the cells: one wide grid where its cells stay thinly filled, else the levels of all regions.

    In a wide grid few regions cross a line, so nearly all rows have one cell. How full a row finds its cell is
    counted over all rows, by the corner of its region.
    """
    levels = sorted(r[0] for r in rows.select(_own_level(region)).distinct().collect() if r[0] is not None)
    if not levels:
        return [0]
    for more in (4, 3, 2, 1, 0):
        wide = F.lit(2.0 ** (levels[-1] + more))
        sizes = rows.groupBy(*key, F.floor(region["x1"] / wide).alias("x"), F.floor(region["y1"] / wide).alias("y")).agg(
            F.count(F.lit(1)).alias("n"))
        if sizes.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] <= head / 2:
            return [levels[-1] + more]
    return levels


def _arrays(column: pa.ChunkedArray):
    """A column as numpy: structs by field, texts as codes."""
    column = column.combine_chunks()
    if pa.types.is_struct(column.type):
        return {f.name: _arrays(pa.chunked_array([pc.struct_field(column, f.name)])) for f in column.type}
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = pc.fill_null(column.dictionary_encode().indices, -1)
    values = column.to_numpy(zero_copy_only=False)
    return values.astype(np.int64) if values.dtype.kind in "iu" else values


def _judge(batches: Iterator[pa.RecordBatch], test: Test, fields: Sequence[str], head: int) -> Iterator[pa.RecordBatch]:
    """Judge the first ``head`` rows of each cell, all cells of a batch at once; rows come by cell, numbered in ``_n``.

    A row learns which of the rows before it in its cell rule it out, as bits of a word; then the cells are walked
    in step, the first row of each, the second, and so on. Rows past the first ``head`` stay open and are passed on
    as they come, so a cell of any size is held by its first rows only.
    """
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if not rows.num_rows:
            continue
        if held is not None:
            rows = pa.concat_tables([held, rows])
        n = rows.column("_n").to_numpy()
        # The last cell may go on in the next batch, unless all its first rows are here.
        start = rows.num_rows if n[-1] > head else rows.num_rows - int(n[-1])
        held = rows.slice(start).combine_chunks()
        if start:
            yield from _judged(rows.slice(0, start), test, fields, head).to_batches()
    if held is not None and held.num_rows:
        yield from _judged(held, test, fields, head).to_batches()


def _judged(rows: pa.Table, test: Test, fields: Sequence[str], head: int) -> pa.Table:
    n = rows.column("_n").to_numpy().astype(np.int64)
    alone = rows.column("_in").to_numpy() == 1
    cell = np.cumsum(n == 1)
    more = np.zeros(cell[-1] + 1, dtype=bool)
    more[cell[n > head]] = True
    state = np.full(len(n), OPEN, dtype=np.int32)
    first = np.flatnonzero(n <= head)
    columns = {f: _arrays(rows.column(f)) for f in fields}

    def at(i: np.ndarray) -> dict:
        return {f: {k: v[i] for k, v in c.items()} if isinstance(c, dict) else c[i] for f, c in columns.items()}

    against = np.zeros(len(n), dtype=np.uint64)
    later, back = first[n[first] > 1], 1
    while len(later):
        hit = later[test(at(later - back), at(later))]
        against[hit] |= np.uint64(1) << (n[hit] - 1 - back).astype(np.uint64)
        back += 1
        later = later[n[later] > back]
    kept, waits = (np.zeros(len(more), dtype=np.uint64) for _ in range(2))
    by_place = first[np.argsort(n[first], kind="stable")]
    for i in np.split(by_place, np.flatnonzero(np.diff(n[by_place])) + 1):
        if not len(i):
            continue
        c, bit = cell[i], np.uint64(1) << np.uint64(n[i[0]] - 1)
        out, hangs = (against[i] & kept[c]) != 0, (against[i] & waits[c]) != 0
        state[i] = np.where(out, GONE, np.where(hangs, OPEN, np.where(alone[i], KEPT, FREE)))
        kept[c[state[i] == KEPT]] |= bit
        waits[c[(state[i] == OPEN) | (state[i] == FREE)]] |= bit
    # Of the rows ruled out, only those are listed that other cells wait for.
    listed = np.flatnonzero((state != GONE) | ~alone)
    return rows.drop_columns(["_n"]).append_column("_more", pa.array(more[cell])).append_column(
        "state", pa.array(state)).take(pa.array(listed))


def settle_groups(df: DataFrame, key: str, order: dict[str, Column], conflict: Conflict, reach: Region,
                  within: Sequence[str] = (), head: int = HEAD, *, test: Test, fields: Sequence[str],
                  alike: Sequence[str] = ()) -> DataFrame:
    """Decide all rows of a group at once that nothing undecided rules out, until no row is open.

    ``reach`` is the region of a row: rows conflict only if their regions share a point and their ``within``
    columns are equal. So conflicts are looked for inside grid cells; a crowded photo is as many keys as it has
    cells. In a round the first ``head`` rows of each cell are walked in order, by arrays over many cells
    (``test`` is ``conflict`` on the columns ``fields``). A row that a kept row before it
    rules out goes. A row that none rules out, and no open row either, is kept, if its cell is its only one: then
    the rows after it are judged by that in the same round. A row in several cells is kept if it is free in all of
    them, which the end of the round finds out; what such a row strikes out goes then. A round decides wherever it
    can, so the number of rounds follows the longest chain of rows that hang on one another across cells (and how
    many kept rows fit in a cell), not the number of rows. The first round moves each row once per cell, and only
    rows that are kept or open are written; later ones move only what is still open. Of rows equal in ``alike``
    (which holds all that ``reach`` and ``test`` look at), the first stands for all; they are found in their cell.
    No pairs of rows are written. Shuffles have as many tasks as their rows need.
    """
    columns = df.columns
    names = [f"_o{i}" for i in range(len(order))]
    rows = [*columns, "_id"]
    row = F.struct(*columns)
    levels = _grid(df, [key, *within], reach(row), head)
    # A single level is a constant, by which the planner would not know the dealt rows again.
    cell = [key, *within, *(["_level"] if len(levels) > 1 else []), "_x", "_y"]

    def rules_out(a: Column, b: Column) -> Column:
        return F.coalesce(conflict(a, b), F.lit(False))

    def by_cell(df: DataFrame, n: int) -> DataFrame:
        return deal(_place(df.select(*rows), reach(row), levels), n, *cell)

    def judge(placed: DataFrame) -> DataFrame:
        """Every row in each of its cells; rows past the first ``head`` of a cell wait."""
        ties = [c for c in columns if c != key]
        nth = Window.partitionBy(*cell).orderBy(*names, *ties, "_id")
        ordered = placed.withColumns(dict(zip(names, order.values()))).withColumn("_n", F.row_number().over(nth)).select(*rows, "_in", "_n")
        out = placed.select(*rows, "_in").withColumns({"_more": F.lit(True), "state": F.lit(0)}).schema
        return ordered.mapInArrow(lambda batches: _judge(batches, test, fields, head), out)

    # Ties go by the rows themselves; the ids are dealt once, before a row is put into its cells.
    placed = by_cell(df.withColumn("_id", F.monotonically_increasing_id()), df.count())
    if alike:
        others = [c for c in rows if c not in (key, *alike)]
        stands = F.min(F.struct(*[c.alias(n) for n, c in zip(names, order.values())], *others)).alias("_s")
        same = list(dict.fromkeys([*cell, *alike, "_in"]))
        placed = placed.groupBy(*same).agg(stands).select(*same, *[f"_s.{c}" for c in others])
    done = []
    while True:
        judged = cut_lineage(judge(placed))
        left = judged.filter(f"_in > 1 or state = {OPEN} or _more").count()
        alone = judged.filter("_in = 1")
        done.append(alone.filter(F.col("state") == KEPT).select(*columns))
        if not left:
            break
        shared = cut_lineage(deal(judged.filter("_in > 1"), left, "_id").groupBy("_id").agg(
            F.min("state").alias("state"), F.count(F.lit(1)).alias("_seen"), F.first("_in").alias("_in"),
            *[F.first(c).alias(c) for c in columns]).filter(F.col("state") != GONE))
        both = (F.col("state") == FREE) & (F.col("_seen") == F.col("_in"))
        done.append(shared.filter(both).select(*columns))
        strikers = shared.filter(both).select(*rows).unionByName(alone.filter((F.col("state") == KEPT) & F.col("_more")).select(*rows))
        waiting = alone.filter(F.col("state") == OPEN).select(*rows).unionByName(shared.filter(~both).select(*rows))
        near = by_cell(strikers, left).groupBy(*cell).agg(F.collect_list(row).alias("_kept"))
        struck = by_cell(waiting, left).join(near, cell).filter(F.exists("_kept", lambda k: rules_out(k, row))).select("_id")
        open_ = deal(waiting, left, "_id").join(deal(struck, left, "_id"), "_id", "left_anti")
        placed = by_cell(open_, left)
    out = df.limit(0)
    for part in done:
        out = out.unionByName(part)
    return out


def ordered_greedy(rows: DataFrame, key: str, order: dict[str, Column], conflict: Conflict, *,
                   reach: Region, test: Test, fields: Sequence[str],
                   within: Sequence[str] = (), alike: Sequence[str] = (),
                   prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
                   limit: int = FOLD_LIMIT) -> DataFrame:
    """Keep greedily among ``prepare(rows)``, each group by the plan that fits its size.

    Group sizes are counted on ``rows``, whose key column is cheap to read.
    ``prepare`` may drop, join or collapse rows within their group. It runs on rows already partitioned by the
    key, so it and the fold share one shuffle. For large groups it runs first, but where it only keeps the first
    of rows equal in ``alike``, their cells do that on the shuffle they need anyway.
    """
    def small(df: DataFrame) -> DataFrame:
        ready = prepare(df.repartition(key))
        return fold_groups(ready, key, order, conflict).select(*ready.columns)

    big = large_groups([rows], key, limit)
    if big is None:
        return small(rows)
    crowded = rows.join(big, key, "left_semi")
    crowded = crowded.select(*prepare(rows).columns) if alike else prepare(crowded)
    return small(rows.join(big, key, "left_anti")).unionByName(settle_groups(
        crowded, key, order, conflict, reach, within, test=test, fields=fields, alike=alike))
