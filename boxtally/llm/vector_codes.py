"""Compressing vectors to codes: one small codebook per part, learned over metric trees.

A vector becomes whole numbers ``floor(4096 * x)`` and is cut into 8 consecutive parts. The codebook of a part
starts as that part of the 16 vectors with the smallest ids; each round gives every part to its nearest entry
(ties to the lower index) and moves the entry to the floored mean of what it got. An entry that got nothing stays.

The parts never move, so each task arranges those of up to some thousand vectors once as a tree of balls, and the
trees are a written table. A tree grows from the middle: about sqrt(n) anchors are placed, each new one at the point
that is farthest from its anchor, taking over the points that are nearer to it (a point within half the distance of
both anchors cannot be, and is not looked at). Each anchor's points make a subtree in the same way; then the balls
of the anchors are merged in pairs, the smallest union first, up to the root. A ball holds its rounded centre, the
reach of its points from there, their number and their sum.

A round sends the codebooks down the trees. A ball inherits the entries its parent left possible; those that lie
behind the halfway plane of the nearest one for the whole ball are struck out. Once one entry is left, the ball's
count and sum go to it and its points are not visited. Leaves compare their points with the entries left. Only
16 x dimensions sums reach the driver in a round. All results are whole numbers; the one comparison in floating
point, that of the plane, errs towards keeping an entry.

Defined cases: rows whose vector is null or holds a null or non-finite component are dropped; an empty table gives
none; with fewer than 16 vectors there are fewer entries; rows with one id are all kept, and among the smallest
ids the smaller vector comes first; null ids come last; null labels are equal to each other. A vector whose length is
not that of the first one, or is no multiple of 8, and components of 2**17 or more, are refused with an error, since
no code or whole error exists for them. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, StructType

from boxtally.session import cut_lineage

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components of the vectors in one tree, about; points of a leaf.
CHUNK_COMPONENTS, LEAF = 1 << 18, 24
LIMIT = 2**29

Codebooks = list[np.ndarray]


@dataclass
class Tree:
    """Balls over the points of one part, the root first; points lie in the order of the leaves."""
    order: np.ndarray
    points: np.ndarray
    start: np.ndarray
    end: np.ndarray
    left: np.ndarray
    right: np.ndarray
    center: np.ndarray
    reach: np.ndarray
    total: np.ndarray

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f.name: getattr(self, f.name) for f in fields(self)})
        return out.getvalue()

    @staticmethod
    def load(raw: bytes) -> Tree:
        with np.load(io.BytesIO(raw)) as z:
            return Tree(**{f.name: z[f.name] for f in fields(Tree)})


@dataclass
class _Ball:
    at: np.ndarray
    total: np.ndarray
    center: np.ndarray
    reach: int
    below: tuple[_Ball, _Ball] | None = None


def _ball(points: np.ndarray, at: np.ndarray, total: np.ndarray | None = None, below=None) -> _Ball:
    mine = points[at]
    total = mine.sum(0) if total is None else total
    center = np.rint(total / len(at)).astype(np.int64)
    return _Ball(at, total, center, int(((mine - center) ** 2).sum(1).max()), below)


def _anchored(points: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The points dealt to about sqrt(n) anchors, each to the nearest."""
    mine = points[at]
    anchors = mine[:1]
    owner, near = np.zeros(len(at), np.int64), ((mine - mine[0]) ** 2).sum(1)
    for n in range(1, int(np.ceil(np.sqrt(len(at))))):
        far = int(near.argmax())
        if near[far] == 0:
            break
        apart = ((anchors - mine[far]) ** 2).sum(1)
        open_ = np.flatnonzero(4 * near > apart[owner])
        d = ((mine[open_] - mine[far]) ** 2).sum(1)
        won = d < near[open_]
        owner[open_[won]], near[open_[won]] = n, d[won]
        anchors = np.vstack([anchors, mine[far]])
    return [at[owner == n] for n in range(len(anchors))]


def _merged(points: np.ndarray, balls: list[_Ball]) -> _Ball:
    """One binary tree over the balls: the two with the smallest union become one, until one is left."""
    centers = np.array([b.center for b in balls], float)
    reach = np.sqrt([b.reach for b in balls])
    cost = (np.sqrt(((centers[:, None] - centers[None]) ** 2).sum(2)) + reach[:, None] + reach[None]) / 2
    np.fill_diagonal(cost, np.inf)
    last = balls[0]
    for _ in range(len(balls) - 1):
        i, j = divmod(int(cost.argmin()), len(balls))
        a, b = balls[i], balls[j]
        last = balls[i] = _ball(points, np.concatenate([a.at, b.at]), a.total + b.total, (a, b))
        centers[i], reach[i] = last.center, np.sqrt(last.reach)
        row = (np.sqrt(((centers - centers[i]) ** 2).sum(1)) + reach + reach[i]) / 2
        row[np.isinf(cost[i])] = np.inf
        cost[i], cost[:, i] = row, row
        cost[j], cost[:, j] = np.inf, np.inf
    return last


def _grown(points: np.ndarray, at: np.ndarray) -> _Ball:
    if len(at) <= LEAF:
        return _ball(points, at)
    groups = _anchored(points, at)
    return _ball(points, at) if len(groups) == 1 else _merged(points, [_grown(points, g) for g in groups])


def plant(points: np.ndarray) -> Tree:
    """The tree over the rows of a matrix of whole numbers."""
    nodes, children, starts, size = [], [], [], 0
    stack = [(_grown(points, np.arange(len(points))), None)]
    while stack:  # depth first, so a ball's points are contiguous
        ball, above = stack.pop()
        if above is not None:
            children[above].append(len(nodes))
        starts.append(size)
        if ball.below is None:
            size += len(ball.at)
        else:
            stack += [(ball.below[1], len(nodes)), (ball.below[0], len(nodes))]
        nodes.append(ball)
        children.append([])
    order = np.concatenate([b.at for b in nodes if b.below is None])
    start = np.array(starts)
    return Tree(order, points[order].astype(np.int32), start, start + [len(b.at) for b in nodes],
                np.array([c[0] if c else -1 for c in children]), np.array([c[1] if c else -1 for c in children]),
                np.array([b.center for b in nodes]), np.array([b.reach for b in nodes]), np.array([b.total for b in nodes]))


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(np.int64) - b) ** 2).sum(-1)


def descend(tree: Tree, book: np.ndarray, owned: Callable[[np.ndarray, np.ndarray], None],
            nearest: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """Send the entries down the tree, a level of balls at a time.

    ``owned(nodes, entries)`` is told of balls that one entry holds wholly, ``nearest(points, entries)`` of single
    points in leaves.
    """
    apart = _square(book[:, None], book[None])
    # Of equal entries only the first can be nearest.
    nodes, open_ = np.zeros(1, np.int64), ~np.tril(apart == 0, -1).any(1)[None]
    while len(nodes):
        d = _square(tree.center[nodes][:, None], book[None])
        best = np.where(open_, d, np.iinfo(np.int64).max).argmin(1)
        lead = d - np.take_along_axis(d, best[:, None], 1)
        open_ = open_ & ~(lead > 2.000001 * np.sqrt(tree.reach[nodes].astype(float)[:, None] * apart[best]))
        whole = open_.sum(1) == 1
        owned(nodes[whole], best[whole])
        nodes, open_ = nodes[~whole], open_[~whole]
        leaf = tree.left[nodes] < 0
        if leaf.any():
            sizes = (tree.end - tree.start)[nodes[leaf]]
            at = np.repeat(tree.start[nodes[leaf]] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            left = np.repeat(open_[leaf], sizes, axis=0)
            least, entry = np.full(len(at), np.iinfo(np.int64).max), np.zeros(len(at), np.int64)
            for k in range(len(book)):
                rows = np.flatnonzero(left[:, k])
                d = _square(tree.points[at[rows]], book[k])
                nearer = d < least[rows]
                least[rows[nearer]], entry[rows[nearer]] = d[nearer], k
            nearest(at, entry)
        nodes, open_ = nodes[~leaf], open_[~leaf]
        nodes, open_ = np.concatenate([tree.left[nodes], tree.right[nodes]]), np.concatenate([open_, open_])


def part_sums(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of the points by nearest entry."""
    sums, counts = np.zeros(book.shape, np.int64), np.zeros(len(book), np.int64)

    def owned(nodes, entries):
        np.add.at(sums, entries, tree.total[nodes])
        np.add.at(counts, entries, (tree.end - tree.start)[nodes])

    def nearest(at, entries):
        np.add.at(sums, entries, tree.points[at])
        counts[:] += np.bincount(entries, minlength=len(book))

    descend(tree, book, owned, nearest)
    return sums, counts


def part_codes(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of every point, in the order of the rows."""
    entry = np.empty(len(tree.order), np.int64)

    def owned(nodes, entries):
        for n, e in zip(nodes, entries):
            entry[tree.start[n]:tree.end[n]] = e

    def nearest(at, entries):
        entry[at] = entries

    descend(tree, book, owned, nearest)
    code, error = np.empty_like(entry), np.empty_like(entry)
    code[tree.order], error[tree.order] = entry, _square(tree.points, book[entry])
    return code, error


def whole_numbers(vectors: pa.Array, width: int) -> np.ndarray:
    """``floor(4096 * x)`` of vectors without nulls, as a matrix."""
    sizes = np.unique(vectors.value_lengths().to_numpy(zero_copy_only=False))
    if len(sizes) and (len(sizes) > 1 or sizes[0] != width):
        raise ValueError(f"vectors have {sizes.tolist()} components, the first one has {width}")
    x = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(float) * SCALE)
    if len(x) and np.abs(x).max() >= LIMIT:
        raise ValueError(f"a component reaches {LIMIT // SCALE}")
    return x.astype(np.int64).reshape(len(vectors), width)


def finite(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, embedding`` of the rows whose vector has numbers only."""
    def number(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    return vectors.where(F.col("embedding").isNotNull() & F.forall("embedding", number)).select("vec_id", "label", "embedding")


def first_codebooks(kept: DataFrame) -> Codebooks:
    """The parts of the vectors with the smallest ids; at most 16 rows reach the driver."""
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).collect()
    if not rows:
        return []
    width = len(rows[0].embedding)
    if width % PARTS:
        raise ValueError(f"{width} components cannot be cut into {PARTS} equal parts")
    first = whole_numbers(pa.array([r.embedding for r in rows], pa.list_(pa.float64())), width)
    return [first[:, p * width // PARTS:(p + 1) * width // PARTS] for p in range(PARTS)]


def forest(kept: DataFrame, width: int) -> DataFrame:
    """One row per chunk of vectors: ids, labels and the tree of every part."""
    schema = StructType().add("vec_id", ArrayType(kept.schema["vec_id"].dataType)).add(
        "label", ArrayType(kept.schema["label"].dataType)).add("trees", ArrayType(BinaryType()))
    arrow, rows = to_arrow_schema(schema), max(256, CHUNK_COMPONENTS // max(1, width))

    def planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                some = batch.slice(at, rows)
                matrix = whole_numbers(some.column(2), width)
                trees = [plant(part).dump() for part in np.split(matrix, PARTS, axis=1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([some.column(0).to_pylist()], arrow.field(0).type),
                     pa.array([some.column(1).to_pylist()], arrow.field(1).type), pa.array([trees], arrow.field(2).type)],
                    schema=arrow)

    return cut_lineage(kept.mapInArrow(planted, schema))


def next_codebooks(trees: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every task sums over its trees, Spark over the tasks; the driver divides."""
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [np.zeros(b.shape, np.int64) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for chunk in batch.column(0):
                for p, raw in enumerate(chunk):
                    s, n = part_sums(Tree.load(raw.as_py()), books[p])
                    sums[p] += s
                    counts[p] += n
        cells = [(p, e, at, int(v), int(counts[p][e])) for p, s in enumerate(sums)
                 for (e, at), v in np.ndenumerate(s) if counts[p][e]]
        if cells:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells), [pa.int32()] * 3 + [pa.int64()] * 2)],
                                             names=["part", "entry", "at", "total", "n"])

    totals = (trees.select("trees").mapInArrow(summed, "part int, entry int, at int, total long, n long")
              .groupBy("part", "entry", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")))
    new = [b.copy() for b in books]
    for r in totals.collect():
        new[r.part][r.entry, r.at] = int(r.total) // r.n
    return new


def encode(trees: DataFrame, books: Codebooks) -> DataFrame:
    """``vec_id, label, code, error`` of every vector."""
    element = {c: trees.schema[c].dataType.elementType for c in ("vec_id", "label")}
    schema = StructType().add("vec_id", element["vec_id"]).add("label", element["label"]).add(
        "code", "string").add("error", "long")
    arrow = to_arrow_schema(schema)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, chunk in zip(*batch.columns):
                found = [part_codes(Tree.load(raw.as_py()), books[p]) for p, raw in enumerate(chunk)]
                digits = np.stack([c for c, _ in found], 1).astype(np.uint8).tobytes().hex()
                codes = [digits[at:at + 2 * PARTS] for at in range(0, len(digits), 2 * PARTS)]
                yield pa.RecordBatch.from_arrays(
                    [ids.values.cast(arrow.field(0).type), labels.values.cast(arrow.field(1).type), pa.array(codes),
                     pa.array(sum(e for _, e in found), pa.int64())], schema=arrow)

    return trees.mapInArrow(coded, schema)


def codebooks_digest(books: Codebooks) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()


def compress(vectors: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every kept vector."""
    kept = finite(vectors)
    books = first_codebooks(kept)
    trees = forest(kept, PARTS * books[0].shape[1] if books else 0)
    for _ in range(ROUNDS if books else 0):
        books = next_codebooks(trees, books)
    coded = cut_lineage(encode(trees, books))
    labels = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return coded.join(labels, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
