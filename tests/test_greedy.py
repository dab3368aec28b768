"""Ordered operators against their sequential definitions, by both plans."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import definitions as ref
from boxtally.operators import crops, dedup, greedy, matching, proposals
from boxtally.operators.greedy import large_groups
from boxtally.session import cut_lineage

BOX = "struct<x1:int,y1:int,x2:int,y2:int>"


def as_tuple(b):
    return b.x1, b.y1, b.x2, b.y2


def random_readings(seed, n, crowd):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        image = 0 if rng.random() < crowd else rng.randrange(1, 8)
        x, y = rng.randrange(0, 400), rng.randrange(0, 300)
        rows.append((image, i, rng.choice(["7290000000001", "7290000000002", "12"]),
                     rng.choice(["Code128", "QRCode"]),
                     (x, y, x + rng.choice([20, 60, 140]), y + rng.choice([10, 40]))))
    # exact copies
    rows += [(r[0], n + k, *r[2:]) for k, r in enumerate(rng.choices(rows, k=n // 3))]
    return rows


@pytest.mark.parametrize("limit", [5, 40, 10_000])
def test_dedup_equals_definition(spark, limit):
    rows = random_readings(1, 260, 0.5)
    df = spark.createDataFrame(rows, f"image_id int, ord int, value string, format string, box {BOX}")
    got = {(r.image_id, r.ord) for r in dedup.dedup_detections(df, limit).collect()}
    want = set()
    for image in {r[0] for r in rows}:
        mine = [(o, v, f, b) for i, o, v, f, b in rows if i == image]
        kept = ref.greedy(mine, lambda r: (-ref.box_area(r[3]), r[0]), ref.same_reading)
        want |= {(image, r[0]) for r in kept}
    assert got == want


def test_rounds_do_not_grow_with_rows(spark, monkeypatch):
    """One photo, four times the rows on four times the area and ten copies of each: as many rounds."""
    rounds = []
    for n in (250, 1000):
        rng, calls = random.Random(n), []
        rows = []
        for i in range(n):
            x, y = rng.randrange(0, int(60 * n ** 0.5)), rng.randrange(0, int(60 * n ** 0.5))
            rows += [(0, i * 10 + k, "v", "f", (x, y, x + rng.randrange(20, 60), y + rng.randrange(20, 60))) for k in range(10)]
        df = spark.createDataFrame(rows, f"image_id int, ord int, value string, format string, box {BOX}")
        monkeypatch.setattr(greedy, "cut_lineage", lambda d, calls=calls: calls.append(1) or cut_lineage(d))
        got = {r.ord for r in dedup.dedup_detections(df, 512).collect()}
        monkeypatch.undo()
        want = ref.greedy([(o, v, f, b) for _, o, v, f, b in rows], lambda r: (-ref.box_area(r[3]), r[0]), ref.same_reading)
        assert got == {r[0] for r in want}
        rounds.append((len(calls) - 3) // 2)
    assert rounds[1] <= rounds[0] + 2 < 12


@pytest.mark.parametrize("limit", [6, 10_000])
def test_suppression_equals_definition(spark, limit):
    rng = random.Random(2)
    rows = []
    for i in range(240):
        x, y = rng.randrange(0, 900), rng.randrange(0, 900)
        rows.append((rng.choice([0, 0, 1, 2]), i, rng.randrange(0, 40) / 8,
                     (x, y, x + rng.randrange(100, 500), y + rng.randrange(100, 400))))
    df = spark.createDataFrame(rows, f"image_id int, proposal_id int, score double, box {BOX}")
    got = {r.proposal_id for r in proposals.suppress_overlaps(df, limit).collect()}
    want = set()
    for image in (0, 1, 2):
        mine = [(p, s, b) for i, p, s, b in rows if i == image]
        want |= {r[0] for r in ref.greedy(mine, lambda r: (-r[1], r[0]), ref.overlapping)}
    assert got == want


def random_photo(spark, seed, crowd=0.5):
    rng = random.Random(seed)
    labels, dets = [], []
    for i in range(160):
        image = 0 if rng.random() < crowd else rng.randrange(1, 6)
        x, y = rng.randrange(0, 2500), rng.randrange(0, 2500)
        box = (x, y, x + 700, y + 600)
        labels.append((image, i, box, None if i % 3 else (x + 10, y + 10, x + 300, y + 200), "clear"))
        x, y = rng.randrange(0, 2800), rng.randrange(0, 2800)
        dets.append((image, i, f"v{i}", "Code128", (x, y, x + 100, y + 40)))
    images = [(i, 3000, 3200) for i in range(6)]
    return (spark.createDataFrame(labels, f"image_id int, label_index int, label_box {BOX}, barcode_box {BOX}, status string"),
            spark.createDataFrame(dets, f"image_id int, det_index int, value string, format string, box {BOX}"),
            spark.createDataFrame(images, "image_id int, image_width int, image_height int"), labels, dets)


def pairs_by_hand(labels, dets, w=3000, h=3200):
    out = []
    for image, li, box, code, _ in labels:
        t = code or box
        t = (min(max(t[0], 0), w), min(max(t[1], 0), h), min(max(t[2], 0), w), min(max(t[3], 0), h))
        px, py = max(20, round((t[2] - t[0]) * 0.15)), max(20, round((t[3] - t[1]) * 0.15))
        tx, ty = ref.center(t)
        for other, di, _, _, b in dets:
            cx, cy = ref.center(b)
            if other == image and t[0] - px <= cx <= t[2] + px and t[1] - py <= cy <= t[3] + py:
                dx, dy = (tx - cx) / w, (ty - cy) / h
                out.append((image, (dx * dx + dy * dy) ** 0.5, li, di))
    return out


@pytest.mark.parametrize("by_cell", [True, False])
def test_candidates_equal_definition(spark, by_cell):
    l, d, i, labels, dets = random_photo(spark, 3)
    got = sorted((r.image_id, r.label_index, r.det_index)
                 for r in matching.candidate_pairs(l, d, i, by_cell=by_cell).collect())
    assert got == sorted((a, li, di) for a, _, li, di in pairs_by_hand(labels, dets))


@pytest.mark.parametrize("limit", [10, 10_000])
@pytest.mark.parametrize("seed", [4, 5])
def test_matching_equals_definition(spark, seed, limit):
    l, d, i, labels, dets = random_photo(spark, seed)
    got = {(r.image_id, r.label_index, r.det_index) for r in matching.match_labels(l, d, i, limit).collect()}
    kept = ref.greedy(pairs_by_hand(labels, dets), lambda r: r,
                      lambda a, b: a[0] == b[0] and (a[2] == b[2] or a[3] == b[3]))
    assert got == {(a, li, di) for a, _, li, di in kept}
    pairs = matching.candidate_pairs(l, d, i)
    again = {(r.image_id, r.label_index, r.det_index) for r in matching.assign_matches(pairs, limit).collect()}
    assert again == got
    assert matching.match_conflicts(matching.match_labels(l, d, i)).isEmpty()


@pytest.mark.parametrize("limit", [10, 10_000])
def test_recovery_appends_and_matches_again(spark, limit):
    l, d, i, labels, dets = random_photo(spark, 6)
    first = matching.match_labels(l, d, i, limit)
    rescans = [(a, li, f"r{li}", "Code128", (b or t)) for a, li, t, b, _ in labels if li % 2]
    extra = spark.createDataFrame(rescans, f"image_id int, det_index int, value string, format string, box {BOX}")
    before = first.count()
    all_dets, final, counters = matching.with_recovery(l, d, extra, i, limit)
    assert final.count() - before == counters.agg(F.sum("labels_resolved")).first()[0] > 0
    assert matching.match_conflicts(final).isEmpty()
    open_images = {r.image_id for r in counters.collect()}
    assert all_dets.count() == len(dets) + len([r for r in rescans if r[0] in open_images])


@pytest.mark.parametrize("recovered", [True, False])
def test_photo_counts_by_both_ways(spark, recovered):
    l, d, i, labels, dets = random_photo(spark, 7)
    extra = spark.createDataFrame([(a, li, f"r{li}", "Code128", (b or t)) for a, li, t, b, _ in labels if li % 2],
                                  f"image_id int, det_index int, value string, format string, box {BOX}") if recovered else None
    def counted(limit):
        rows = matching.photo_counts(l, d, i, extra, limit).collect()
        assert all(len(r.missing_labels) == r.visible - r.matched for r in rows)
        return {(*tuple(r)[:-1], tuple(r.missing_labels)) for r in rows}

    counts = counted(10_000)
    assert counted(10) == counts
    final = matching.with_recovery(l, d, extra, i, 10)[1] if recovered else matching.match_labels(l, d, i)
    assert {r.image_id: r["count"] for r in final.groupBy("image_id").count().collect()} == {r[0]: r[3] for r in counts if r[3]}
    assert sum(r[1] for r in counts) == len(labels)
    # labels, both scans and sizes together by one shuffle
    assert exchanges(spark, lambda: matching.photo_counts(l, d, i, extra, 10_000)) == 1


def test_photos_with_many_pairs_are_crowded(spark):
    l = spark.createDataFrame([(1, k) for k in range(200)] + [(2, 1)], "image_id int, label_index int")
    d = spark.createDataFrame([(1, k) for k in range(200)] + [(2, k) for k in range(300)], "image_id int, det_index int")
    assert [r.image_id for r in matching.crowded_images(l, d).collect()] == [1]


def test_no_fallback_to_the_label_box(spark):
    labels = spark.createDataFrame([(1, 1, (0, 0, 500, 500), (0, 0, 50, 50), "clear")],
                                   f"image_id int, label_index int, label_box {BOX}, barcode_box {BOX}, status string")
    dets = spark.createDataFrame([(1, 1, "x", "Code128", (300, 300, 340, 340))],
                                 f"image_id int, det_index int, value string, format string, box {BOX}")
    images = spark.createDataFrame([(1, 1000, 1000), (2, 1000, 1000)], "image_id int, image_width int, image_height int")
    rows = {r.image_id: tuple(r)[1:] for r in matching.reconcile(labels, dets, images).collect()}
    assert rows == {1: (1, 0, False), 2: (0, 0, True)}


def test_grid_gaps_equal_definition(spark):
    rng = random.Random(8)
    rows, photos = [], {}
    for image in range(150):
        n = rng.randrange(2, 14)
        cells = rng.sample([(r, c) for r in range(4) for c in range(3)], min(n, 12))
        jitter = rng.choice([5, 60, 400])
        pts = []
        for k, (r, c) in enumerate(cells):
            x, y = 500 + 1000 * c + rng.randrange(-jitter, jitter), 500 + 1000 * r + rng.randrange(-jitter, jitter)
            b = (x - 50, y - 20, x + 51, y + 20)
            rows.append((image, k, "729000000000%d" % k, "Code128", b))
            pts.append(ref.center(b))
        rows.append((image, 99, "short", "Code128", (0, 0, 10, 10)))
        photos[image] = pts
    dets = spark.createDataFrame(rows, f"image_id long, det_index int, value string, format string, box {BOX}")
    images = spark.createDataFrame([(i, 3000, 4000) for i in photos], "image_id long, image_width int, image_height int")
    got = {i: set() for i in photos}
    for r in crops.infer_grid_gaps(dets, images).collect():
        got[r.image_id].add((r.grid_row, r.grid_column, *as_tuple(r.box)))
    want = {i: ref.grid_gaps(p, 3000, 4000) for i, p in photos.items()}
    assert got == want and any(want.values())


def test_size_check_reads_only_the_key(spark):
    df = spark.range(2000).select((F.col("id") % 3).alias("k"), F.lit("x").alias("payload"))
    assert {r.k for r in large_groups([df], "k", 600).collect()} == {0, 1, 2}
    assert large_groups([df], "k", 700) is None


def test_top_rows_are_cut_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    text = dedup.first_per_key(df, ["k"], ["v"])._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") == 2


def exchanges(spark, df_of):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return df_of()._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_matching_moves_each_side_once(spark):
    l, d, i, _, _ = random_photo(spark, 9)
    # labels, readings and image sizes; the joins and the fold add none
    assert exchanges(spark, lambda: matching.match_labels(l, d, i)) == 3


def test_dedup_moves_rows_once(spark):
    rows = random_readings(1, 60, 0.5)
    df = spark.createDataFrame(rows, f"image_id int, ord int, value string, format string, box {BOX}")
    assert exchanges(spark, lambda: dedup.dedup_detections(df)) == 1


def test_array_conflicts_equal_columns(spark):
    """What tasks judge by arrays is what the column expressions say, also for null values and formats."""
    import numpy as np

    from boxtally.functions import arrays

    rng = random.Random(8)
    rows = []
    for i in range(3000):
        x, y, u, v = (rng.randrange(0, 90) for _ in range(4))
        rows.append((i, *[(rng.choice(["1", "2", None]), rng.choice(["Q", "C", None]), (a, b, a + rng.randrange(0, 200), b + rng.randrange(0, 200)))
                          for a, b in ((x, y), (u, v))]))
    one = f"struct<value:string,format:string,box:{BOX}>"
    df = spark.createDataFrame(rows, f"i int, a {one}, b {one}")
    got = df.select("i", F.coalesce(dedup.same_reading(F.col("a"), F.col("b")), F.lit(False)),
                    proposals.overlaps(F.col("a"), F.col("b"))).orderBy("i").collect()
    code = {None: -1, "1": 1, "2": 2, "Q": 1, "C": 2}

    def side(k):
        return {c: np.array([code[r[k][j]] for r in rows]) for j, c in enumerate(("value", "format"))} | {
            "box": {c: np.array([r[k][2][j] for r in rows]) for j, c in enumerate(("x1", "y1", "x2", "y2"))}}

    a, b = side(1), side(2)
    assert arrays.same_reading(a, b, dedup.MISREAD_TOLERANCE).tolist() == [r[1] for r in got]
    assert arrays.overlaps(a, b).tolist() == [r[2] for r in got]


def test_keyed_steps_grow_tasks_with_rows(spark, monkeypatch):
    """Ten times the rows are dealt to ten times the tasks, so that none holds more of them."""
    from boxtally import session

    monkeypatch.setattr(session, "TASK_ROWS", 100)
    df = spark.range(10)
    assert session.deal(df, 1000, "id").rdd.getNumPartitions() == 10
    assert session.deal(df, 10_000, "id").rdd.getNumPartitions() == 100


def test_groups_of_a_hundred_rows_are_not_folded(spark, monkeypatch):
    """A fold compares a row with all kept before it, so only groups of tens of rows are folded."""
    from boxtally.operators import greedy, proposals

    rows = spark.range(250).selectExpr(
        "id % 2 + if(id < 240, 0, 2) as image_id", "id as proposal_id", "pmod(hash(id), 90) / 10D as score", "cast(pmod(hash(id, 1), 2000) as int) as x",
        "cast(pmod(hash(id, 2), 2000) as int) as y").selectExpr(
        "image_id", "proposal_id", "score", "named_struct('x1', x, 'y1', y, 'x2', x + 300, 'y2', y + 200) as box").localCheckpoint()
    folded = sorted(map(repr, proposals.suppress_overlaps(rows, limit=512).collect()))
    sizes, settled = [], greedy.settle_groups

    def watched(df, key, *rest, **named):
        sizes.extend(r["count"] for r in df.groupBy(key).count().collect())
        return settled(df, key, *rest, **named)

    monkeypatch.setattr(greedy, "settle_groups", watched)
    assert sorted(map(repr, proposals.suppress_overlaps(rows).collect())) == folded
    assert sizes == [120, 120]
