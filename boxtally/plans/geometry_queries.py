"""Box geometry, matching, de-duplication and region planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxtally.functions import geometry as g
from boxtally.functions import text
from boxtally.operators import crops, dedup, matching
from boxtally.operators import proposals as prop
from boxtally.plans import inputs
from boxtally.plans.catalog import query
from boxtally.plans.fixtures import build
from boxtally.plans.inputs import flat
from boxtally.session import cut_lineage


def _frame():
    return F.lit(3000), F.lit(4000)


def _box(p: str, x1: str, y1: str, x2: str, y2: str) -> str:
    return f"cast({x1} as int) as {p}x1, cast({y1} as int) as {p}y1, cast({x2} as int) as {p}x2, cast({y2} as int) as {p}y2"


# --- scalar geometry ---------------------------------------------------------

@query("P1 P3 P10", """
select image_id, det_index, x2 - x1 as width, y2 - y1 as height, (x1 + x2) / 2e0 as center_x,
  (y1 + y2) / 2e0 as center_y, cast(greatest(1, x2 - x1) * greatest(1, y2 - y1) as bigint) as area
from detection_boxes""", "detection_boxes")
def box_measures(spark, d):
    b = F.col("box")
    return inputs.detections(spark, d).select(
        "image_id", "det_index", g.width(b).alias("width"), g.height(b).alias("height"),
        g.center_x(b).alias("center_x"), g.center_y(b).alias("center_y"), g.area(b).alias("area"))


@query("P2", f"""
select vec, {_box('', 'round_even(l * w / 1000e0, 0)', 'round_even(t * h / 1000e0, 0)',
                  'round_even(r * w / 1000e0, 0)', 'round_even(b * h / 1000e0, 0)')}
from (select l_orderkey * 10 + l_linenumber as vec, l_partkey % 500 as l, l_suppkey % 500 as t,
  l_partkey % 500 + 1 + l_suppkey % 400 as r, l_suppkey % 500 + 1 + l_partkey % 400 as b,
  1000 + l_partkey % 3000 as w, 1000 + l_suppkey % 3000 as h from lineitem) n""")
def normalized_to_pixels(spark, d):
    n = build(spark, d, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber as vec", "l_partkey % 500 as l", "l_suppkey % 500 as t",
        "l_partkey % 500 + 1 + l_suppkey % 400 as r", "l_suppkey % 500 + 1 + l_partkey % 400 as b",
        "1000 + l_partkey % 3000 as w", "1000 + l_suppkey % 3000 as h")
    c = {k: F.col(k) for k in "tlbrwh"}
    return flat(n.select("vec", g.normalized_to_pixels(
        c["t"], c["l"], c["b"], c["r"], c["w"], c["h"]).alias("box")))


@query("P4 P5 P6 P13", f"""
select image_id, det_index,
  300 between x1 and x2 and 250 between y1 and y2 as holds_point,
  {_box('p_', 'x1 - 30', 'y1 - 20', 'x2 + 30', 'y2 + 20')},
  {_box('c_', 'least(greatest(x1, 0), 400)', 'least(greatest(y1, 0), 300)',
        'least(greatest(x2, 0), 400)', 'least(greatest(y2, 0), 300)')},
  {_box('r_', 'greatest(0, x1 - 12)', 'greatest(0, y1 - 6)', 'least(3000, x2 + 12)', 'least(4000, y2 + 6)')}
from detection_boxes""", "detection_boxes")
def pad_and_clamp(spark, d):
    b = F.col("box")
    out = inputs.detections(spark, d).select(
        "image_id", "det_index", g.contains_point(b, F.lit(300), F.lit(250)).alias("holds_point"),
        g.pad(b, F.lit(30), F.lit(20)).alias("p"), g.clamp(b, F.lit(400), F.lit(300)).alias("c"),
        g.pad_ratio(b, 0.12, *_frame()).alias("r"))
    for name in "pcr":
        out = flat(out, name, f"{name}_")
    return out


@query("P8 P9", f"""
select image_id, label_index, basis, {_box('', 'x1', 'y1', 'x2', 'y2')},
  cast(greatest(20, round_even((x2 - x1) * 0.15e0, 0)) as int) as pad_x,
  cast(greatest(20, round_even((y2 - y1) * 0.15e0, 0)) as int) as pad_y
from (select image_id, label_index,
  case when bx1 is null then 'label_bbox' else 'barcode_bbox' end as basis,
  coalesce(bx1, lx1) as x1, coalesce(by1, ly1) as y1, coalesce(bx2, lx2) as x2,
  coalesce(by2, ly2) as y2 from label_boxes) t""", "label_boxes")
def target_boxes(spark, d):
    t = F.col("t")
    out = inputs.labels(spark, d).select(
        "image_id", "label_index", g.target_basis(F.col("barcode_box")).alias("basis"),
        g.target_box(F.col("label_box"), F.col("barcode_box")).alias("t"))
    return flat(out.select("*", g.target_padding(g.width(t)).alias("pad_x"),
                           g.target_padding(g.height(t)).alias("pad_y")), "t")


_PAIRED = """
select a.image_id, a.label_index, b.det_index,
  greatest(0, least(a.lx2, b.x2) - greatest(a.lx1, b.x1)) *
  greatest(0, least(a.ly2, b.y2) - greatest(a.ly1, b.y1)) as s,
  (a.lx2 - a.lx1) * (a.ly2 - a.ly1) as area_a, (b.x2 - b.x1) * (b.y2 - b.y1) as area_b,
  (a.lx1 + a.lx2) / 2e0 as ax, (a.ly1 + a.ly2) / 2e0 as ay, (b.x1 + b.x2) / 2e0 as gx,
  (b.y1 + b.y2) / 2e0 as gy, a.lx1, a.ly1, a.lx2, a.ly2, b.x1, b.y1, b.x2, b.y2
from label_boxes a join detection_boxes b on a.image_id = b.image_id and a.label_index = b.det_index
"""


def _pairs(spark, d):
    """Each label beside the reading of the same ordinal: one row per label at most."""
    return inputs.labels(spark, d).select("image_id", "label_index", "label_box").join(
        inputs.detections(spark, d).select("image_id", F.col("det_index").alias("label_index"),
                                           "det_index", "box"), ["image_id", "label_index"])


@query("P7 P11 P12", f"""
select image_id, label_index, s / (area_b * 1e0) as inside,
  case when s = 0 then 0e0 else s / ((area_a + area_b - s) * 1e0) end as iou,
  sqrt(((ax - gx) / 3000) * ((ax - gx) / 3000) + ((ay - gy) / 4000) * ((ay - gy) / 4000)) as distance
from ({_PAIRED}) p""", "label_boxes detection_boxes")
def box_overlap(spark, d):
    a, b = F.col("label_box"), F.col("box")
    return _pairs(spark, d).select(
        "image_id", "label_index", g.containment(b, a).alias("inside"), g.iou(a, b).alias("iou"),
        g.normalized_distance(g.center_x(a), g.center_y(a), g.center_x(b), g.center_y(b), *_frame())
        .alias("distance"))


@query("P17 P18", f"""
select image_id, label_index, near, abs(ax - gx) <= 15 and abs(ay - gy) <= 15 as close_centers from (
select *, (abs(ax - gx) <= greatest(40e0, longest * 0.35e0) and abs(ay - gy) <= greatest(40e0, longest * 0.35e0))
   or es / (ea + eb - es) >= 0.20e0 as near
from (select *, greatest(lx2 - lx1, ly2 - ly1, x2 - x1, y2 - y1, 1) as longest,
  greatest(0, least(lx2, x2) - greatest(lx1, x1) + 40) * greatest(0, least(ly2, y2) - greatest(ly1, y1) + 40) * 1e0 as es,
  (lx2 - lx1 + 40) * (ly2 - ly1 + 40) * 1e0 as ea, (x2 - x1 + 40) * (y2 - y1 + 40) * 1e0 as eb
  from ({_PAIRED}) p) q) r""", "label_boxes detection_boxes")
def same_physical(spark, d):
    a, b = F.col("label_box"), F.col("box")
    return _pairs(spark, d).select("image_id", "label_index", g.same_physical(a, b).alias("near"),
                                   g.centers_within(a, b, 15).alias("close_centers"))


@query("P14 P15 P16", f"""
select image_id, det_index,
  {_box('m_', '10 + round_even(x1 * 0.5e0, 0)', '20 + round_even(y1 * 0.25e0, 0)',
        '10 + round_even(x2 * 0.5e0, 0)', '20 + round_even(y2 * 0.25e0, 0)')},
  {_box('u_', '10 + y1 - 20', '20 + 900 - (x2 - 10)', '10 + y2 - 20', '20 + 900 - (x1 - 10)')}
from detection_boxes""", "detection_boxes")
def polygons(spark, d):
    def corner(x, y):
        return F.struct(F.col(f"box.{x}").alias("x"), F.col(f"box.{y}").alias("y"))

    ring = F.array(corner("x1", "y1"), corner("x2", "y1"), corner("x2", "y2"), corner("x1", "y2"))
    ox, oy = F.lit(10), F.lit(20)
    out = inputs.detections(spark, d).select(
        "image_id", "det_index",
        g.polygon_to_box(g.map_polygon(ring, ox, oy, F.lit(0.5), F.lit(0.25))).alias("m"),
        g.polygon_to_box(g.unrotate_polygon(ring, ox, oy, F.lit(900))).alias("u"))
    return flat(flat(out, "m", "m_"), "u", "u_")


@query("P19 P20 P21", r"""
select image_id, ord, regexp_full_match(value, '[0-9]{12,}') as is_primary,
  replace(case when image_id % 3 = 0 then upper(format) when image_id % 3 = 1 then format else 'code 128' end, ' ', '') as squeezed,
  case when lower(replace(case when image_id % 3 = 0 then upper(format) when image_id % 3 = 1 then format else 'code 128' end, ' ', '')) = 'code128'
    then 'Code128' else replace(case when image_id % 3 = 0 then upper(format) when image_id % 3 = 1 then format else 'code 128' end, ' ', '') end as format,
  case when image_id % 2 = 0 then true else length(value) > 12 end as beats
from raw_detections""", "raw_detections")
def code_strings(spark, d):
    f = F.when(F.col("image_id") % 3 == 0, F.upper("format")).when(
        F.col("image_id") % 3 == 1, F.col("format")).otherwise("code 128")
    rival = F.when(F.col("image_id") % 2 == 0, "A-1234567890123456").otherwise("12345 67-890")
    return inputs.raw_detections(spark, d).select(
        "image_id", "ord", text.is_primary_code(F.col("value")).alias("is_primary"),
        F.replace(f, F.lit(" "), F.lit("")).alias("squeezed"),
        text.normalize_format(f).alias("format"),
        text.more_plausible(F.col("value"), rival).alias("beats"))


# --- matching ----------------------------------------------------------------

CANDIDATES = """
cand as (
  select t.image_id, sqrt(dx * dx + dy * dy) as distance, t.label_index, t.det_index, t.basis, t.value
  from (
    select l.*, b.det_index, b.value, (l.tx - (b.x1 + b.x2) / 2e0) / 3000 as dx,
      (l.ty - (b.y1 + b.y2) / 2e0) / 4000 as dy
    from (
      select image_id, label_index, basis, (x1 + x2) / 2e0 as tx, (y1 + y2) / 2e0 as ty, x1, y1, x2, y2,
        greatest(20, round_even((x2 - x1) * 0.15e0, 0)) as px,
        greatest(20, round_even((y2 - y1) * 0.15e0, 0)) as py
      from (select image_id, label_index,
        case when bx1 is null then 'label_bbox' else 'barcode_bbox' end as basis,
        least(greatest(coalesce(bx1, lx1), 0), 3000) as x1, least(greatest(coalesce(by1, ly1), 0), 4000) as y1,
        least(greatest(coalesce(bx2, lx2), 0), 3000) as x2, least(greatest(coalesce(by2, ly2), 0), 4000) as y2
        from label_boxes) t0) l
    join DETS b on b.image_id = l.image_id
      and (b.x1 + b.x2) / 2e0 between l.x1 - px and l.x2 + px
      and (b.y1 + b.y2) / 2e0 between l.y1 - py and l.y2 + py) t)
"""


def greedy_cte(name: str, cand: str) -> str:
    """Nearest-first assignment: one step per candidate rank, used keys in lists."""
    return f"""
{name}_seq as (select *, row_number() over (partition by image_id
    order by distance, label_index, det_index, basis) as n from {cand}),
{name}_walk as (
  select image_id, 0::bigint as n, []::bigint[] as ls, []::bigint[] as ds, false as hit from (select distinct image_id from {cand}) i
  union all
  select s.image_id, s.n,
    case when list_contains(w.ls, s.label_index) or list_contains(w.ds, s.det_index) then w.ls else list_append(w.ls, s.label_index) end,
    case when list_contains(w.ls, s.label_index) or list_contains(w.ds, s.det_index) then w.ds else list_append(w.ds, s.det_index) end,
    not (list_contains(w.ls, s.label_index) or list_contains(w.ds, s.det_index))
  from {name}_walk w join {name}_seq s on s.image_id = w.image_id and s.n = w.n + 1),
{name} as (select s.image_id, s.distance, s.label_index, s.det_index, s.basis, s.value
  from {name}_seq s join {name}_walk w on w.image_id = s.image_id and w.n = s.n and w.hit)
"""


FIRST = CANDIDATES.replace("DETS", "detection_boxes")
MATCHES = f"{FIRST}, {greedy_cte('matches', 'cand')}"


@query("J1", f"with {FIRST} select * from cand", "label_boxes detection_boxes")
def candidate_pairs(spark, d):
    return matching.candidate_pairs(inputs.labels(spark, d), inputs.detections(spark, d),
                                    inputs.images(spark, d))


@query("G1", f"with {MATCHES} select * from matches", "label_boxes detection_boxes", recursive=True)
def assign_matches(spark, d):
    return _matches(spark, d)


def _matches(spark, d):
    return matching.match_labels(inputs.labels(spark, d), inputs.detections(spark, d),
                                 inputs.images(spark, d))


_COUNTED = """
select i.image_id, coalesce(v.n, 0) as visible_label_count, coalesce(m.n, 0) as matched_label_count,
  coalesce(v.n, 0) = coalesce(m.n, 0) as all_labels_matched
from images i left join (select image_id, count(*) as n from label_boxes group by 1) v using (image_id)
left join (select image_id, count(*) as n from {m} group by 1) m using (image_id)
"""


@query("G4", f"with {MATCHES} {_COUNTED.format(m='matches')}", "images label_boxes detection_boxes",
       recursive=True)
def reconcile(spark, d):
    return matching.reconcile(inputs.labels(spark, d), inputs.detections(spark, d), inputs.images(spark, d))


@query("J4", f"""with {MATCHES}
select image_id, label_index, status from label_boxes l where not exists (
  select 1 from matches m where m.image_id = l.image_id and m.label_index = l.label_index)""",
       "label_boxes detection_boxes", recursive=True)
def unmatched_labels(spark, d):
    return matching.unmatched_labels(inputs.labels(spark, d), _matches(spark, d)).select(
        "image_id", "label_index", "status")


@query("J5", f"""with {MATCHES}
select image_id, det_index, value from detection_boxes l where not exists (
  select 1 from matches m where m.image_id = l.image_id and m.det_index = l.det_index)""",
       "label_boxes detection_boxes", recursive=True)
def unassigned_detections(spark, d):
    return matching.unassigned_detections(inputs.detections(spark, d), _matches(spark, d)).select(
        "image_id", "det_index", "value")


RECOVERY = f"""{MATCHES},
tried as (select image_id, count(*) as labels_tried from label_boxes l where not exists (
  select 1 from matches m where m.image_id = l.image_id and m.label_index = l.label_index) group by 1),
second as (select image_id, det_index + 4611686018427387904 as det_index, value, format, x1, y1, x2, y2
  from recovery_detections where image_id in (select image_id from tried)),
all_dets as (select image_id, det_index, value, format, x1, y1, x2, y2 from detection_boxes
  union all select * from second),
{CANDIDATES.replace('DETS', 'all_dets').replace('cand as', 'cand2 as')},
redo_cand as (select * from cand2 where image_id in (select image_id from tried)),
{greedy_cte('redo', 'redo_cand')},
final as (select * from matches where image_id not in (select image_id from tried)
  union all select * from redo)"""


@query("G5", f"""with {RECOVERY}
select c.*, t.labels_tried is not null as recovery_attempted, coalesce(t.labels_tried, 0) as labels_tried,
  coalesce(s.n, 0) as barcodes_found,
  case when t.labels_tried is null then 0 else c.matched_label_count - coalesce(b.n, 0) end as labels_resolved
from ({_COUNTED.format(m='final')}) c left join tried t using (image_id)
left join (select image_id, count(*) as n from second group by 1) s using (image_id)
left join (select image_id, count(*) as n from matches group by 1) b using (image_id)""",
       "images label_boxes detection_boxes recovery_detections", recursive=True)
def reconcile_with_recovery(spark, d):
    return matching.reconcile_with_recovery(
        inputs.labels(spark, d), inputs.detections(spark, d), inputs.recovery_detections(spark, d),
        inputs.images(spark, d))


@query("Q4", f"""with {MATCHES}
select image_id, label_index as index, count(*) as uses, 'label_index' as side from matches
group by 1, 2 having count(*) > 1
union all select image_id, det_index, count(*), 'det_index' from matches group by 1, 2 having count(*) > 1""",
       "label_boxes detection_boxes", recursive=True)
def match_conflicts(spark, d):
    return matching.match_conflicts(_matches(spark, d))


@query("J11", r"""
select image_id, proposal_id from proposals p where not exists (
  select 1 from detection_boxes b where b.image_id = p.image_id
    and regexp_full_match(b.value, '[0-9]{12,}')
    and (b.x1 + b.x2) / 2e0 between p.x1 and p.x2 and (b.y1 + b.y2) / 2e0 between p.y1 and p.y2)""",
       "proposals detection_boxes")
def uncovered_boxes(spark, d):
    return matching.uncovered_boxes(inputs.proposals(spark, d), inputs.detections(spark, d)).select(
        "image_id", "proposal_id")


# --- de-duplication ----------------------------------------------------------

def keep_cte(name: str, rows: str, order: str, fields: str, conflict: str) -> str:
    """Ordered greedy selection: one step per rank, the kept rows in a list."""
    pack = ", ".join(f"'{f}': {f}" for f in fields.split())
    return f"""
{name}_seq as (select image_id, row_number() over (partition by image_id order by {order}) as n,
  {{{pack}}} as c from {rows}),
{name}_walk as (
  select image_id, n, [c] as kept, true as hit from {name}_seq where n = 1
  union all
  select s.image_id, s.n,
    case when len(list_filter(w.kept, lambda m: {conflict})) > 0 then w.kept else list_append(w.kept, s.c) end,
    len(list_filter(w.kept, lambda m: {conflict})) = 0
  from {name}_walk w join {name}_seq s on s.image_id = w.image_id and s.n = w.n + 1),
{name} as (select s.image_id, unnest(s.c) from {name}_seq s
  join {name}_walk w on w.image_id = s.image_id and w.n = s.n and w.hit)
"""


def _iou_sql(e: int) -> str:
    """IoU of ``m`` and ``s.c``, both grown by ``e`` pixels on each side."""
    s = (f"(greatest(0, least(m.x2, s.c.x2) - greatest(m.x1, s.c.x1) + {2 * e})"
         f" * greatest(0, least(m.y2, s.c.y2) - greatest(m.y1, s.c.y1) + {2 * e}) * 1e0)")
    a, b = (f"((x.x2 - x.x1 + {2 * e}) * (x.y2 - x.y1 + {2 * e}))".replace("x.", r) for r in ("m.", "s.c."))
    a = f"((m.x2 - m.x1 + {2 * e}) * (m.y2 - m.y1 + {2 * e}))"
    b = f"((s.c.x2 - s.c.x1 + {2 * e}) * (s.c.y2 - s.c.y1 + {2 * e}))"
    return f"({s} / ({a} + {b} - {s}))"


_DX = "abs((m.x1 + m.x2) / 2e0 - (s.c.x1 + s.c.x2) / 2e0)"
_DY = "abs((m.y1 + m.y2) / 2e0 - (s.c.y1 + s.c.y2) / 2e0)"
_REACH = "greatest(40e0, greatest(m.x2 - m.x1, m.y2 - m.y1, s.c.x2 - s.c.x1, s.c.y2 - s.c.y1, 1) * 0.35e0)"
_SAME_READING = f"""m.format = s.c.format and (
  (m.value = s.c.value and (({_DX} <= {_REACH} and {_DY} <= {_REACH}) or {_iou_sql(20)} >= 0.20e0))
  or (m.value <> s.c.value and {_DX} <= 15 and {_DY} <= 15))"""
DEDUP = keep_cte("kept", "raw_detections", "(x2 - x1) * (y2 - y1) desc, ord",
                 "ord value format x1 y1 x2 y2", _SAME_READING)


@query("G2", f"with {DEDUP} select * from kept", "raw_detections", recursive=True)
def dedup_detections(spark, d):
    return flat(dedup.dedup_detections(inputs.raw_detections(spark, d)))


#: photos laid side by side on one sheet, and the pixels from one to the next
SHEET, APART = 256, 4000


def on_sheets(df: DataFrame) -> DataFrame:
    """Lay photos out on sheets, so far apart that none meets another: crowded photos of known content."""
    spot = F.col("image_id") % SHEET
    x, y = (spot % 16).cast("int") * APART, F.floor(spot / 16).cast("int") * APART
    return df.withColumns({"box": g.box(F.col("box.x1") + x, F.col("box.y1") + y, F.col("box.x2") + x, F.col("box.y2") + y),
                           "image_id": F.floor(F.col("image_id") / SHEET).cast("long")})


def sheet_sql(rows: str, columns: str) -> str:
    moved = ", ".join(f"cast({c} + image_id % {SHEET} {'% 16' if c[0] == 'x' else '// 16'} * {APART} as int) as {c}"
                      for c in ("x1", "y1", "x2", "y2"))
    return f"select image_id // {SHEET} as image_id, {columns}, {moved} from {rows}"


@query("G2", f"with {DEDUP} {sheet_sql('kept', 'ord, value, format')}", "raw_detections", recursive=True)
def dedup_crowded(spark, d):
    return flat(dedup.dedup_detections(on_sheets(inputs.raw_detections(spark, d))))


@query("L6", "select image_id, det_index, y1, x1 from detection_boxes", "detection_boxes")
def reading_order(spark, d):
    return flat(dedup.reading_order(inputs.detections(spark, d)).select("image_id", "det_index", "box")
                ).select("image_id", "det_index", "y1", "x1")


_SHARED = """(greatest(0, least(m.x2, s.c.x2) - greatest(m.x1, s.c.x1))
  * greatest(0, least(m.y2, s.c.y2) - greatest(m.y1, s.c.y1)) * 1e0)"""
_OVERLAPS = f"""{_iou_sql(0)} >= 0.35e0
  or {_SHARED} / ((m.x2 - m.x1) * (m.y2 - m.y1)) >= 0.75e0
  or {_SHARED} / ((s.c.x2 - s.c.x1) * (s.c.y2 - s.c.y1)) >= 0.75e0"""
SCORED = """
scored as (select image_id, proposal_id, x1, y1, x2, y2,
  rectangularity * 2 + white_ratio + least(cast((x2 - x1) * (y2 - y1) as double) / 12000000 / 0.02e0, 1.5e0) as score
from proposals
where (x2 - x1) * (y2 - y1) between 12000000 * 0.003e0 and 12000000 * 0.10e0
  and least(x2 - x1, y2 - y1) >= 105
  and greatest(x2 - x1, y2 - y1) / (least(x2 - x1, y2 - y1) * 1e0) between 1.05e0 and 4.5e0
  and rectangularity >= 0.35e0 and white_ratio >= 0.32e0)"""
SUPPRESSED = f"""{SCORED}, {keep_cte('clear_boxes', 'scored', 'score desc, proposal_id',
                                     'proposal_id score x1 y1 x2 y2', _OVERLAPS)}"""


@query("G3", f"with {SUPPRESSED} select * from clear_boxes", "proposals", recursive=True)
def suppress_overlaps(spark, d):
    return flat(prop.clear_proposals(inputs.proposals(spark, d), inputs.images(spark, d)))


@query("G3", f"with {SUPPRESSED} {sheet_sql('clear_boxes', 'proposal_id, score')}", "proposals", recursive=True)
def suppress_crowded(spark, d):
    scored = prop.score_proposals(inputs.proposals(spark, d), inputs.images(spark, d))
    # Written once: sheets are counted, measured and laid out from these few rows, and not from the join that scores them.
    return flat(prop.suppress_overlaps(on_sheets(cut_lineage(scored.select("image_id", "proposal_id", "score", "box")))))


@query("L7", f"""with {SCORED}
select image_id, proposal_id, score from scored
qualify row_number() over (partition by image_id order by score desc, proposal_id) <= 2""", "proposals")
def top_proposals(spark, d):
    scored = prop.score_proposals(inputs.proposals(spark, d), inputs.images(spark, d))
    return prop.top_proposals(scored, 2).select("image_id", "proposal_id", "score")


@query("G6 P13 L6 L7", f"""with {SUPPRESSED},
best as (select * from clear_boxes),
padded as (select image_id, proposal_id, score,
  {_box('', 'greatest(0, x1 - round_even((x2 - x1) * 0.12e0, 0))', 'greatest(0, y1 - round_even((y2 - y1) * 0.12e0, 0))',
        'least(3000, x2 + round_even((x2 - x1) * 0.12e0, 0))', 'least(4000, y2 + round_even((y2 - y1) * 0.12e0, 0))')} from best)
select *, cast(row_number() over (partition by image_id order by y1, x1, score desc, proposal_id) as int) as read_no
from padded""", "proposals", recursive=True)
def rank_label_proposals(spark, d):
    return flat(prop.rank_label_proposals(inputs.proposals(spark, d), inputs.images(spark, d)))


# --- regions to decode -------------------------------------------------------

@query("E5", """
with slots as (
  select 'regular' as kind, r::int as tile_row, c::int as tile_column, 0e0 as s from range(4) a(r), range(3) b(c)
  union all select 'shifted', r::int, c::int, 0.5e0 from range(3) a(r), range(2) b(c)),
cores as (select image_id, image_width, image_height, kind, tile_row, tile_column,
  (tile_column + s) * (image_width / 3e0) as x1, (tile_row + s) * (image_height / 4e0) as y1,
  image_width / 3e0 as cw, image_height / 4e0 as ch
  from (select image_id, image_width + cast(image_id % 700 as int) as image_width,
    image_height + cast(image_id % 900 as int) as image_height from images) i, slots)
select image_id, image_width, image_height, kind, tile_row, tile_column,
  cast(greatest(0, round_even(x1 - cw * 0.12e0, 0)) as int) as x1,
  cast(greatest(0, round_even(y1 - ch * 0.12e0, 0)) as int) as y1,
  cast(least(image_width, round_even(x1 + cw + cw * 0.12e0, 0)) as int) as x2,
  cast(least(image_height, round_even(y1 + ch + ch * 0.12e0, 0)) as int) as y2
from cores""", "images")
def plan_tiles(spark, d):
    sized = inputs.images(spark, d).select(
        "image_id", (F.col("image_width") + F.col("image_id") % 700).cast("int").alias("image_width"),
        (F.col("image_height") + F.col("image_id") % 900).cast("int").alias("image_height"))
    return flat(crops.plan_tiles(sized))


@query("E6", f"""with {MATCHES},
open_labels as (select l.image_id, l.label_index, coalesce(bx1, lx1) as x1, coalesce(by1, ly1) as y1,
  coalesce(bx2, lx2) as x2, coalesce(by2, ly2) as y2 from label_boxes l where not exists (
  select 1 from matches m where m.image_id = l.image_id and m.label_index = l.label_index))
select image_id, label_index,
  {_box('', 'greatest(0, x1 - greatest(20, round_even((x2 - x1) * 0.20e0, 0)))',
        'greatest(0, y1 - greatest(20, round_even((y2 - y1) * 0.20e0, 0)))',
        'least(3000, x2 + greatest(20, round_even((x2 - x1) * 0.20e0, 0)))',
        'least(4000, y2 + greatest(20, round_even((y2 - y1) * 0.20e0, 0)))')} from open_labels""",
       "label_boxes detection_boxes", recursive=True)
def plan_recovery_crops(spark, d):
    open_labels = matching.unmatched_labels(inputs.labels(spark, d), _matches(spark, d))
    return flat(crops.plan_recovery_crops(open_labels, inputs.images(spark, d)))


@query("E7", r"""
with f as (select crop_id, min(attempt_no) filter (regexp_full_match(value, '[0-9]{12,}')) as first_success
  from decode_attempts group by 1)
select a.*, first_success is null as unresolved from decode_attempts a join f using (crop_id)
where first_success is null or attempt_no <= first_success""", "decode_attempts")
def fold_decode_attempts(spark, d):
    return crops.fold_decode_attempts(build(spark, d, "decode_attempts"))


def _axis_sql(name: str, c: str, k: int) -> str:
    """k-means of one axis, a row per round; the state stops changing once it has settled or failed."""
    return f"""
{name}_start as (
  select image_id, list_sort(list_transform(points, lambda p: p.{c})) as vs from gap_points),
{name}_walk as (
  select image_id, vs, 0 as round, [{", ".join(f"vs[1 + cast(round_even({i} * (len(vs) - 1) / {max(k - 1, 1)}e0, 0) as int)]" for i in range(k))}] as cs,
    true as ok, true as moving from {name}_start
  union all
  select image_id, vs, round + 1, case when whole then means else cs end, whole,
    whole and len(list_filter(list_zip(means, cs), lambda z: abs(z[1] - z[2]) >= 0.5)) > 0
  from (
    select *, len(list_filter(means, lambda m: m is null)) = 0 as whole from (
      select *, list_transform(range(1, {k + 1}), lambda g: list_sum(list_filter(vs, lambda v: g = list_position(
          list_transform(cs, lambda c: abs(v - c)), list_min(list_transform(cs, lambda c: abs(v - c)))))) /
        nullif(len(list_filter(vs, lambda v: g = list_position(
          list_transform(cs, lambda c: abs(v - c)), list_min(list_transform(cs, lambda c: abs(v - c)))))), 0)) as means
      from {name}_walk where moving and round < 30) s) t),
{name} as (select image_id, list_sort(cs) as cs, list_filter(list_transform(range(1, {k}),
    lambda i: list_sort(cs)[i + 1] - list_sort(cs)[i]), lambda d: d > 0) as gaps
  from {name}_walk where ok qualify row_number() over (partition by image_id order by round desc) = 1
    and image_id not in (select image_id from {name}_walk where not ok))"""


@query("G7", f"""with gap_points as (
  select image_id, list({{'x': (x1 + x2) / 2e0, 'y': (y1 + y2) / 2e0}}) as points from detection_boxes
  where regexp_full_match(value, '[0-9]{{12,}}') group by 1 having count(*) between 4 and 11),
{_axis_sql('gap_x', 'x', 3)}, {_axis_sql('gap_y', 'y', 4)},
grid as (
  select p.image_id, points, x.cs as cx, y.cs as cy, coalesce(list_aggregate(x.gaps, 'median'), 3000 / 3e0) as dx,
    coalesce(list_aggregate(y.gaps, 'median'), 4000 / 4e0) as dy
  from gap_points p join gap_x x using (image_id) join gap_y y using (image_id)),
cells as (select *, cell // 3 as r, cell % 3 as c from grid, range(12) q(cell)
  where cell not in (select 3 * (list_position(list_transform(cy, lambda k: abs(pt.y - k)), list_min(list_transform(cy, lambda k: abs(pt.y - k)))) - 1)
    + list_position(list_transform(cx, lambda k: abs(pt.x - k)), list_min(list_transform(cx, lambda k: abs(pt.x - k)))) - 1
    from (select unnest(points) as pt) u))
select image_id, cast(r as int) as grid_row, cast(c as int) as grid_column,
  {_box('', 'greatest(0, round_even(cx[c + 1] - dx / 2, 0))', 'greatest(0, round_even(cy[r + 1] - dy / 2, 0))',
        'least(3000, round_even(cx[c + 1] + dx / 2, 0))', 'least(4000, round_even(cy[r + 1] + dy / 2, 0))')}
from cells""", "detection_boxes", recursive=True)
def infer_grid_gaps(spark, d):
    return flat(crops.infer_grid_gaps(inputs.detections(spark, d), inputs.images(spark, d)))
