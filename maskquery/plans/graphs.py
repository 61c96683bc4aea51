"""Queries: connected components, mask merging, suppression and AJI."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskquery.operators import graph as G
from maskquery.operators import metrics as M
from maskquery.operators import runs as R
from maskquery.plans.registry import query
from maskquery.plans.scoring import PAIR_AREAS, dt_strips, scored_inputs
from maskquery.plans.views import view

CC = """cc(sample_id, id, comp) USING KEY (sample_id, id) AS (
 SELECT sample_id, id, id FROM nodes
 UNION
 SELECT e.sample_id, e.b, MIN(c.comp) FROM cc c JOIN edges e ON e.sample_id = c.sample_id AND e.a = c.id
 JOIN recurring.cc r ON r.sample_id = e.sample_id AND r.id = e.b WHERE c.comp < r.comp GROUP BY e.sample_id, e.b)
"""

DT_NODES = """nodes AS (SELECT sample_id, inst_id AS id FROM fx_dt_area)"""
BOTH_WAYS = """edges AS (SELECT sample_id, a_id AS a, b_id AS b FROM prs UNION ALL SELECT sample_id, b_id, a_id FROM prs)"""


@query(
    "i1_connected_components",
    f"""WITH RECURSIVE prs AS (SELECT sample_id, a_id, b_id FROM fx_dt_overlap), {DT_NODES}, {BOTH_WAYS}, {CC}
SELECT sample_id, id AS inst_id, comp AS group_id FROM cc""",
)
def i1_connected_components(spark, sf):
    runs = dt_strips(spark, sf)
    return G.mask_groups(R.mask_areas(runs), R.overlap_pixels(runs))


@query(
    "f5_sort_components",
    f"""WITH RECURSIVE prs AS (SELECT sample_id, a_id, b_id FROM fx_dt_overlap), {DT_NODES}, {BOTH_WAYS}, {CC}
SELECT sample_id, comp AS group_id, COUNT(*) AS members FROM cc GROUP BY sample_id, comp HAVING COUNT(*) >= 2
ORDER BY sample_id, comp""",
)
def f5_sort_components(spark, sf):
    sizes = i1_connected_components(spark, sf).groupBy("sample_id", "group_id").agg(F.count(F.lit(1)).alias("members"))
    return sizes.where("members >= 2").orderBy("sample_id", "group_id")


@query(
    "i2_merge_overlapping",
    f"""WITH RECURSIVE prs AS (SELECT o.sample_id, o.a_id, o.b_id {PAIR_AREAS}
   WHERE CAST(o.inter AS DOUBLE) / LEAST(a.area, b.area) >= 0.5e0),
 {DT_NODES}, {BOTH_WAYS}, {CC},
 px AS (SELECT DISTINCT p.sample_id, c.comp, p.y, p.x FROM fx_pix p JOIN cc c ON c.sample_id = p.sample_id AND c.id = p.inst_id
   WHERE p.side = 'dt'),
 n AS (SELECT sample_id, comp, COUNT(*) AS members FROM cc GROUP BY sample_id, comp)
SELECT px.sample_id, px.comp AS group_id, n.members, COUNT(*) AS area, MIN(x) AS min_x, MIN(y) AS min_y,
 MAX(x) + 1 AS max_x, MAX(y) + 1 AS max_y
FROM px JOIN n ON n.sample_id = px.sample_id AND n.comp = px.comp GROUP BY px.sample_id, px.comp, n.members""",
)
def i2_merge_overlapping(spark, sf):
    _, stats = G.merge_overlapping(dt_strips(spark, sf), 0.5)
    return stats.select("sample_id", "group_id", "members", "area", "min_x", "min_y", "max_x", "max_y")


@query(
    "d18_union_masks",
    """WITH g AS (SELECT sample_id, CAST(FLOOR((inst_id - 1) / 2.0e0) AS INT) AS group_id, inst_id, y, x FROM fx_pix
  WHERE side = 'dt'),
 m AS (SELECT sample_id, group_id, COUNT(DISTINCT inst_id) AS members, MIN(inst_id) AS first_id FROM g GROUP BY 1, 2),
 u AS (SELECT DISTINCT sample_id, group_id, y, x FROM g)
SELECT sample_id, group_id, COUNT(*) AS area, MIN(x) AS min_x, MIN(y) AS min_y, MAX(x) + 1 AS max_x, MAX(y) + 1 AS max_y,
 first_id, members FROM u JOIN m USING (sample_id, group_id) GROUP BY sample_id, group_id, first_id, members""",
)
def d18_union_masks(spark, sf):
    runs = dt_strips(spark, sf)
    pair = F.floor((F.col("inst_id") - 1) / 2).cast("int").alias("group_id")
    groups = view(spark, sf, "fx_cboxes").where("side = 'dt'").select("sample_id", "inst_id", pair)
    return R.union_masks(runs, groups)[1]


@query(
    "i3_label_components",
    """WITH RECURSIVE r AS (SELECT sample_id, y, x0, x1, y * 1048576 + x0 AS id FROM fx_semruns WHERE cls = 1),
 nodes AS (SELECT sample_id, id FROM r),
 e0 AS (SELECT a.sample_id, a.id AS a, b.id AS b FROM r a JOIN r b ON a.sample_id = b.sample_id AND b.y = a.y + 1
   AND a.x0 < b.x1 AND b.x0 < a.x1),
 edges AS (SELECT * FROM e0 UNION ALL SELECT sample_id, b, a FROM e0),
"""
    + CC
    + """SELECT r.sample_id, CAST(DENSE_RANK() OVER (PARTITION BY r.sample_id ORDER BY comp) AS INT) AS inst_id,
 CAST(SUM(x1 - x0) AS BIGINT) AS area, MIN(x0) AS min_x, MIN(y) AS min_y
FROM r JOIN cc ON cc.sample_id = r.sample_id AND cc.id = r.id GROUP BY r.sample_id, comp""",
)
def i3_label_components(spark, sf):
    labels = G.label_components(semantic_runs(spark, sf, 1), connectivity=1)
    return labels.groupBy("sample_id", "inst_id").agg(
        F.sum(F.col("x1") - F.col("x0")).cast("long").alias("area"), F.min("x0").alias("min_x"), F.min("y").alias("min_y")
    )


def semantic_runs(spark, sf, cls: int | None = None):
    """Semantic raster as cell-cut class runs: boundary boxes with their interiors painted last."""
    strips = view(spark, sf, "fx_paint").withColumnRenamed("y0", "y")
    rank = F.struct(F.col("pass").alias("p"), F.col("cls").alias("c"))
    sem = R.paint(strips.where("x1 > x0"), "cls", rank)
    return sem if cls is None else sem.where(F.col("cls") == cls)


NMS_EDGES = f"""ov AS (SELECT o.sample_id, o.a_id, o.b_id, CAST(COALESCE(a.score, 0) AS FLOAT) AS sa,
   CAST(COALESCE(b.score, 0) AS FLOAT) AS sb, CAST(o.inter AS DOUBLE) / (a.area + b.area - o.inter) AS iou {PAIR_AREAS}),
 e AS (SELECT sample_id, CASE WHEN (sa, a_id) > (sb, b_id) THEN a_id ELSE b_id END AS hi,
   CASE WHEN (sa, a_id) > (sb, b_id) THEN b_id ELSE a_id END AS lo FROM ov WHERE iou > 0.1e0),
 st(sample_id, id, keep) USING KEY (sample_id, id) AS (
  SELECT a.sample_id, a.inst_id, TRUE FROM fx_dt_area a WHERE NOT EXISTS
    (SELECT 1 FROM e WHERE e.sample_id = a.sample_id AND e.lo = a.inst_id)
  UNION
  SELECT e.sample_id, e.lo, NOT BOOL_OR(COALESCE(h.keep, FALSE))
  FROM e LEFT JOIN recurring.st h ON h.sample_id = e.sample_id AND h.id = e.hi
  WHERE (SELECT COUNT(*) FROM st) > 0 AND NOT EXISTS
    (SELECT 1 FROM recurring.st d WHERE d.sample_id = e.sample_id AND d.id = e.lo)
  GROUP BY e.sample_id, e.lo HAVING BOOL_OR(COALESCE(h.keep, FALSE)) OR COUNT(*) = COUNT(h.id))"""


@query("i4_nms", f"WITH RECURSIVE {NMS_EDGES} SELECT sample_id, id AS inst_id FROM st WHERE keep")
def i4_nms(spark, sf):
    masks = view(spark, sf, "fx_cboxes").where("side = 'dt'").select("sample_id", "inst_id", "score")
    return G.nms(masks, dt_strips(spark, sf), 0.1).select("sample_id", "inst_id")


# best first, a mask is dropped if a kept one of its class covers enough of the smaller of both; it joins the best kept one that does
GREEDY = """WITH RECURSIVE sc AS (SELECT sample_id, inst_id, CAST(COALESCE(score, 0) AS FLOAT) AS s FROM fx_cboxes WHERE side = 'dt'),
 e AS MATERIALIZED (SELECT o.sample_id, CASE WHEN (p.s, a_id) > (q.s, b_id) THEN a_id ELSE b_id END AS hi, CASE WHEN (p.s, a_id) > (q.s, b_id) THEN b_id ELSE a_id END AS lo, GREATEST(p.s, q.s) AS s
  FROM fx_dt_overlap o JOIN fx_dt_area a ON a.sample_id = o.sample_id AND a.inst_id = o.a_id JOIN fx_dt_area b ON b.sample_id = o.sample_id AND b.inst_id = o.b_id
  JOIN sc p ON p.sample_id = o.sample_id AND p.inst_id = o.a_id JOIN sc q ON q.sample_id = o.sample_id AND q.inst_id = o.b_id
  WHERE CAST(o.inter AS DOUBLE) / LEAST(a.area, b.area) >= 0.2e0 AND a_id % 2 = b_id % 2),
 st(sample_id, p, kept, turn) USING KEY (sample_id, p) AS (
  SELECT sample_id, inst_id AS p, TRUE AS kept, 1 AS turn FROM sc WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.sample_id = sc.sample_id AND e.lo = sc.inst_id)
  UNION
  (WITH op AS (SELECT e.* FROM e WHERE (SELECT COUNT(*) FROM st) > 0 AND NOT EXISTS (SELECT 1 FROM recurring.st s WHERE s.sample_id = e.sample_id AND s.p = e.lo))
   SELECT op.sample_id, op.lo AS p, NOT bool_or(coalesce(s.kept, FALSE)) AS kept, 2 AS turn
   FROM op LEFT JOIN recurring.st s ON s.sample_id = op.sample_id AND s.p = op.hi GROUP BY op.sample_id, op.lo
   HAVING bool_or(coalesce(s.kept, FALSE)) OR bool_and(s.p IS NOT NULL))),
 gr AS (SELECT sample_id, p AS inst_id, p AS group_id FROM st WHERE kept
  UNION ALL SELECT e.sample_id, e.lo AS inst_id, ARG_MAX(e.hi, (e.s, e.hi)) AS group_id FROM e JOIN st h ON h.sample_id = e.sample_id AND h.p = e.hi AND h.kept GROUP BY e.sample_id, e.lo),
 px AS (SELECT DISTINCT sample_id, group_id, y, x FROM fx_pix JOIN gr USING (sample_id, inst_id) WHERE side = 'dt'),
 n AS (SELECT sample_id, group_id, MIN(inst_id) AS first_id, COUNT(*) AS members FROM gr GROUP BY sample_id, group_id)
SELECT sample_id, group_id, COUNT(*) AS area, MIN(x) AS min_x, MIN(y) AS min_y, MAX(x) + 1 AS max_x, MAX(y) + 1 AS max_y, ANY_VALUE(first_id) AS first_id, ANY_VALUE(members) AS members
FROM px JOIN n USING (sample_id, group_id) GROUP BY sample_id, group_id"""


@query("i5_greedy_merge", GREEDY)
def i5_greedy_merge(spark, sf):
    boxes = view(spark, sf, "fx_cboxes").where("side = 'dt'")
    masks = boxes.select("sample_id", "inst_id", "score", (F.col("inst_id") % 2).alias("category_id"))
    return G.greedy_merge(masks, dt_strips(spark, sf), 0.2)[1]


AJI_SQL = """WITH RECURSIVE live AS (SELECT * FROM fx_iou),
 st(sample_id, gt_id, dt_id, inter) USING KEY (sample_id, gt_id) AS (
  SELECT CAST(-1 AS INT), CAST(-1 AS INT), CAST(-1 AS INT), CAST(0 AS BIGINT)
  UNION
  (WITH op AS (SELECT l.* FROM live l
     WHERE (SELECT COUNT(*) FROM st) > 0
      AND NOT EXISTS (SELECT 1 FROM recurring.st s WHERE s.sample_id = l.sample_id AND s.gt_id = l.gt_id)
      AND NOT EXISTS (SELECT 1 FROM recurring.st s WHERE s.sample_id = l.sample_id AND s.dt_id = l.dt_id)),
    b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY sample_id, gt_id ORDER BY iou DESC, dt_id) AS r,
      MIN(gt_id) OVER (PARTITION BY sample_id, dt_id) AS first_gt FROM op)
   SELECT sample_id, gt_id, dt_id, inter FROM b WHERE r = 1 AND gt_id = first_gt)),
 m AS (SELECT sample_id, SUM(inter) AS mi FROM st WHERE sample_id >= 0 GROUP BY sample_id),
 t AS (SELECT sample_id, SUM(area) AS tot FROM fx_areas GROUP BY sample_id)
SELECT t.sample_id, CAST(COALESCE(m.mi, 0) AS BIGINT) AS aji_num, CAST(t.tot - COALESCE(m.mi, 0) AS BIGINT) AS aji_den,
 ROUND(CAST(COALESCE(m.mi, 0) AS DOUBLE) / CAST(t.tot - COALESCE(m.mi, 0) AS DOUBLE), 9) AS aji
FROM t LEFT JOIN m USING (sample_id)"""


@query("d7_aji", AJI_SQL)
def d7_aji(spark, sf):
    out = M.aji(*scored_inputs(spark, sf))
    return out.select("sample_id", "aji_num", "aji_den", F.round("aji", 9).alias("aji"))
