"""Derived views: segmentation-shaped inputs computed from the given tables, for Spark and for plain SQL.

Every view reads its whole table. Samples are ranges of order keys, so their number grows with the data
while one sample keeps a fixed frame of 448 x 512 pixels.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()

FRAME_H = 448
FRAME_W = 512

# Text both dialects understand.
COMMON = {
    # every line of an order is a grain of its own, numbered within its sample
    "fx_grains": """
 SELECT CAST(FLOOR(l_orderkey / 512.0e0) AS INT) AS sample_id,
        CAST(ROW_NUMBER() OVER (PARTITION BY FLOOR(l_orderkey / 512.0e0)
         ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INT) AS inst_id,
        CAST(l_suppkey AS INT) AS sk, CAST(l_quantity AS INT) AS q,
        l_discount AS disc, CAST(FLOOR(l_extendedprice) AS BIGINT) AS price
 FROM lineitem""",
    # grains spread over a grid of 56 x 64 cells with a pitch of 8 px
    "fx_cells": """
 SELECT sample_id, inst_id, sk, q, disc, price,
        CAST(FLOOR((inst_id - 1) * 3584.0e0 / COUNT(*) OVER (PARTITION BY sample_id)) AS INT) AS cell
 FROM fx_grains""",
    "fx_placed": """
 SELECT sample_id, inst_id, sk, q, disc, price,
        CAST((cell % 64) * 8 + 1 AS INT) AS x0,
        CAST(FLOOR(cell / 64.0e0) * 8 + 1 AS INT) AS y0,
        CAST(3 + q % 10 AS INT) AS w, CAST(3 + sk % 10 AS INT) AS h
 FROM fx_cells""",
    "fx_boxes": """
 SELECT sample_id, 'gt' AS side, inst_id, x0, y0, w, h, CAST(NULL AS DOUBLE) AS score FROM fx_placed
 UNION ALL
 SELECT sample_id, 'dt' AS side, inst_id, CAST(x0 + sk % 5 - 2 AS INT) AS x0, CAST(y0 + q % 5 - 2 AS INT) AS y0,
        w, h, CASE WHEN q = 50 THEN NULL ELSE CAST(price % 1009 AS DOUBLE) / 1009.0e0 END AS score
 FROM fx_placed WHERE disc >= 0.01e0""",
    "fx_frames": f"""
 SELECT DISTINCT sample_id, {FRAME_H} AS height, {FRAME_W} AS width FROM fx_grains""",
    # boxes cut to the frame, half-open bounds
    "fx_cboxes": f"""
 SELECT sample_id, side, inst_id, score, GREATEST(x0, 0) AS x0, GREATEST(y0, 0) AS y0,
        LEAST(x0 + w, {FRAME_W}) AS x1, LEAST(y0 + h, {FRAME_H}) AS y1
 FROM fx_boxes WHERE LEAST(x0 + w, {FRAME_W}) > GREATEST(x0, 0) AND LEAST(y0 + h, {FRAME_H}) > GREATEST(y0, 0)""",
    # semantic paint jobs: whole box as boundary (2), box shrunk by 1 px as interior (1), interior painted last
    "fx_paint": """
 SELECT sample_id, 2 AS cls, 1 AS pass, x0, y0, x1, y1 FROM fx_cboxes WHERE side = 'gt'
 UNION ALL
 SELECT sample_id, 1 AS cls, 2 AS pass, x0 + 1 AS x0, y0 + 1 AS y0, x1 - 1 AS x1, y1 - 1 AS y1
 FROM fx_cboxes WHERE side = 'gt' AND x1 - x0 > 2 AND y1 - y0 > 2""",
    # mosaic of 8 x 8 tiles: each vector in three bands, sections of 5 x 5 tiles
    "fx_mosaic": """
 SELECT CAST(FLOOR(vec_id / 25.0e0) AS INT) AS section_id, b.band,
   CAST(y + 8 * FLOOR(CAST(vec_id AS INT) % 25 / 5.0e0) AS INT) AS y, CAST(x + 8 * (CAST(vec_id AS INT) % 5) AS INT) AS x,
   CAST(CASE b.band WHEN 'b0' THEN v WHEN 'b1' THEN 255 - v ELSE (v + 85) % 256 END AS INT) AS v
 FROM fx_tile_px, (SELECT * FROM (VALUES ('b0'), ('b1'), ('b2')) w(band)) b""",
    "fx_trials": """
 SELECT CONCAT('run_', CAST(user_id AS STRING)) AS run,
   CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) AS INT) AS iteration,
   0.0006e0 + CAST((event_id * 37) % 191 AS DOUBLE) / 100000.0e0 AS lr0,
   CAST((event_id * 53) % 51 AS DOUBLE) / 100.0e0 + 0.1e0 AS dropout,
   CASE WHEN event_type = 'signup' THEN CAST('NaN' AS DOUBLE) ELSE value / 500.0e0 END AS fitness
 FROM events""",
    "fx_log_lines": """
 SELECT CONCAT('run_', CAST(user_id AS STRING)) AS run, event_id AS line_no,
   CASE WHEN event_type = 'error'
    THEN CONCAT('W0000 Unable to register cuDNN factory ', CAST(event_id AS STRING))
    ELSE CONCAT('step 40 of 40 (12 min) - accuracy: 0.', LPAD(CAST((event_id * 7) % 10000 AS STRING), 4, '0'),
     ' - loss: 0.', LPAD(CAST((event_id * 11) % 10000 AS STRING), 4, '0'),
     ' - val_accuracy: 0.', LPAD(CAST((event_id * 13) % 10000 AS STRING), 4, '0'),
     ' - val_loss: 0.', LPAD(CAST((event_id * 17) % 10000 AS STRING), 4, '0'),
     ' - rate: 0.002') END AS line
 FROM events""",
    # one section per customer
    "fx_sections": """
 SELECT CAST(c_custkey AS INT) AS section_id, CAST(3000 + (c_custkey * 37) % 4001 AS INT) AS height,
        CAST(3500 + (c_custkey * 53) % 5003 AS INT) AS width FROM customer""",
    "fx_coverage": """
 SELECT CAST(p_partkey AS BIGINT) AS region_idx, CAST((p_partkey * 37) % 101 AS DOUBLE) / 100.0e0 AS cov FROM part""",
    # one metric row per order, grouped into model variants by customer nation
    "fx_metric_rows": """
 SELECT CAST(o_orderkey AS BIGINT) AS sample_id, CONCAT('variant_', CAST(o_custkey % 25 AS STRING)) AS variant,
   CASE WHEN o_orderpriority = '5-LOW' AND o_orderkey % 11 = 0 THEN CAST('NaN' AS DOUBLE)
        ELSE CAST((o_orderkey * 37) % 1000 AS DOUBLE) / 1000.0e0 END AS aji,
   CAST((o_orderkey * 53) % 1000 AS DOUBLE) / 1000.0e0 AS f1_iou50,
   CAST((o_orderkey * 71) % 1000 AS DOUBLE) / 1000.0e0 AS f1_iou75,
   CAST((o_orderkey * 89) % 1000 AS DOUBLE) / 1000.0e0 AS mf1_iou50_95
 FROM orders""",
}

SPARK = {
    # the same grains and boxes in one shuffle of lineitem: both windows share a key, and both sides come from one pass
    "fx_grains": """
 SELECT sample_id, CAST(ROW_NUMBER() OVER (PARTITION BY sample_id
         ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INT) AS inst_id,
        CAST(l_suppkey AS INT) AS sk, CAST(l_quantity AS INT) AS q,
        l_discount AS disc, CAST(FLOOR(l_extendedprice) AS BIGINT) AS price
 FROM (SELECT CAST(FLOOR(l_orderkey / 512.0e0) AS INT) AS sample_id, l_orderkey, l_linenumber, l_partkey, l_suppkey,
        l_quantity, l_extendedprice, l_discount FROM lineitem)""",
    "fx_boxes": """
 SELECT sample_id, side, inst_id, CASE WHEN side = 'gt' THEN x0 ELSE CAST(x0 + sk % 5 - 2 AS INT) END AS x0,
        CASE WHEN side = 'gt' THEN y0 ELSE CAST(y0 + q % 5 - 2 AS INT) END AS y0, w, h,
        CASE WHEN side = 'gt' OR q = 50 THEN NULL ELSE CAST(price % 1009 AS DOUBLE) / 1009.0e0 END AS score
 FROM fx_placed LATERAL VIEW explode(array('gt', 'dt')) t AS side WHERE side = 'gt' OR disc >= 0.01e0""",
    # image and mask files of one section per customer
    "fx_files": """
 SELECT path, CAST(c_custkey AS BIGINT) AS pos FROM customer LATERAL VIEW explode(array(
   CONCAT('/d/img/', c_name, '_PPL', CASE WHEN c_nationkey % 2 = 0 THEN '.tif' ELSE '.TIFF' END),
   CONCAT('/d/img/', c_name, '_PPX1', CASE WHEN c_nationkey % 2 = 0 THEN '.tif' ELSE '.TIFF' END),
   CONCAT('/d/mask/', c_name, '_labels', CASE WHEN c_acctbal > 0 THEN '.tif' ELSE '.txt' END),
   CONCAT('/d/mask/', c_name, '_labels.tiff'))) t AS path""",
    # three class scores for 4 x 4 windows at stride 2 over every tile
    "fx_probs": """
 SELECT vec_id AS sample_id, y0, x0, y, x, cls, CAST((v + y0 * 7 + x0 * 13 + cls * 29) % 100 AS DOUBLE) / 100.0e0 AS p
 FROM fx_tile_px LATERAL VIEW explode(array(0, 2, 4)) a AS y0 LATERAL VIEW explode(array(0, 2, 4)) b AS x0
  LATERAL VIEW explode(array(0, 1, 2)) c AS cls
 WHERE y >= y0 AND y < y0 + 4 AND x >= x0 AND x < x0 + 4""",
    "fx_runs": """
 SELECT sample_id, side, inst_id, score, y, x0, x1 FROM fx_cboxes LATERAL VIEW explode(sequence(y0, y1 - 1)) t AS y""",
    "fx_tile_px": """
 SELECT vec_id, label, CAST(FLOOR(p / 8.0e0) AS INT) AS y, p % 8 AS x,
   CAST(FLOOR(CAST(v AS DOUBLE) * 127.5e0 + 127.5e0) AS INT) AS v
 FROM embeddings LATERAL VIEW posexplode(embedding) t AS p, v""",
}

DUCK = {
    "fx_files": """
 SELECT UNNEST([CONCAT('/d/img/', c_name, '_PPL', CASE WHEN c_nationkey % 2 = 0 THEN '.tif' ELSE '.TIFF' END),
   CONCAT('/d/img/', c_name, '_PPX1', CASE WHEN c_nationkey % 2 = 0 THEN '.tif' ELSE '.TIFF' END),
   CONCAT('/d/mask/', c_name, '_labels', CASE WHEN c_acctbal > 0 THEN '.tif' ELSE '.txt' END),
   CONCAT('/d/mask/', c_name, '_labels.tiff')]) AS path, CAST(c_custkey AS BIGINT) AS pos FROM customer""",
    # three class scores for 4 x 4 windows at stride 2 over every tile
    "fx_probs": """
 SELECT t.vec_id AS sample_id, w.y0, w.x0, t.y, t.x, c.cls,
   CAST((t.v + w.y0 * 7 + w.x0 * 13 + c.cls * 29) % 100 AS DOUBLE) / 100.0e0 AS p
 FROM fx_tile_px t JOIN fx_wins w ON t.y >= w.y0 AND t.y < w.y0 + 4 AND t.x >= w.x0 AND t.x < w.x0 + 4
 JOIN (SELECT * FROM (VALUES (0), (1), (2)) v(cls)) c ON c.cls >= 0""",
    "fx_wins": """
 SELECT * FROM (VALUES (0, 0), (0, 2), (0, 4), (2, 0), (2, 2), (2, 4), (4, 0), (4, 2), (4, 4)) v(y0, x0)""",
    "fx_runs": """
 SELECT sample_id, side, inst_id, score, CAST(UNNEST(RANGE(y0, y1)) AS INT) AS y, x0, x1 FROM fx_cboxes""",
    "fx_pix": """
 SELECT sample_id, side, inst_id, score, y, CAST(UNNEST(RANGE(x0, x1)) AS INT) AS x FROM fx_runs""",
    "fx_labels": """
 SELECT sample_id, side, y, x, MAX(inst_id) AS inst_id FROM fx_pix GROUP BY sample_id, side, y, x""",
    "fx_sem": """
 SELECT sample_id, y, x, CASE MAX(pass) WHEN 2 THEN 1 ELSE 2 END AS cls
 FROM (SELECT sample_id, pass, y, CAST(UNNEST(RANGE(x0, x1)) AS INT) AS x
       FROM (SELECT sample_id, pass, x0, x1, CAST(UNNEST(RANGE(y0, y1)) AS INT) AS y FROM fx_paint))
 GROUP BY sample_id, y, x""",
    # maximal class runs of the semantic raster
    "fx_semruns": """
 SELECT sample_id, cls, y, MIN(x) AS x0, MAX(x) + 1 AS x1
 FROM (SELECT sample_id, cls, y, x,
              x - ROW_NUMBER() OVER (PARTITION BY sample_id, cls, y ORDER BY x) AS isl FROM fx_sem)
 GROUP BY sample_id, cls, y, isl""",
    "fx_pairs": """
 SELECT g.sample_id, g.inst_id AS gt_id, d.inst_id AS dt_id, COUNT(*) AS inter
 FROM (SELECT * FROM fx_labels WHERE side = 'gt') g
 JOIN (SELECT * FROM fx_labels WHERE side = 'dt') d USING (sample_id, y, x)
 GROUP BY g.sample_id, g.inst_id, d.inst_id""",
    "fx_areas": """
 SELECT sample_id, side, inst_id, COUNT(*) AS area FROM fx_labels GROUP BY sample_id, side, inst_id""",
    "fx_iou": """
 SELECT p.sample_id, p.gt_id, p.dt_id, p.inter, g.area AS gt_area, d.area AS dt_area,
   CAST(p.inter AS DOUBLE) / CAST(g.area + d.area - p.inter AS DOUBLE) AS iou
 FROM fx_pairs p
 JOIN fx_areas g ON g.side = 'gt' AND g.sample_id = p.sample_id AND g.inst_id = p.gt_id
 JOIN fx_areas d ON d.side = 'dt' AND d.sample_id = p.sample_id AND d.inst_id = p.dt_id""",
    # overlap of whole (unpainted) detections
    "fx_dt_overlap": """
 SELECT a.sample_id, a.inst_id AS a_id, b.inst_id AS b_id, CAST(SUM(LEAST(a.x1, b.x1) - GREATEST(a.x0, b.x0)) AS BIGINT) AS inter
 FROM fx_runs a JOIN fx_runs b ON a.side = 'dt' AND b.side = 'dt' AND a.sample_id = b.sample_id AND a.y = b.y
  AND a.inst_id < b.inst_id AND a.x0 < b.x1 AND b.x0 < a.x1
 GROUP BY a.sample_id, a.inst_id, b.inst_id""",
    "fx_dt_area": """
 SELECT sample_id, inst_id, score, CAST((x1 - x0) * (y1 - y0) AS BIGINT) AS area FROM fx_cboxes WHERE side = 'dt'""",
    "fx_tile_px": """
 SELECT vec_id, label, CAST(FLOOR(p / 8.0e0) AS INT) AS y, CAST(p % 8 AS INT) AS x,
   CAST(FLOOR(CAST(v AS DOUBLE) * 127.5e0 + 127.5e0) AS INT) AS v
 FROM (SELECT vec_id, label, UNNEST(embedding) AS v, UNNEST(RANGE(64)) AS p FROM embeddings)""",
    # the ten sweep thresholds, as the accumulated doubles
    "fx_thresholds": """
 SELECT * FROM (VALUES (0.5e0), (0.55e0), (0.6000000000000001e0), (0.6500000000000001e0), (0.7000000000000002e0),
  (0.7500000000000002e0), (0.8000000000000003e0), (0.8500000000000003e0), (0.9000000000000004e0),
  (0.9500000000000004e0)) v(thr)""",
}

_NAME = re.compile(r"\bfx_\w+")


def _with(sql: str, views: dict[str, str]) -> str:
    order: list[str] = []

    def need(text: str) -> None:
        for name in _NAME.findall(text):
            if name in views and name not in order:
                need(views[name])
                order.append(name)

    need(sql)
    body = sql.strip()
    ctes = [f"{n} AS ({views[n]})" for n in order]
    if body.upper().startswith("WITH RECURSIVE "):
        head, body = "WITH RECURSIVE ", body[len("WITH RECURSIVE ") :]
    elif body.upper().startswith("WITH "):
        head, body = "WITH ", body[len("WITH ") :]
    elif ctes:
        return "WITH " + ",\n".join(ctes) + "\n" + body
    else:
        return body
    return head + "".join(c + ",\n" for c in ctes) + body


def duck_sql(sql: str) -> str:
    """SQL text with the definitions of all views it uses in front."""
    return _with(sql, {**COMMON, **DUCK})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql_or_name: str) -> DataFrame:
    """A derived view (or a SELECT over derived views) as a DataFrame."""
    sql = sql_or_name if " " in sql_or_name.strip() else f"SELECT * FROM {sql_or_name}"
    text = _with(sql, {**COMMON, **SPARK})
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text)
