"""Queries: tiles, bands, patches, stitching and pixel losses."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from maskquery.functions import scalars as S
from maskquery.operators import metrics as M
from maskquery.operators import rasters as RS
from maskquery.plans.registry import query
from maskquery.plans.scoring import rounded
from maskquery.plans.views import table, view
from maskquery.session import shared_dir


def tiles(spark, sf):
    """Each embedding vector as an 8 x 8 one-channel tile in three bands of a mosaic: itself, inverted, and shifted."""
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * 127.5 + 127.5))
    bands = F.array(v, F.transform(v, lambda x: 255 - x), F.transform(v, lambda x: (x + 85) % 256))
    t = table(spark, sf, "embeddings").select("vec_id", F.posexplode(bands).alias("i", "vals"))
    return t.select(
        F.floor(F.col("vec_id") / 25).cast("int").alias("section_id"),
        F.concat(F.lit("b"), F.col("i").cast("string")).alias("band"),
        (F.floor(F.col("vec_id") % 25 / 5) * 8).cast("int").alias("y0"),
        (F.col("vec_id") % 5 * 8).cast("int").alias("x0"),
        F.lit(8).alias("h"),
        F.lit(8).alias("w"),
        F.lit(1).alias("channels"),
        RS.pack_u8("vals").alias("data"),
    )


@query("a20_to_long", "SELECT section_id, band, 0 AS channel, y, x, v FROM fx_mosaic")
def a20_to_long(spark, sf):
    return RS.to_long(tiles(spark, sf))


@query("a21_read_window", "SELECT section_id, band, y - 5 AS y, x - 3 AS x, v FROM fx_mosaic WHERE x >= 3 AND x < 21 AND y >= 5 AND y < 30")
def a21_read_window(spark, sf):
    return RS.to_long(RS.read_window(tiles(spark, sf), 3, 5, 21, 30)).drop("channel")


@query("c10_align_bands", "SELECT DISTINCT section_id, y - y % 8 AS y0, x - x % 8 AS x0, band FROM fx_mosaic")
def c10_align_bands(spark, sf):
    return RS.align_bands(tiles(spark, sf), 3).select("section_id", "y0", "x0", "band")


@query(
    "c10_misaligned",
    """SELECT section_id, y0, x0, COUNT(*) AS bands FROM (SELECT DISTINCT section_id, y - y % 8 AS y0, x - x % 8 AS x0, band FROM fx_mosaic
 WHERE NOT (band = 'b1' AND (section_id + y // 8 + x // 8) % 7 = 0)) GROUP BY ALL HAVING COUNT(*) <> 3""",
)
def c10_misaligned(spark, sf):
    """The offending positions once some tiles of a band are taken out."""
    gap = (F.col("band") == "b1") & ((F.col("section_id") + F.col("y0") / 8 + F.col("x0") / 8) % 7 == 0)
    return RS.misaligned(tiles(spark, sf).where(~gap), 3).select("section_id", "y0", "x0", "bands")


ORDERED = """bl AS (SELECT section_id, y, x, MAX(CASE WHEN band = 'b0' THEN v END) AS b0, MAX(CASE WHEN band = 'b1' THEN v END) AS b1,
 MAX(CASE WHEN band = 'b2' THEN v END) AS b2 FROM fx_mosaic GROUP BY section_id, y, x)"""


def f32(v):
    return f"(CAST(1 AS FLOAT) - CAST({v} AS FLOAT) / CAST(255 AS FLOAT))"


@query(
    "d21_screen_blend",
    f"""WITH {ORDERED} SELECT section_id, y, x, CAST(TRUNC(LEAST(GREATEST((CAST(1 AS FLOAT) - {f32('b0')} * {f32('b1')} * {f32('b2')})
 * CAST(255 AS FLOAT), 0), 255)) AS INT) AS v FROM bl""",
)
def d21_screen_blend(spark, sf):
    return RS.to_long(RS.screen_blend(RS.align_bands(tiles(spark, sf), 3))).select("section_id", "y", "x", "v")


@query("d22_stack_channels", f"WITH {ORDERED} SELECT section_id, y, x, b0, b1, b2 FROM bl")
def d22_stack_channels(spark, sf):
    px = RS.to_long(RS.stack_channels(RS.align_bands(tiles(spark, sf), 3)))
    at = lambda c: F.max(F.when(F.col("channel") == c, F.col("v"))).alias(f"b{c}")
    return px.groupBy("section_id", "y", "x").agg(at(0), at(1), at(2))


@query(
    "d22_split_channels",
    f"""WITH {ORDERED} SELECT section_id, 'stack_000' AS band, 0 AS channel, y, x, b0 AS v FROM bl
UNION ALL SELECT section_id, 'stack_000', 1, y, x, b1 FROM bl UNION ALL SELECT section_id, 'stack_000', 2, y, x, b2 FROM bl""",
)
def d22_split_channels(spark, sf):
    return RS.to_long(RS.split_channels(RS.stack_channels(RS.align_bands(tiles(spark, sf), 3))))


def mosaic_patches(spark, sf):
    """Patches of 12 px at stride 10 over the 40 x 40 mosaic sections, as regions of 20 px."""
    from maskquery.operators import tiling as T

    sections = tiles(spark, sf).select("section_id").distinct().select("section_id", F.lit(40).alias("height"), F.lit(40).alias("width"))
    return T.patch_grid(T.regions(sections, 20), 12, 10)


PATCH_PX = """st AS (SELECT * FROM (VALUES (0), (8)) v(d)),
 pg AS (SELECT DISTINCT m.section_id, CAST(r.ry / 20 * 2 + r.rx / 20 AS INT) AS region_idx, ry + a.d AS y0, rx + b.d AS x0 FROM fx_mosaic m,
  (SELECT * FROM (VALUES (0, 0), (0, 20), (20, 0), (20, 20)) v(ry, rx)) r, st a, st b),
 pp AS (SELECT pg.*, CAST(UNNEST(RANGE(12)) AS INT) AS dy FROM pg), pq AS (SELECT pp.*, CAST(UNNEST(RANGE(12)) AS INT) AS dx FROM pp)"""


@query(
    "j5_extract_patches",
    f"""WITH {PATCH_PX}, bd AS (SELECT DISTINCT section_id, m.band, y0, x0 FROM pg JOIN (SELECT DISTINCT section_id, band FROM fx_mosaic) m USING (section_id))
SELECT bd.section_id, bd.band, PRINTF('region_%04d_y%05d_x%05d', region_idx, pq.y0, pq.x0) AS stem, dy AS y, dx AS x, COALESCE(m.v, 0) AS v
FROM bd JOIN pq ON pq.section_id = bd.section_id AND pq.y0 = bd.y0 AND pq.x0 = bd.x0
LEFT JOIN fx_mosaic m ON m.section_id = bd.section_id AND m.band = bd.band AND m.y = pq.y0 + dy AND m.x = pq.x0 + dx""",
)
def j5_extract_patches(spark, sf):
    got = RS.extract_patches(tiles(spark, sf), mosaic_patches(spark, sf), 12, 8)
    named = got.select("section_id", F.concat_ws("|", "band", "stem").alias("band"), F.lit(0).alias("y0"), F.lit(0).alias("x0"), "h", "w", "channels", "data")
    px = RS.to_long(named)
    parts = F.split("band", r"\|")
    return px.select("section_id", parts[0].alias("band"), parts[1].alias("stem"), "y", "x", "v")


@query(
    "c13_crop_patch_masks",
    f"""WITH {PATCH_PX}, bn AS (SELECT DISTINCT section_id, band FROM fx_mosaic)
SELECT pq.section_id, bn.band, PRINTF('region_%04d_y%05d_x%05d', region_idx, pq.y0, pq.x0) AS stem, CAST(SUM(COALESCE(m.v, 0)) AS BIGINT) AS total
FROM pq JOIN bn USING (section_id) LEFT JOIN fx_mosaic m ON m.section_id = pq.section_id AND m.band = bn.band AND m.y = pq.y0 + dy AND m.x = pq.x0 + dx
GROUP BY ALL""",
)
def c13_crop_patch_masks(spark, sf):
    from maskquery.operators import tiling as T

    stems = mosaic_patches(spark, sf).select("section_id", "stem", F.lit(40).alias("height"), F.lit(40).alias("width"))
    bounds = T.patch_bounds(stems, 20, 12)
    got = RS.extract_patches(tiles(spark, sf), bounds, 12, 8)
    named = got.select("section_id", F.concat_ws("|", "band", "stem").alias("band"), F.lit(0).alias("y0"), F.lit(0).alias("x0"), "h", "w", "channels", "data")
    parts = F.split("band", r"\|")
    return RS.to_long(named).groupBy("section_id", parts[0].alias("band"), parts[1].alias("stem")).agg(F.sum("v").alias("total"))


@query("b1_clip_u8", "SELECT l_orderkey, l_partkey, l_extendedprice, CAST(TRUNC(LEAST(GREATEST(l_quantity * 7 - 60, 0), 255)) AS INT) AS v FROM lineitem")
def b1_clip_u8(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", S.clip_u8(F.col("l_quantity") * 7 - 60).alias("v"))


@query("b3_to_unit_float", "SELECT section_id, band, y, x, ROUND(CAST(CAST(CAST(v AS FLOAT) / CAST(255 AS FLOAT) AS FLOAT) AS DOUBLE), 6) AS f FROM fx_mosaic")
def b3_to_unit_float(spark, sf):
    px = RS.to_long(tiles(spark, sf))
    return px.select("section_id", "band", "y", "x", F.round(S.to_unit_float(F.col("v")).cast("double"), 6).alias("f"))


@query(
    "c15_overlay_pixels",
    """SELECT section_id, band, y, x, CAST(TRUNC(CASE WHEN v > 130 THEN 0.45e0 * v + 0.55e0 * ((37 * ((x + y) % 7 + 1)) % 255) ELSE v END) AS INT) AS r,
 CAST(TRUNC(CASE WHEN v > 130 THEN 0.45e0 * v + 0.55e0 * ((97 * ((x + y) % 7 + 1)) % 255) ELSE v END) AS INT) AS g,
 CAST(TRUNC(CASE WHEN v > 130 THEN 0.45e0 * v + 0.55e0 * ((173 * ((x + y) % 7 + 1)) % 255) ELSE v END) AS INT) AS b FROM fx_mosaic""",
)
def c15_overlay_pixels(spark, sf):
    px = RS.to_long(tiles(spark, sf))
    labels = px.where("v > 130").select("section_id", "band", "y", "x", ((F.col("x") + F.col("y")) % 7 + 1).alias("label"))
    return RS.overlay_pixels(px, labels)


HANN = "(0.5e0 - 0.5e0 * COS(({d}) * 2.0943951023931953e0))"
STITCHED = f"""sp AS (SELECT sample_id, y, x, cls, SUM(p * w) / SUM(w) AS p FROM (SELECT *, GREATEST({HANN.format(d='y - y0')} * {HANN.format(d='x - x0')}, 1e-4) AS w
 FROM fx_probs) GROUP BY sample_id, y, x, cls)"""


@query("d19_stitch_predictions", f"WITH {STITCHED} SELECT sample_id, y, x, cls, ROUND(p, 8) AS p FROM sp")
def d19_stitch_predictions(spark, sf):
    return rounded(RS.stitch_predictions(view(spark, sf, "fx_probs"), 4), ["sample_id", "y", "x", "cls"], 8)


# ties are broken on probabilities rounded alike on both sides
@query(
    "d20_argmax_class",
    f"""WITH {STITCHED} SELECT sample_id, y, x, cls FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY sample_id, y, x
 ORDER BY ROUND(p, 8) DESC, cls) AS r FROM sp) WHERE r = 1""",
)
def d20_argmax_class(spark, sf):
    return RS.argmax_class(d19_stitch_predictions(spark, sf))


LOSS = f"""{STITCHED}, ar AS (SELECT sample_id, y, x, LIST(p ORDER BY cls) AS p FROM sp GROUP BY sample_id, y, x),
 lb AS (SELECT vec_id AS sample_id, y, x, v % 3 AS cls FROM fx_tile_px)"""


@query(
    "d23_weighted_cross_entropy",
    f"""WITH {LOSS} SELECT sample_id, ROUND(AVG((CASE cls WHEN 0 THEN 0.6e0 WHEN 1 THEN 1.0e0 ELSE 5.0e0 END)
 * (LN(EXP(p[1]) + EXP(p[2]) + EXP(p[3])) - p[cls + 1])), 8) AS loss FROM ar JOIN lb USING (sample_id, y, x) GROUP BY sample_id""",
)
def d23_weighted_cross_entropy(spark, sf):
    p = RS.stitch_predictions(view(spark, sf, "fx_probs"), 4).groupBy("sample_id", "y", "x").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("cls", "p"))), lambda e: e["p"]).alias("p")
    )
    j = p.join(pixel_labels(spark, sf), ["sample_id", "y", "x"])
    return j.groupBy("sample_id").agg(F.round(F.avg(M.weighted_cross_entropy()), 8).alias("loss"))


def pixel_labels(spark, sf):
    return view(spark, sf, "fx_tile_px").select(F.col("vec_id").alias("sample_id"), "y", "x", (F.col("v") % 3).alias("cls"))


@query(
    "d24_accuracy",
    f"""WITH {LOSS}, pr AS (SELECT sample_id, y, x, cls FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY sample_id, y, x ORDER BY ROUND(p, 8) DESC, cls) AS r FROM sp) WHERE r = 1)
SELECT sample_id, ROUND(AVG(CASE WHEN pr.cls = lb.cls THEN 1.0e0 ELSE 0.0e0 END), 8) AS accuracy FROM pr JOIN lb USING (sample_id, y, x) GROUP BY sample_id""",
)
def d24_accuracy(spark, sf):
    pred = d20_argmax_class(spark, sf).withColumnRenamed("cls", "pred")
    j = pred.join(pixel_labels(spark, sf), ["sample_id", "y", "x"])
    return j.groupBy("sample_id").agg(F.round(F.avg((F.col("pred") == F.col("cls")).cast("double")), 8).alias("accuracy"))


@query(
    "j10_one_hot",
    """SELECT vec_id AS sample_id, y, x, CASE WHEN v % 3 = 0 THEN 1.0e0 ELSE 0.0e0 END AS c0, CASE WHEN v % 3 = 1 THEN 1.0e0 ELSE 0.0e0 END AS c1,
 CASE WHEN v % 3 = 2 THEN 1.0e0 ELSE 0.0e0 END AS c2 FROM fx_tile_px""",
)
def j10_one_hot(spark, sf):
    hot = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda c: (c == F.col("cls")).cast("double"))
    return pixel_labels(spark, sf).select("sample_id", "y", "x", hot.alias("h")).select("sample_id", "y", "x", *[F.col("h")[i].alias(f"c{i}") for i in range(3)])


def unit(name):
    return f"(CAST(('0x' || SUBSTRING(MD5(CONCAT(CAST(vec_id AS STRING), '_7_{name}')), 1, 7)) AS BIGINT) / 268435456.0e0)"


@query(
    "j11_augment",
    f"""WITH d AS (SELECT DISTINCT vec_id, {unit('lr')} AS lr, {unit('ud')} AS ud, {unit('rot')} AS rot, {unit('bright')} AS br, {unit('contrast')} AS ct FROM fx_tile_px),
 a AS (SELECT t.vec_id, v % 3 AS label, CAST(v AS DOUBLE) / 255.0e0 + (br * 0.4e0 - 0.2e0) AS f, CASE WHEN ud < 0.5e0 THEN 7 - y ELSE y END AS y,
  CASE WHEN lr < 0.5e0 THEN 7 - x ELSE x END AS x, CAST(FLOOR(rot * 4) AS INT) AS k, ct FROM fx_tile_px t JOIN d USING (vec_id)),
 r AS (SELECT vec_id, label, f, ct, CASE k WHEN 0 THEN y WHEN 1 THEN 7 - x WHEN 2 THEN 7 - y ELSE x END AS y,
  CASE k WHEN 0 THEN x WHEN 1 THEN y WHEN 2 THEN 7 - x ELSE 7 - y END AS x, AVG(f) OVER (PARTITION BY vec_id) AS m FROM a)
SELECT vec_id, y, x, ROUND(LEAST(GREATEST((f - m) * (0.8e0 + ct * 0.4e0) + m, 0), 1), 6) AS f, label FROM r""",
)
def j11_augment(spark, sf):
    px = F.transform("embedding", lambda v: F.floor(v.cast("double") * 127.5 + 127.5).cast("int"))
    p = table(spark, sf, "embeddings").select(
        "vec_id", F.lit(8).alias("size"), F.transform(px, lambda v: v / 255.0).alias("image"), F.transform(px, lambda v: v % 3).alias("label")
    )
    out = RS.augment(p, "vec_id", 7).select("vec_id", F.posexplode(F.arrays_zip("image", "label")).alias("i", "e"))
    return out.select(
        "vec_id", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), F.round("e.image", 6).alias("f"), F.col("e.label").alias("label")
    )


def linear_model():
    """A stand-in model: class c scores 0.1 c + 0.5 value per pixel."""
    import numpy as np

    def predict(batch):
        x = np.asarray(batch)
        return np.concatenate([0.5 * x + 0.1 * c for c in range(3)], axis=1)

    return predict


@query(
    "l1_score_windows",
    "SELECT vec_id, c.cls, y, x, ROUND(0.5e0 * v / 255.0e0 + 0.1e0 * c.cls, 6) AS p FROM fx_tile_px, (SELECT * FROM (VALUES (0), (1), (2)) v(cls)) c",
)
def l1_score_windows(spark, sf):
    px = F.transform("embedding", lambda v: F.floor(v.cast("double") * 127.5 + 127.5) / 255.0)
    win = table(spark, sf, "embeddings").select("vec_id", F.lit(0).alias("y0"), F.lit(0).alias("x0"), px.alias("image"))
    return RS.score_windows(win, linear_model, 64, 8, 3).select("vec_id", "cls", "y", "x", F.round("p", 6).alias("p"))


def scratch(spark) -> str:
    return f"{shared_dir(spark)}/out-{uuid.uuid4().hex}"


@query("a23_write_tiles", "SELECT section_id, band, y, x, v FROM fx_mosaic")
def a23_write_tiles(spark, sf):
    path = scratch(spark)
    RS.write_tiles(tiles(spark, sf), path, "image")
    return RS.to_long(spark.read.parquet(path).where("kind = 'image'")).drop("channel")


@query(
    "a16_write_patch_dataset",
    """WITH v AS (SELECT vec_id, CASE WHEN label < 2 THEN 'val' ELSE 'train' END AS split FROM embeddings) SELECT split, vec_id FROM v""",
)
def a16_write_patch_dataset(spark, sf):
    path = scratch(spark)
    p = table(spark, sf, "embeddings").select("vec_id", F.when(F.col("label") < 2, "val").otherwise("train").alias("split"))
    RS.write_patch_dataset(p, path)
    RS.write_patch_dataset(p.where("split = 'val'"), path)  # a rewrite of one split keeps the other
    return spark.read.parquet(path).select("split", "vec_id")
