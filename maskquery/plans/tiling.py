"""Queries: names and bounds, regions, patches, windows and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskquery.functions import scalars as S
from maskquery.operators import split as SP
from maskquery.operators import tiling as T
from maskquery.plans.graphs import semantic_runs
from maskquery.plans.registry import query
from maskquery.plans.views import table, view

STARTS = "(CASE WHEN {s} <= {p} THEN [0] ELSE LIST_SORT(LIST_DISTINCT(LIST_CONCAT(RANGE(0, {s} - {p} + 1, {t}), [{s} - {p}]))) END)"


def duck_starts(size, patch, stride):
    return STARTS.format(s=size, p=patch, t=stride)


@query("j1_starts", f"SELECT section_id, CAST(UNNEST({duck_starts('height', 1024, 512)}) AS INT) AS y0 FROM fx_sections")
def j1_starts(spark, sf):
    return view(spark, sf, "fx_sections").select("section_id", F.explode(S.starts(F.col("height"), 1024, 512)).alias("y0"))


REGIONS = """rg AS (SELECT section_id, height, width, y0, LEAST(y0 + 2048, height) AS y1, x0, LEAST(x0 + 2048, width) AS x1,
  CAST(y0 / 2048 * CEIL(width / 2048.0e0) + x0 / 2048 AS INT) AS region_idx
 FROM (SELECT *, CAST(UNNEST(RANGE(0, width, 2048)) AS INT) AS x0
       FROM (SELECT *, CAST(UNNEST(RANGE(0, height, 2048)) AS INT) AS y0 FROM fx_sections)))"""


@query("j2_regions", f"WITH {REGIONS} SELECT section_id, region_idx, y0, y1, x0, x1 FROM rg")
def j2_regions(spark, sf):
    return T.regions(view(spark, sf, "fx_sections"), 2048)


PATCHES = f"""{REGIONS}, pt AS (SELECT section_id, region_idx, height, width, y0 + dy AS y0, LEAST(y0 + dy + 1024, y1) AS y1, x0 + dx AS x0,
  LEAST(x0 + dx + 1024, x1) AS x1, PRINTF('region_%04d_y%05d_x%05d', region_idx, y0 + dy, x0 + dx) AS stem
 FROM (SELECT *, CAST(UNNEST({duck_starts('x1 - x0', 1024, 1024)}) AS INT) AS dx
       FROM (SELECT *, CAST(UNNEST({duck_starts('y1 - y0', 1024, 1024)}) AS INT) AS dy FROM rg)))"""


@query("j3_patch_grid", f"WITH {PATCHES} SELECT section_id, region_idx, y0, y1, x0, x1, stem FROM pt")
def j3_patch_grid(spark, sf):
    return T.patch_grid(j2_regions(spark, sf), 1024, 1024)


@query("j4_patch_bounds", f"WITH {PATCHES} SELECT section_id, stem, y0, y1, x0, x1 FROM pt")
def j4_patch_bounds(spark, sf):
    stems = j3_patch_grid(spark, sf).select("section_id", "stem").join(view(spark, sf, "fx_sections"), "section_id")
    return T.patch_bounds(stems, 2048, 1024).select("section_id", "stem", "y0", "y1", "x0", "x1")


@query("b20_parse_stem", f"WITH {PATCHES} SELECT section_id, region_idx, y0, x0 FROM pt")
def b20_parse_stem(spark, sf):
    p = j3_patch_grid(spark, sf).select("section_id", S.parse_stem(F.col("stem")).alias("p"))
    return p.select("section_id", "p.region_idx", "p.y0", "p.x0")


@query(
    "b20_origin_or_zero",
    """WITH n AS (SELECT c_name AS name FROM customer UNION ALL
  SELECT PRINTF('region_%04d_y%05d_x%05d', c_custkey, c_custkey * 3, c_custkey * 5) FROM customer)
SELECT name, COALESCE(TRY_CAST(REGEXP_EXTRACT(name, '^region_(\\d+)_y(\\d+)_x(\\d+)$', 2) AS INT), 0) AS y0,
 COALESCE(TRY_CAST(REGEXP_EXTRACT(name, '^region_(\\d+)_y(\\d+)_x(\\d+)$', 3) AS INT), 0) AS x0 FROM n""",
)
def b20_origin_or_zero(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    names = c.select(F.col("c_name").alias("name")).unionByName(c.select(S.format_stem(k, k * 3, k * 5).alias("name")))
    p = names.select("name", S.parse_stem(F.col("name"), lenient=True).alias("p"))
    return p.select("name", "p.y0", "p.x0")


@query(
    "j6_stride_from_overlap",
    """SELECT p_partkey, CAST(ROUND_EVEN((512 + p_size) * (1.0e0 - CAST(p_partkey % 91 AS DOUBLE) / 100.0e0), 0) AS INT) AS rounded,
 CAST(TRUNC((512 + p_size) * (1.0e0 - CAST(p_partkey % 91 AS DOUBLE) / 100.0e0)) AS INT) AS truncated FROM part""",
)
def j6_stride_from_overlap(spark, sf):
    patch = (F.lit(512) + F.col("p_size")).cast("double")
    overlap = (F.col("p_partkey") % 91).cast("double") / 100.0
    return table(spark, sf, "part").select(
        "p_partkey", S.stride_rounded(patch, overlap).alias("rounded"), S.stride_truncated(patch, overlap).alias("truncated")
    )


@query(
    "j15_sliding_windows",
    f"""SELECT section_id, y0, y0 + 2048 AS y1, x0, x0 + 2048 AS x1
FROM (SELECT *, CAST(UNNEST({duck_starts('width', 2048, 1024)}) AS INT) AS x0
      FROM (SELECT *, CAST(UNNEST({duck_starts('height', 2048, 1024)}) AS INT) AS y0 FROM fx_sections))""",
)
def j15_sliding_windows(spark, sf):
    return T.sliding_windows(view(spark, sf, "fx_sections"), 2048, 1024)


EDGES = "(SELECT QUANTILE_CONT(cov, [0.1e0, 0.2e0, 0.3e0, 0.4e0, 0.5e0, 0.6e0, 0.7e0, 0.8e0, 0.9e0]) AS q FROM {t})"
BINNED = "LEN(LIST_FILTER(q, LAMBDA e : e < cov))"


@query(
    "j7_coverage_bins",
    f"SELECT region_idx, CAST({BINNED} AS INT) AS bin FROM fx_coverage, {EDGES.format(t='fx_coverage')}",
)
def j7_coverage_bins(spark, sf):
    return SP.coverage_bins(view(spark, sf, "fx_coverage"), 10, 5).select("region_idx", "bin")


@query(
    "d25_bin_counts",
    f"""WITH el AS (SELECT * FROM fx_coverage WHERE cov >= 0.1e0),
 b AS (SELECT CAST({BINNED} AS INT) AS bin FROM el, {EDGES.format(t='el')}),
 c AS (SELECT bin, COUNT(*) AS n FROM b GROUP BY bin),
 v AS (SELECT COUNT(*) AS n, CAST(CEIL(COUNT(*) * 0.2e0) AS BIGINT) AS vc FROM el)
SELECT c.bin, c.n, (SELECT MIN(n) FROM c) >= 2 AND (SELECT COUNT(*) FROM c) <= v.vc
 AND (SELECT COUNT(*) FROM c) <= v.n - v.vc AS stratify FROM c, v""",
)
def d25_bin_counts(spark, sf):
    el = view(spark, sf, "fx_coverage").where("cov >= 0.1")
    counts = SP.coverage_bins(el, 10, 5).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    sizes = [r["n"] for r in counts.collect()]  # one row per bin
    n = sum(sizes)
    return counts.withColumn("stratify", F.lit(SP.can_stratify(sizes, -(-n // 5), n)))


def split_sql(src: str, key: str, bins_sql: str) -> str:
    return f"""el AS (SELECT * FROM {src} WHERE cov >= 0.1e0),
 k AS (SELECT COUNT(*) AS n, LEAST(GREATEST(CAST(CEIL(COUNT(*) * 0.2e0) AS BIGINT), 1), COUNT(*) - 1) AS vc FROM el),
 b AS (SELECT el.*, {bins_sql} AS bin, MD5(CONCAT(CAST({key} AS STRING), '_42')) AS h FROM el, {EDGES.format(t='el')}),
 c AS (SELECT COUNT(*) AS nb, MIN(n) AS mn FROM (SELECT bin, COUNT(*) AS n FROM b GROUP BY bin)),
 o AS (SELECT b.*, ROW_NUMBER() OVER (ORDER BY h) AS pos, ROW_NUMBER() OVER (PARTITION BY bin ORDER BY h) AS r,
   COUNT(*) OVER (PARTITION BY bin) AS sz, MIN(h) OVER (PARTITION BY bin) AS f FROM b),
 p AS (SELECT o.*, CASE WHEN c.mn >= 2 AND c.nb <= k.vc AND c.nb <= k.n - k.vc
    THEN ROW_NUMBER() OVER (ORDER BY CASE WHEN r = 1 OR r < sz THEN 0 ELSE 1 END, CASE WHEN r = 1 OR r < sz THEN r END, f, pos)
    ELSE pos END AS pick, k.vc FROM o, c, k)"""


@query(
    "j8_stratified_split",
    f"""WITH {split_sql('fx_coverage', 'region_idx', BINNED)}
SELECT region_idx, CASE WHEN pick <= vc THEN 'val' ELSE 'train' END AS split FROM p
UNION ALL SELECT region_idx, 'train' FROM fx_coverage WHERE cov < 0.1e0""",
)
def j8_stratified_split(spark, sf):
    return SP.stratified_split(view(spark, sf, "fx_coverage"), "region_idx", 0.2, 42).select("region_idx", "split")


COVER = """gr AS (SELECT sample_id, y0, x0, CAST(y0 / 64 * 8 + x0 / 64 AS INT) AS region_idx
   FROM (SELECT *, CAST(UNNEST(RANGE(0, 512, 64)) AS INT) AS x0
         FROM (SELECT sample_id, CAST(UNNEST(RANGE(0, 448, 64)) AS INT) AS y0 FROM fx_frames))),
 hit AS (SELECT sample_id, y // 64 * 64 AS y0, x // 64 * 64 AS x0, COUNT(*) AS px FROM fx_sem GROUP BY 1, 2, 3),
 cv AS (SELECT gr.sample_id, gr.region_idx, CONCAT(CAST(gr.sample_id AS STRING), '_', CAST(gr.region_idx AS STRING)) AS rid,
   CAST(COALESCE(px, 0) AS DOUBLE) / 4096.0e0 AS cov FROM gr LEFT JOIN hit USING (sample_id, y0, x0))"""


@query("d11_raster_coverage", f"WITH {COVER} SELECT sample_id, region_idx, ROUND(cov, 9) AS cov FROM cv")
def d11_raster_coverage(spark, sf):
    cov = SP.raster_coverage(semantic_runs(spark, sf), view(spark, sf, "fx_frames"), 64)
    return cov.select("sample_id", "region_idx", F.round("cov", 9).alias("cov"))


@query(
    "j9_spatial_holdout",
    f"""WITH {COVER}, {split_sql('cv', 'rid', BINNED)}
SELECT rid, CASE WHEN pick <= vc THEN 'val' ELSE 'train' END AS split FROM p
UNION ALL SELECT rid, 'train' FROM cv WHERE cov < 0.1e0""",
)
def j9_spatial_holdout(spark, sf):
    from maskquery.session import cut_lineage

    cov = SP.raster_coverage(semantic_runs(spark, sf), view(spark, sf, "fx_frames"), 64)
    named = cov.select(F.concat_ws("_", F.col("sample_id").cast("string"), F.col("region_idx").cast("string")).alias("rid"), "cov")
    return SP.stratified_split(cut_lineage(named), "rid", 0.2, 42).select("rid", "split")


@query(
    "g1_train_set",
    f"""WITH {split_sql('fx_coverage', 'region_idx', BINNED)}, v AS (SELECT region_idx FROM p WHERE pick <= vc)
SELECT region_idx FROM (SELECT region_idx FROM el EXCEPT SELECT region_idx FROM v) UNION
SELECT region_idx FROM fx_coverage WHERE cov < 0.1e0 ORDER BY 1""",
)
def g1_train_set(spark, sf):
    cov = view(spark, sf, "fx_coverage")
    val = SP.stratified_split(cov, "region_idx", 0.2, 42).where("split = 'val'")
    pick = lambda c: cov.where(c).select("region_idx")
    return SP.train_set(pick("cov >= 0.1"), val, pick("cov < 0.1"), "region_idx").orderBy("region_idx")


@query(
    "j12_shuffle_batches",
    """SELECT region_idx, pos, (pos - 1) // 32 AS batch FROM (SELECT region_idx,
 ROW_NUMBER() OVER (ORDER BY MD5(CONCAT(CAST(region_idx AS STRING), '_3'))) AS pos FROM fx_coverage)""",
)
def j12_shuffle_batches(spark, sf):
    return T.shuffle_batches(view(spark, sf, "fx_coverage").select("region_idx"), "region_idx", 32, 3)


@query(
    "f3_sample_per_split",
    """SELECT split, o_orderkey FROM (SELECT o_orderstatus AS split, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_orderstatus
 ORDER BY MD5(CONCAT(CAST(o_orderkey AS STRING), '_3'))) AS r FROM orders) WHERE r <= 20""",
)
def f3_sample_per_split(spark, sf):
    h = table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("split"), "o_orderkey", S.seeded_hash(F.col("o_orderkey"), 3).alias("h")
    )
    from maskquery.operators.numbering import hash_numbered

    return hash_numbered(h, ["split"], "h", "r").where("r <= 20").select("split", "o_orderkey")


@query(
    "f2_head",
    "SELECT c_name AS sample_id FROM customer ORDER BY c_name LIMIT 10",
)
def f2_head(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_name").alias("sample_id")).orderBy("sample_id").limit(10)


@query(
    "f6_visualise_fraction",
    """SELECT sample_id, inst_id FROM fx_cboxes WHERE side = 'dt'
 AND CAST(('0x' || SUBSTRING(MD5(CONCAT(CAST(sample_id AS STRING), ':', CAST(inst_id AS STRING), '_3')), 1, 7)) AS BIGINT) / 268435456.0e0 < 0.1e0""",
)
def f6_visualise_fraction(spark, sf):
    """A tenth of the detections by a draw that follows from the row, so that it does not depend on partitions."""
    draw = S.hash_unit(F.concat_ws(":", "sample_id", "inst_id"), "3")
    return view(spark, sf, "fx_cboxes").where("side = 'dt'").select("sample_id", "inst_id").where(draw < 0.1)


@query(
    "b16_normalize_bbox",
    """WITH t AS (SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount * 1000 AS a, -l_quantity AS b, l_tax * 1000 AS c, -l_extendedprice AS d
 FROM lineitem)
SELECT l_orderkey, l_linenumber, l_extendedprice, LEAST(a, c) AS minx, LEAST(b, d) AS miny, GREATEST(a, c) AS maxx, GREATEST(b, d) AS maxy FROM t""",
)
def b16_normalize_bbox(spark, sf):
    t = bbox_texts(spark, sf).select("l_orderkey", "l_linenumber", "l_extendedprice", S.normalize_bbox(F.col("bbox")).alias("b"))
    return t.select("l_orderkey", "l_linenumber", "l_extendedprice", "b.*")


def bbox_texts(spark, sf):
    parts = [F.col("l_discount") * 1000, -F.col("l_quantity"), F.col("l_tax") * 1000, -F.col("l_extendedprice")]
    text = F.concat_ws(" , ", *[p.cast("string") for p in parts])
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", text.alias("bbox"))


@query(
    "b17_bbox_to_window",
    """SELECT l_orderkey, l_linenumber, l_extendedprice,
 CAST(ROUND_EVEN(l_quantity / 2, 0) AS INT) AS "left", CAST(ROUND_EVEN(-l_quantity / 4, 0) AS INT) AS top,
 CAST(ROUND_EVEN(l_quantity * 1.5e0, 0) AS INT) AS "right", CAST(ROUND_EVEN(l_extendedprice, 0) AS INT) AS bottom FROM lineitem""",
)
def b17_bbox_to_window(spark, sf):
    q = F.col("l_quantity")
    box = F.struct(
        (q / 2).alias("minx"), (-F.col("l_extendedprice")).alias("miny"), (q * 1.5).alias("maxx"), (q / 4).alias("maxy")
    )
    t = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", box.alias("b"))
    return t.select("l_orderkey", "l_linenumber", "l_extendedprice", S.bbox_to_window(F.col("b")).alias("w")).select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "w.*"
    )


@query(
    "j13_fingerprint",
    """SELECT c_custkey, SUBSTRING(SHA256(CONCAT('{"num_inputs":2,"patch_size":1024,"role":"train","samples":[{"id":"', c_name,
 '","images":["/d/', c_name, '_PPL.tif","/d/', c_name, '_PPXblend.tif"],"mask":"/d/', c_name,
 '_labels.tif"}],"schema_version":1,"stride":512}')), 1, 16) AS fp FROM customer""",
)
def j13_fingerprint(spark, sf):
    from maskquery.sources.manifests import fold_fingerprint

    name = F.col("c_name")
    path = lambda s: F.concat(F.lit("/d/"), name, F.lit(s))
    samples = table(spark, sf, "customer").select(
        "c_custkey",
        F.struct(
            name.alias("id"), F.array(path("_PPL.tif"), path("_PPXblend.tif")).alias("images"), path("_labels.tif").alias("mask")
        ).alias("s"),
    )
    return samples.select("c_custkey", fold_fingerprint(F.array("s"), "train", 1024, 512, 2).alias("fp"))


@query(
    "l4_patch_grid_udtf",
    f"""SELECT section_id, y0, LEAST(y0 + 1024, height) AS y1, x0, LEAST(x0 + 1024, width) AS x1
FROM (SELECT *, CAST(UNNEST({duck_starts('width', 1024, 1024)}) AS INT) AS x0
      FROM (SELECT *, CAST(UNNEST({duck_starts('height', 1024, 1024)}) AS INT) AS y0 FROM fx_sections))""",
)
def l4_patch_grid_udtf(spark, sf):
    from maskquery.functions.tables import register

    register(spark)
    view(spark, sf, "fx_sections").createOrReplaceTempView("sections_for_grid")
    return spark.sql("SELECT s.section_id, g.* FROM sections_for_grid s, LATERAL patch_grid(s.height, s.width, 1024, 1024) g")


@query(
    "l4_param_grid_udtf",
    """WITH m AS (SELECT * FROM (VALUES (1), (3), (5)) v(a)), e AS (SELECT * FROM (VALUES (FALSE), (TRUE)) v(b))
SELECT section_id, CAST(ROW_NUMBER() OVER (PARTITION BY section_id ORDER BY a, b) - 1 AS INT) AS grid_idx, a AS min_distance, b AS exclude_border FROM fx_sections, m, e""",
)
def l4_param_grid_udtf(spark, sf):
    from maskquery.functions.tables import register

    register(spark)
    view(spark, sf, "fx_sections").createOrReplaceTempView("sections_for_params")
    grid = """'{"min_distance": [1, 3, 5], "exclude_border": [false, true]}'"""
    return spark.sql(
        f"""SELECT s.section_id, g.grid_idx, CAST(g.params['min_distance'] AS INT) AS min_distance, CAST(g.params['exclude_border'] AS BOOLEAN) AS exclude_border
        FROM sections_for_params s, LATERAL param_grid({grid}) g"""
    )
