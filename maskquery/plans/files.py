"""Queries: file listings, manifests, dataset configs and prediction reuse."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskquery.plans.registry import query
from maskquery.plans.views import table, view
from maskquery.sources import manifests as MF

EXT = "CASE WHEN c_nationkey % 2 = 0 THEN '.tif' ELSE '.TIFF' END"


@query(
    "a1_sample_manifest",
    f"""SELECT c_name AS sample_id, CONCAT('/d/img/', c_name, '_PPL', {EXT}) AS first, CONCAT('/d/img/', c_name, '_PPX1', {EXT}) AS second,
 CONCAT('/d/mask/', c_name, '_labels', CASE WHEN c_acctbal > 0 THEN '.tif' ELSE '.tiff' END) AS mask FROM customer""",
)
def a1_sample_manifest(spark, sf):
    m = MF.sample_manifest(view(spark, sf, "fx_files"), ["_PPL", "_PPX1"], "_labels")
    return m.select("sample_id", F.col("images")[0].alias("first"), F.col("images")[1].alias("second"), "mask")


@query("a2_discover_images", "SELECT path FROM fx_files WHERE regexp_matches(path, '(?i)\\.tiff?$') ORDER BY path")
def a2_discover_images(spark, sf):
    return MF.discover_images(view(spark, sf, "fx_files"))


@query(
    "a13_read_pair_manifest",
    """SELECT c_custkey + 1 AS image_id, CASE WHEN c_nationkey = 0 THEN CONCAT('/abs/', c_name) ELSE CONCAT('/m/', c_name) END AS tiff, CONCAT('/m/', c_name, '.gpkg') AS gpkg FROM customer""",
)
def a13_read_pair_manifest(spark, sf):
    name = F.when(F.col("c_nationkey") == 0, F.concat(F.lit("/abs/"), F.col("c_name"))).otherwise(F.col("c_name"))
    odd, none = F.col("c_custkey") % 2 == 1, F.lit(None).cast("string")
    g = F.concat(F.col("c_name"), F.lit(".gpkg"))
    e = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("pos"), F.when(odd, name).otherwise(F.lit("")).alias("test_tiff"), F.when(~odd, name).alias("tiff"), g.alias("test_gpkg"), none.alias("gpkg")
    )
    return MF.pair_manifest(e, "/m")


def configs(spark, sf):
    """Three kinds of dataset roots: absolute, relative and absent; a split under images/ or elsewhere."""
    k, name = F.col("c_custkey"), F.col("c_name")
    path = F.when(k % 3 == 0, F.concat(F.lit("/abs/"), name)).when(k % 3 == 1, F.lit("data"))
    c = table(spark, sf, "customer").select(F.concat(F.lit("/cfg/"), name, F.lit("/d.yaml")).alias("config_path"), path.alias("path"), k.alias("k"))
    splits = F.when(F.col("k") % 4 == 0, F.array(F.lit("train"), F.lit("val"))).otherwise(F.array(F.lit("train"), F.lit("val"), F.lit("test")))
    s = c.select("config_path", "path", F.explode(splits).alias("split"), "k")
    return s.select("config_path", "path", "split", F.when(F.col("k") % 5 == 0, F.concat(F.lit("pics/"), "split")).otherwise(F.concat(F.lit("images/"), "split")).alias("rel"))


CONFIGS = """cf AS (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN CONCAT('/abs/', c_name) WHEN c_custkey % 3 = 1 THEN CONCAT('/cfg/', c_name, '/data') ELSE CONCAT('/cfg/', c_name) END AS root,
  UNNEST(CASE WHEN c_custkey % 4 = 0 THEN ['train', 'val'] ELSE ['train', 'val', 'test'] END) AS split FROM customer),
 ds AS (SELECT CONCAT('/cfg/', c_name, '/d.yaml') AS config_path, split, root, CONCAT(root, CASE WHEN c_custkey % 5 = 0 THEN '/pics/' ELSE '/images/' END, split) AS image_dir,
  CONCAT(root, '/labels/', split) AS label_dir, c_custkey FROM cf)"""


@query("a17_dataset_splits", f"WITH {CONFIGS} SELECT config_path, split, root, image_dir, label_dir FROM ds")
def a17_dataset_splits(spark, sf):
    return MF.dataset_splits(configs(spark, sf))


@query(
    "a18_collect_split_pairs",
    f"""WITH {CONFIGS} SELECT config_path, split, CONCAT(image_dir, '/p', '.tif') AS image, CONCAT(label_dir, '/p.txt') AS label FROM ds
WHERE split = CASE WHEN c_custkey % 4 = 0 THEN 'val' ELSE 'test' END""",
)
def a18_collect_split_pairs(spark, sf):
    splits = MF.dataset_splits(configs(spark, sf))
    files = splits.select(F.explode(F.array(F.concat("image_dir", F.lit("/p.tif")), F.concat("image_dir", F.lit("/notes.md")))).alias("path"))
    return MF.collect_split_pairs(splits, files)


@query(
    "a18_labelled_pairs",
    f"""WITH {CONFIGS} SELECT config_path, split, CONCAT(image_dir, '/p', '.tif') AS image, CONCAT(label_dir, '/p.txt') AS label FROM ds
WHERE split = CASE WHEN c_custkey % 4 = 0 THEN 'val' ELSE 'test' END AND c_custkey % 3 <> 0""",
)
def a18_labelled_pairs(spark, sf):
    splits = MF.dataset_splits(configs(spark, sf))
    images = splits.select("config_path", F.concat("image_dir", F.lit("/p.tif")).alias("path"))
    labels = splits.where(F.regexp_extract("config_path", r"(\d+)", 1).cast("int") % 3 != 0).select("config_path", F.concat("label_dir", F.lit("/p.txt")).alias("path"))
    return MF.collect_split_pairs(splits, images.unionByName(labels).select("path"), labelled=True)


@query("c16_missing", "SELECT CONCAT('/d/mask/', c_name, '_labels.tif') AS path FROM customer WHERE c_acctbal <= 0")
def c16_missing(spark, sf):
    want = table(spark, sf, "customer").select(F.concat(F.lit("/d/mask/"), F.col("c_name"), F.lit("_labels.tif")).alias("path"))
    return MF.missing(want, "path", view(spark, sf, "fx_files"))


@query("c16_existing", "SELECT CONCAT('/d/mask/', c_name, '_labels.tif') AS path FROM customer WHERE c_acctbal > 0")
def c16_existing(spark, sf):
    want = table(spark, sf, "customer").select(F.concat(F.lit("/d/mask/"), F.col("c_name"), F.lit("_labels.tif")).alias("path"))
    return MF.existing(want, "path", view(spark, sf, "fx_files"))


@query("a19_reuse_predictions", "SELECT CAST(o_orderkey AS STRING) AS sample_id, o_orderstatus = 'O' AS reuse FROM orders")
def a19_reuse_predictions(spark, sf):
    o = table(spark, sf, "orders")
    key = lambda stride: [
        F.col("o_orderkey").cast("string").alias("sample_id"), F.lit(1).alias("schema_version"), F.lit("/m/model.keras").alias("model_path"), F.lit(1024).alias("patch_size"),
        stride.alias("stride"), F.lit(4).alias("batch_size"), F.lit(1).alias("num_inputs"), F.array(F.lit("_PPL")).alias("image_suffixes"), F.lit(448).alias("height"), F.lit(512).alias("width"),
    ]
    stored = o.where("o_orderstatus <> 'F'").select(*key(F.when(F.col("o_orderstatus") == "O", 512).otherwise(256)))
    return MF.reuse_predictions(o.select(*key(F.lit(512))), stored).select("sample_id", "reuse")


@query(
    "e9_latest_per_group",
    """SELECT user_id, CONCAT('/run/', CAST(event_id AS STRING)) AS path FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY DATE_TRUNC('hour', ts) DESC, event_id) AS r FROM events) WHERE r = 1""",
)
def e9_latest_per_group(spark, sf):
    e = table(spark, sf, "events").select(
        "user_id", F.concat(F.lit("/run/"), F.col("event_id").cast("string")).alias("path"), F.date_trunc("hour", "ts").alias("mtime"), F.col("event_id").alias("pos")
    )
    return MF.latest_per_group(e, "user_id")


BLEND = """fl AS (SELECT path FROM fx_files WHERE path <> '/d/out.tif' AND path NOT IN (SELECT CONCAT('/d/mask/', c_name, '_labels.tiff') FROM customer))"""


@query("g2_blend_inputs", f"WITH {BLEND} SELECT path FROM fl ORDER BY path")
def g2_blend_inputs(spark, sf):
    return blend(spark, sf, None).select("path")


def blend(spark, sf, base):
    ex = table(spark, sf, "customer").select(F.concat(F.lit("/d/mask/"), F.col("c_name"), F.lit("_labels.tiff")).alias("path"))
    return MF.blend_inputs(view(spark, sf, "fx_files"), "/d/out.tif", ex, base)


@query("g4_base_first", f"WITH {BLEND} SELECT path, path = '/d/base.tif' AS is_base FROM (SELECT path FROM fl UNION SELECT '/d/base.tif') ORDER BY is_base DESC, path")
def g4_base_first(spark, sf):
    return blend(spark, sf, "/d/base.tif")


@query(
    "g3_union_tile_masks",
    """WITH t AS (SELECT sample_id, inst_id, CAST(UNNEST(RANGE(y0 // 128, (y1 - 1) // 128 + 1)) AS INT) AS ty, x0, x1 FROM fx_cboxes WHERE side = 'dt'),
 u AS (SELECT sample_id, inst_id, ty, CAST(UNNEST(RANGE(x0 // 128, (x1 - 1) // 128 + 1)) AS INT) AS tx FROM t)
SELECT sample_id, ty, tx, inst_id, ROW_NUMBER() OVER (PARTITION BY sample_id ORDER BY ty, tx, inst_id) AS pos FROM u""",
)
def g3_union_tile_masks(spark, sf):
    from maskquery.operators.numbering import block_numbered

    rng = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / 128).cast("int"), F.floor((F.col(b) - 1) / 128).cast("int")))
    b = view(spark, sf, "fx_cboxes").where("side = 'dt'")
    u = b.select("sample_id", "inst_id", "x0", "x1", rng("y0", "y1").alias("ty")).select("sample_id", "inst_id", "ty", rng("x0", "x1").alias("tx"))
    order = [F.col("ty"), F.col("tx"), F.col("inst_id")]
    return block_numbered(u, ["sample_id"], F.struct("ty", "tx"), order, "pos")
