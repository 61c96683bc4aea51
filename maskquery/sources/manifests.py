"""Sample, dataset and prediction manifests built from file listings and JSON rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskquery.sources.json_items import json_items

TIFF = r"(?i)\.tiff?$"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path, mtime, length)`` of all files under ``root``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.col("modificationTime").alias("mtime"), "length")


def discover_images(files: DataFrame) -> DataFrame:
    """TIFF paths, any letter case, sorted."""
    return files.where(F.col("path").rlike(TIFF)).select("path").orderBy("path")


def with_stem(files: DataFrame) -> DataFrame:
    """Split ``path`` into folder, stem and extension."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.select(
        "path",
        F.regexp_replace("path", r"/?[^/]*$", "").alias("dir"),
        F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"),
        F.regexp_extract(name, r"(\.[^.]*)$", 1).alias("ext"),
    )


def sample_manifest(
    files: DataFrame, suffixes: list[str], mask_suffix: str | None = None, mask_exts: tuple[str, ...] = (".tif", ".tiff")
) -> DataFrame:
    """One row per anchor image (stem ends in the first suffix) with its sibling images and mask.

    All inputs share folder and extension; the mask is the first existing extension. A missing file is an error,
    raised by the row that misses it.
    """
    if not suffixes:
        raise ValueError("suffixes must not be empty")
    parts = with_stem(files)

    def role(suffix: str, name: str) -> DataFrame:
        base = F.expr(f"substring(stem, 1, length(stem) - {len(suffix)})")
        return parts.where(F.endswith("stem", F.lit(suffix))).select(
            "dir", base.alias("sample_id"), "ext", F.col("path").alias(name)
        )

    out = role(suffixes[0], "p0")
    for i, s in enumerate(suffixes[1:], start=1):
        out = out.join(role(s, f"p{i}"), ["dir", "sample_id", "ext"], "left")
    need = lambda c, what: F.coalesce(F.col(c), F.raise_error(F.concat(F.lit(f"missing {what} of "), F.col("sample_id"))))
    images = F.array(*[need(f"p{i}", f"image {s}") for i, s in enumerate(suffixes)]).alias("images")
    if mask_suffix is None:
        return out.select("sample_id", images)
    rank = F.array_position(F.array(*[F.lit(e) for e in mask_exts]), F.col("ext"))
    masks = role(mask_suffix, "m").where(rank > 0).groupBy("sample_id").agg(F.min_by("m", rank).alias("m"))
    return out.join(masks, "sample_id", "left").select("sample_id", images, need("m", "mask").alias("mask"))


def blend_inputs(files: DataFrame, output: str, excludes: DataFrame, base: str | None = None) -> DataFrame:
    """Listing minus output and excludes, with the base file (the first one by default) put in front."""
    keep = files.select("path").where((F.col("path") != output)).join(excludes.select("path"), "path", "left_anti")
    first = keep.agg(F.min("path").alias("b")).first()["b"]
    if first is None and base is None:
        raise ValueError("no input images")
    chosen = base or first
    if base is not None:
        keep = keep.unionByName(keep.sparkSession.createDataFrame([(base,)], "path string")).distinct()
    return keep.select("path", (F.col("path") == chosen).alias("is_base")).orderBy(F.desc("is_base"), "path")


def fold_fingerprint(samples: Column, role: str, patch: int, stride: int, num_inputs: int) -> Column:
    """First 16 hex digits of the digest of the canonical (key-sorted, compact) JSON of a training fold."""
    if role not in ("train", "val"):
        raise ValueError("role must be train or val")
    doc = F.struct(
        F.lit(num_inputs).alias("num_inputs"),
        F.lit(patch).alias("patch_size"),
        F.lit(role).alias("role"),
        samples.alias("samples"),
        F.lit(1).alias("schema_version"),
        F.lit(stride).alias("stride"),
    )
    return F.substring(F.sha2(F.to_json(doc), 256), 1, 16)


# What a stored prediction must agree on to be used again.
CACHE_KEYS = ("schema_version", "model_path", "patch_size", "stride", "batch_size", "num_inputs", "image_suffixes", "height", "width")


def cache_key(cols: tuple[str, ...] = CACHE_KEYS) -> Column:
    return F.sha2(F.to_json(F.struct(*cols)), 256)


def reuse_predictions(requested: DataFrame, stored: DataFrame) -> DataFrame:
    """Requested samples with ``reuse``: true if a stored prediction agrees on every key."""
    have = stored.select("sample_id", cache_key().alias("_k")).distinct().withColumn("_hit", F.lit(True))
    want = requested.withColumn("_k", cache_key())
    out = want.join(have, ["sample_id", "_k"], "left")
    return out.select(*requested.columns, F.coalesce("_hit", F.lit(False)).alias("reuse"))


def pair_manifest(entries: DataFrame, folder: str) -> DataFrame:
    """``(image_id, tiff, gpkg)`` of manifest entries ``(pos, test_tiff, tiff, test_gpkg, gpkg)``, 1-based in order."""

    def full(a: str, b: str) -> Column:
        p = F.coalesce(F.nullif(F.col(a), F.lit("")), F.nullif(F.col(b), F.lit("")))
        p = F.coalesce(p, F.raise_error(F.lit(f"manifest entry needs {a}")))
        return F.when(F.startswith(p, F.lit("/")), p).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), p))

    return entries.select(
        (F.col("pos") + 1).alias("image_id"), full("test_tiff", "tiff").alias("tiff"), full("test_gpkg", "gpkg").alias("gpkg")
    )


def read_pair_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The pairs of a JSON list file; relative names are taken from the manifest's folder."""
    keys = ("test_tiff", "tiff", "test_gpkg", "gpkg")
    items = json_items(spark, path).select("pos", F.from_json("item", ", ".join(f"{k} string" for k in keys)).alias("e"))
    return pair_manifest(items.select("pos", "e.*"), path.rsplit("/", 1)[0])


def dataset_splits(configs: DataFrame) -> DataFrame:
    """Image and label folders of dataset configs ``(config_path, path, split, rel)``."""
    here = F.regexp_replace("config_path", r"/[^/]*$", "")
    base = F.coalesce("path", F.lit("."))
    root = F.when(F.startswith(base, F.lit("/")), base).when(base == ".", here).otherwise(F.concat_ws("/", here, base))
    c = configs.withColumn("root", root)
    images = F.when(F.startswith("rel", F.lit("/")), F.col("rel")).otherwise(F.concat_ws("/", "root", "rel"))
    c = c.withColumn("image_dir", images)
    # the first path segment called "images" below the root becomes "labels"
    below = F.when(
        F.startswith("image_dir", F.concat("root", F.lit("/"))),
        F.expr("concat('/', substring(image_dir, length(root) + 2), '/')"),
    )
    at = F.instr(below, "/images/")
    mirrored = F.concat(F.expr("root"), F.rtrim(F.overlay(below, F.lit("/labels/"), at, F.lit(8)), F.lit("/")))
    labels = F.when(at > 0, mirrored).otherwise(F.concat_ws("/", "root", F.lit("labels"), "split"))
    return c.select("config_path", "split", "root", "image_dir", labels.alias("label_dir"))


def collect_split_pairs(splits: DataFrame, files: DataFrame, order: tuple[str, ...] = ("test", "val"), labelled: bool = False, strict: bool = False) -> DataFrame:
    """Images of each config's first defined split, with the path their label file would have.

    ``labelled`` leaves out images whose label file is not listed; with ``strict`` a config that is left without an image is an error.
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("split"))
    use = splits.where(rank > 0).withColumn("_r", rank)
    best = use.groupBy("config_path").agg(F.min("_r").alias("_r"))
    chosen = use.join(best, ["config_path", "_r"]).drop("_r")
    imgs = with_stem(files).where(F.col("path").rlike(r"(?i)\.(tiff?|png|jpe?g)$"))
    hit = chosen.join(imgs, F.col("image_dir") == F.col("dir"))
    pairs = hit.select(
        "config_path", "split", F.col("path").alias("image"), F.concat(F.col("label_dir"), F.lit("/"), F.col("stem"), F.lit(".txt")).alias("label")
    )
    if labelled:
        pairs = existing(pairs, "label", files).select(*pairs.columns)
    if strict:
        bare = splits.select("config_path").distinct().join(pairs.select("config_path"), "config_path", "left_anti").first()
        if bare is not None:
            raise ValueError(f"no image in any of the splits {', '.join(order)} of {bare[0]}")
    return pairs


def existing(rows: DataFrame, path_col: str, files: DataFrame) -> DataFrame:
    """Rows whose file exists."""
    return rows.join(files.select(F.col("path").alias(path_col)).distinct(), path_col, "left_semi")


def missing(rows: DataFrame, path_col: str, files: DataFrame) -> DataFrame:
    """Rows whose file does not exist."""
    return rows.join(files.select(F.col("path").alias(path_col)).distinct(), path_col, "left_anti")


def latest_per_group(files: DataFrame, group: str) -> DataFrame:
    """Newest file of each group; the first listed wins a tie. Needs ``path``, ``mtime`` and ``pos``."""
    return files.groupBy(group).agg(F.max_by("path", F.struct("mtime", (-F.col("pos")).alias("p"))).alias("path"))
