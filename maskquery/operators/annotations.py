"""Row-wise operators on mask annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Attributes an exported mask keeps next to its run-length code.
MASK_ATTRIBUTES = ("area", "bbox", "predicted_iou", "stability_score", "point_coords", "crop_box", "tile_x", "tile_y")


def filter_mask_coverage(masks: DataFrame, tile_area: float, max_coverage: float) -> DataFrame:
    """Masks that cover strictly less than ``max_coverage`` of the tile."""
    if tile_area <= 0:
        return masks
    return masks.where(F.col("area") / F.lit(float(tile_area)) < max_coverage)


def rle_area(counts):
    """Set pixels of a counts array: every second entry."""
    lead = (F.size(counts) >= 2) & (counts[0] == 0) & (counts[1] == 0)
    fixed = F.when(lead, F.slice(counts, F.lit(2), F.size(counts) - 1)).otherwise(counts)
    return F.aggregate(
        F.transform(fixed, lambda v, i: F.when(i % 2 == 1, v.cast("long")).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"),
        lambda a, v: a + v,
    )


def filter_mask_area(masks: DataFrame, max_area: int) -> DataFrame:
    """Masks strictly smaller than ``max_area``; a missing or unreadable ``area`` text falls back to the RLE, then 0."""
    if max_area <= 0:
        return masks
    area = F.coalesce(F.col("area").try_cast("long"), rle_area(F.col("counts")), F.lit(0))
    return masks.where(area < max_area)


def scalar_props(df: DataFrame) -> DataFrame:
    """Drop list and dict columns and the mask payload itself."""
    nested = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
    return df.select(*[f.name for f in df.schema if not isinstance(f.dataType, nested) and f.name not in ("rle", "segmentation")])


def mask_attributes(df: DataFrame) -> DataFrame:
    """RLE and the exported attributes that are present."""
    return df.select("rle", *[c for c in MASK_ATTRIBUTES if c in df.columns])


def local_to_global(masks: DataFrame) -> DataFrame:
    """Shift ``bbox``, ``point_coords`` and ``crop_box`` by the tile's origin."""
    x, y = F.col("tile_x"), F.col("tile_y")
    shift = lambda b: F.array(b[0] + x, b[1] + y, b[2], b[3])
    points = F.transform("point_coords", lambda p: F.array(p[0] + x, p[1] + y))
    return masks.withColumns({"bbox": shift(F.col("bbox")), "point_coords": points, "crop_box": shift(F.col("crop_box"))})


def normalize_category(dts: DataFrame, areas: DataFrame) -> DataFrame:
    """Detections as COCO rows: category 0 becomes 1, empty segmentations go, absent area and bbox come from runs."""
    m = areas.select("image_id", "det_id", F.col("area").alias("_a"), F.col("bbox").alias("_b"))
    full = dts.where("n_runs > 0").join(m, ["image_id", "det_id"], "left")
    cat = F.when(F.coalesce("category_id", F.lit(0)) == 0, 1).otherwise(F.col("category_id"))
    return full.select(
        "image_id",
        "det_id",
        cat.alias("category_id"),
        F.coalesce(F.when(F.col("area") > 0, F.col("area")), "_a").alias("area"),
        F.coalesce("bbox", "_b").alias("bbox"),
    )
