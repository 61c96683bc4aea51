"""Regions, patches and sliding windows as generated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskquery.functions.scalars import format_stem, parse_stem, seeded_hash, starts
from maskquery.operators.numbering import hash_numbered


def region_count(size: Column, tile: int) -> Column:
    return F.ceil(size / tile)


def regions(sections: DataFrame, tile: int) -> DataFrame:
    """Row-major grid of ``tile`` sized regions per section; edge regions are cut, the index is the position."""
    if tile <= 0:
        raise ValueError("tile must be > 0")
    y = F.explode(F.sequence(F.lit(0), F.col("height") - 1, F.lit(tile))).alias("y0")
    x = F.explode(F.sequence(F.lit(0), F.col("width") - 1, F.lit(tile))).alias("x0")
    grid = sections.select("section_id", "height", "width", y).select("*", x)
    idx = F.floor(F.col("y0") / tile) * region_count(F.col("width"), tile) + F.floor(F.col("x0") / tile)
    return grid.select(
        "section_id",
        idx.cast("int").alias("region_idx"),
        "y0",
        F.least(F.col("y0") + tile, F.col("height")).alias("y1"),
        "x0",
        F.least(F.col("x0") + tile, F.col("width")).alias("x1"),
    )


def patch_grid(region_rows: DataFrame, patch: int, stride: int) -> DataFrame:
    """Patches inside each region, cut at the region's end, with their file stems."""
    keep = [c for c in region_rows.columns if c not in ("y0", "y1", "x0", "x1")]
    ys = F.explode(starts(F.col("y1") - F.col("y0"), patch, stride)).alias("dy")
    xs = F.explode(starts(F.col("x1") - F.col("x0"), patch, stride)).alias("dx")
    g = region_rows.select("*", ys).select("*", xs)
    py, px = F.col("y0") + F.col("dy"), F.col("x0") + F.col("dx")
    return g.select(
        *keep,
        py.alias("y0"),
        F.least(py + patch, F.col("y1")).alias("y1"),
        px.alias("x0"),
        F.least(px + patch, F.col("x1")).alias("x1"),
        format_stem(F.col("region_idx"), py, px).alias("stem"),
    )


def patch_bounds(stems: DataFrame, tile: int, patch: int) -> DataFrame:
    """Bounds of patches named by ``stem`` in sections of ``height`` x ``width``; an origin outside its region fails."""
    p = stems.withColumn("p", parse_stem(F.col("stem")))
    cols, rows = region_count(F.col("width"), tile), region_count(F.col("height"), tile)
    ry = F.floor(F.col("p.region_idx") / cols) * tile
    rx = (F.col("p.region_idx") % cols) * tile
    ey, ex = F.least(ry + tile, F.col("height")), F.least(rx + tile, F.col("width"))
    y, x = F.col("p.y0"), F.col("p.x0")
    inside = (F.col("p.region_idx") < cols * rows) & (y >= ry) & (y < ey) & (x >= rx) & (x < ex)
    bad = F.raise_error(F.concat(F.lit("patch outside its region: "), F.col("stem")))
    y_ok = F.when(inside, y).otherwise(bad)
    return p.select(
        *[c for c in stems.columns],
        y_ok.cast("int").alias("y0"),
        F.least(y + patch, ey).cast("int").alias("y1"),
        x.alias("x0"),
        F.least(x + patch, ex).cast("int").alias("x1"),
    )


def sliding_windows(sections: DataFrame, size: int, stride: int) -> DataFrame:
    """Full-size inference windows over each section, padded to at least one window."""
    ys = F.explode(starts(F.col("height"), size, stride)).alias("y0")
    xs = F.explode(starts(F.col("width"), size, stride)).alias("x0")
    grid = sections.select("section_id", "width", ys).select("section_id", "y0", xs)
    return grid.select("section_id", "y0", (F.col("y0") + size).alias("y1"), "x0", (F.col("x0") + size).alias("x1"))


def shuffle_batches(rows: DataFrame, key: str, batch: int, seed: int) -> DataFrame:
    """Rows in seeded-hash order with their batch number; the last batch may be short."""
    h = rows.withColumn("_h", seeded_hash(F.col(key), seed))
    pos = hash_numbered(h, [], "_h", "pos")
    return pos.withColumn("batch", F.floor((F.col("pos") - 1) / batch)).drop("_h")
