"""Checks of inputs and parameters: each returns the offending rows, or fails the job that meets one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def semantic_violations(pixels: DataFrame, lo: int = 0, hi: int = 2, allow_float: bool = False) -> DataFrame:
    """Pixels whose ``cls`` is no label: out of range, not whole, or (floats) further than 1e-4 from a whole number."""
    c = F.col("cls").cast("double")
    near = F.rint(c)
    whole = (F.abs(c - near) <= 1e-4) if allow_float else (c == near)
    ok = c.isNotNull() & ~F.isnan(c) & whole & near.between(lo, hi)
    return pixels.where(~F.coalesce(ok, F.lit(False)))


def shape_violations(images: DataFrame) -> DataFrame:
    """Samples whose images differ in shape, have no image, or whose mask differs in height or width."""
    is_img = F.col("kind") == "image"
    # equal minimum and maximum says "one distinct shape" with partial aggregation
    shape = F.struct("h", "w", "c")
    hw = F.struct("h", "w")
    g = images.groupBy("sample_id").agg(
        F.count(F.when(is_img, 1)).alias("images"),
        (F.min(F.when(is_img, shape)) != F.max(F.when(is_img, shape))).alias("mixed"),
        (F.min(hw) != F.max(hw)).alias("mask_differs"),
    )
    reason = (
        F.when(F.col("images") == 0, "no image").when(F.col("mixed"), "image shapes differ").when(F.col("mask_differs"), "mask shape differs")
    )
    return g.select("sample_id", reason.alias("reason")).where("reason IS NOT NULL")


# Bounds of the parameters of evaluation, tuning, dataset building and mask generation.
PARAM_RULES = {
    "num_inputs": "num_inputs IN (1, 2, 7)",
    "stride": "stride > 0 AND stride <= patch_size",
    "min_distance": "min_distance >= 1",
    "boundary_dilate_iter": "boundary_dilate_iter >= 0",
    "min_area_px": "min_area_px >= 0",
    "ridge_level": "ridge_level IS NULL OR (NOT isnan(ridge_level) AND abs(ridge_level) < double('infinity'))",
    "patch_overlap": "patch_overlap >= 0.0D AND patch_overlap <= 0.9D",
    "validation_fraction": "validation_fraction > 0.0D AND validation_fraction < 1.0D",
    "min_iom": "min_iom >= 0.0D AND min_iom <= 1.0D",
    "max_coverage": "max_coverage > 0.0D AND max_coverage <= 1.0D",
}


def param_violations(params: DataFrame) -> DataFrame:
    """Parameter rows with the array of broken rules; only rules whose column is present are applied."""
    used = [(n, r) for n, r in PARAM_RULES.items() if n in params.columns and (n != "stride" or "patch_size" in params.columns)]
    broken = F.filter(F.array(*[F.when(~F.expr(r), F.lit(n)) for n, r in used]), lambda x: x.isNotNull())
    return params.withColumn("broken", broken).where(F.size("broken") > 0)


def resolve_layout(axes: Column, a: Column, b: Column, c: Column) -> Column:
    """Axis order ("chw"/"hwc") of a three-axis TIFF from its axes string and sizes; an unsafe case is an error."""
    first, last = (a < b) & (c >= b), (c < b) & (a >= b)
    bad = F.raise_error(F.concat(F.lit("cannot tell channels: axes "), axes))
    return (
        F.when(axes == "YXS", "hwc")
        .when(axes.isin("SYX", "CYX"), "chw")
        .when((axes == "QYX") & first, "chw")
        .when((axes == "QYX") & last, "hwc")
        .otherwise(bad)
    )


def layout_by_size(a: Column, b: Column, c: Column) -> Column:
    """Axis order guessed from sizes alone: few channels next to two long axes, else channels last."""
    return F.when((a <= 8) & (b > 64) & (c > 64), "chw").otherwise(F.lit("hwc"))


def layout_by_channels(a: Column, c: Column, exact: int | None = None, multiple: int | None = None, last_first: bool = False) -> Column:
    """Axis order that puts a valid channel count on the channel axis, trying the preferred axis first."""
    if exact is not None:
        ok = lambda n: n == exact
    elif multiple is not None:
        ok = lambda n: (n > 0) & (n % multiple == 0)
    else:
        ok = lambda n: F.lit(True)
    tries = [(c, "hwc"), (a, "chw")] if last_first else [(a, "chw"), (c, "hwc")]
    bad = F.raise_error(F.lit("no axis holds a valid channel count"))
    return F.when(ok(tries[0][0]), tries[0][1]).when(ok(tries[1][0]), tries[1][1]).otherwise(bad)
