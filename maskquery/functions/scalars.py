"""Column expressions for names, numbers and windows; all built from Spark's own functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskquery.functions.geometry import let

# Name patterns that decide a model's variant, in order of precedence, with what follows from them.
VARIANTS = (
    ("PPL+AllPPX", 7, ("_PPL", "_PPX1", "_PPX2", "_PPX3", "_PPX4", "_PPX5", "_PPX6"), "PPL_AllPPX"),
    ("PPL+PPXblend", 2, ("_PPL", "_PPXblend"), "PPL_PlusPPXblend"),
    ("PPLPPXblend", 1, ("_PPLPPXblend",), "PPLPPXblend"),
    ("PPL", 1, ("_PPL",), "PPL"),
)

# Display names of tuning runs, replaced in this order.
RUN_DISPLAY = (("PPL+AllPPX", "PPL+XPL-Stack"), ("PPL+PPXblend", "PPL+XPL-Comp"), ("PPLPPXblend", "Full-Comp"))

# Patterns of framework messages that are left out of logs.
LOG_NOISE = (
    r"Unable to register cu(?:FFT|DNN|BLAS) factory",
    r"All log messages before absl::InitializeLog\(\) is called are written to STDERR",
    r"gpu_timer\.cc:\d+\] Skipping the delay kernel, measurement accuracy will be reduced",
    r".*\(ignoring feature\)",
)

# Fixed value: one line of training metrics.
METRIC_LINE = r"accuracy:\s+([\d.]+)\s+-\s+loss:\s+([\d.]+)\s+-\s+val_accuracy:\s+([\d.]+)\s+-\s+val_loss:\s+([\d.]+)"

STEM = r"^region_(\d+)_y(\d+)_x(\d+)$"


def clip_u8(c: Column) -> Column:
    """Clamp to 0..255, then truncate."""
    return F.least(F.greatest(c, F.lit(0)), F.lit(255)).cast("int")


def to_unit_float(c: Column) -> Column:
    return (c.cast("float") / F.lit(255.0).cast("float")).cast("float")


def sanitize_key(c: Column) -> Column:
    """Column-safe form of an identifier."""
    return F.regexp_replace(c, "[^0-9A-Za-z_]+", "_")


def sanitize_label(c: Column) -> Column:
    """File-safe form of a label: letters, digits, plus, minus and underscore stay; never empty."""
    safe = F.regexp_replace(c, r"[^\p{L}\p{N}+\-_]", "_")
    bare = F.regexp_replace(safe, "^_+|_+$", "")
    return F.when(bare == "", F.lit("model")).otherwise(bare)


def display_run(c: Column) -> Column:
    for old, new in RUN_DISPLAY:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def infer_variant(name: Column) -> Column:
    """Struct of label, number of inputs, suffixes and tuning folder; null when no pattern is in the name."""
    label = F.regexp_replace(F.regexp_replace(name, r"\.keras$", ""), "^unet_finetuned_", "")
    out = F.lit(None)
    for pattern, n, suffixes, subdir in reversed(VARIANTS):
        row = F.struct(
            label.alias("label"),
            F.lit(n).alias("num_inputs"),
            F.lit(",".join(suffixes)).alias("suffixes"),
            F.lit(subdir).alias("tune_subdir"),
        )
        out = F.when(F.contains(name, F.lit(pattern)), row).otherwise(out)
    return out


def normalize_bbox(text: Column) -> Column:
    """``minx,miny,maxx,maxy`` text as a struct, reversed bounds swapped; four numbers are required."""
    p = F.split(text, ",")
    n = [F.trim(F.get(p, F.lit(i))).cast("double") for i in range(4)]
    box = F.struct(
        F.least(n[0], n[2]).alias("minx"),
        F.least(n[1], n[3]).alias("miny"),
        F.greatest(n[0], n[2]).alias("maxx"),
        F.greatest(n[1], n[3]).alias("maxy"),
    )
    return F.when(F.size(p) == 4, box).otherwise(F.raise_error(F.lit("a box has four comma-separated numbers")))


def bbox_to_window(box: Column) -> Column:
    """GIS bounds (y negative down) as pixel bounds; ties round to even."""
    r = lambda c: F.rint(c).cast("int")
    return F.struct(
        r(box["minx"]).alias("left"),
        r(-box["maxy"]).alias("top"),
        r(box["maxx"]).alias("right"),
        r(-box["miny"]).alias("bottom"),
    )


def format_stem(region: Column, y: Column, x: Column) -> Column:
    return F.format_string("region_%04d_y%05d_x%05d", region, y, x)


def parse_stem(stem: Column, lenient: bool = False) -> Column:
    """Struct ``(region_idx, y0, x0)``; another name is an error, or the origin of a whole image when ``lenient``."""
    part = lambda i: F.regexp_extract(stem, STEM, i).cast("int")
    hit = F.struct(part(1).alias("region_idx"), part(2).alias("y0"), part(3).alias("x0"))
    zero = F.struct(*[F.lit(0).alias(n) for n in ("region_idx", "y0", "x0")])
    other = zero if lenient else F.raise_error(F.concat(F.lit("not a patch stem: "), stem))
    return F.when(stem.rlike(STEM), hit).otherwise(other)


def seeded_hash(c: Column, seed: int) -> Column:
    """Hex digest that orders rows as a seeded shuffle, the same in any engine."""
    return F.md5(F.concat(c.cast("string"), F.lit(f"_{seed}")))


def hash_unit(c: Column, salt: str) -> Column:
    """Uniform draw in [0, 1) from a key, with 28 bits taken from its digest."""
    h = F.md5(F.concat(c.cast("string"), F.lit(f"_{salt}")))
    return F.conv(F.substring(h, 1, 7), 16, 10).cast("double") / float(1 << 28)


def starts(size: Column, patch: int, stride: int) -> Column:
    """Start offsets along one axis: every ``stride``, plus a last one flush with the end."""
    if patch <= 0 or stride <= 0 or stride > patch:
        raise ValueError("need 0 < stride <= patch")
    last = size - patch
    grid = F.sequence(F.lit(0), last, F.lit(stride))
    return F.when(last <= 0, F.array(F.lit(0))).otherwise(F.array_union(grid, F.array(last)))


def hann(i: Column, n: int) -> Column:
    """Hann window value of position ``i`` of ``n``."""
    if n == 1:
        return F.lit(1.0)
    return F.lit(0.5) - F.lit(0.5) * F.cos(i * F.lit(2.0 * math.pi / (n - 1)))


def stride_rounded(patch: Column, overlap: Column) -> Column:
    """Stride for label datasets: rounded, ties to even."""
    return F.rint(patch * (F.lit(1.0) - overlap)).cast("int")


def stride_truncated(patch: Column, overlap: Column) -> Column:
    """Stride for raster datasets: truncated."""
    return (patch * (F.lit(1.0) - overlap)).cast("int")


def is_noise(line: Column) -> Column:
    """True for a log line that matches any of the noise patterns."""
    return line.rlike("|".join(f"(?:{p})" for p in LOG_NOISE))


def metric_values(line: Column) -> Column:
    """The four numbers of a training line as an array of doubles, null on other lines."""
    vals = F.array(*[F.regexp_extract(line, METRIC_LINE, i).cast("double") for i in range(1, 5)])
    return F.when(line.rlike(METRIC_LINE), vals)


def format_coord(v: Column) -> Column:
    """Six decimals without trailing zeros, but at least one decimal."""
    short = lambda s: F.when(F.contains(s, F.lit(".")), F.regexp_replace(s, r"(\.\d+?)0+$", "$1")).otherwise(F.concat(s, F.lit(".0")))
    return let(F.format_string("%.6f", v), short)
