"""Coverage of regions and coverage-stratified train/validation splits."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskquery.functions.scalars import seeded_hash
from maskquery.operators.numbering import hash_numbered
from maskquery.operators.quantiles import exact_quantiles
from maskquery.operators.runs import split_to_cells

MIN_COVERAGE = 0.10


def raster_coverage(runs: DataFrame, frames: DataFrame, tile: int) -> DataFrame:
    """Share of set pixels per region of disjoint runs; regions without any pixel have coverage 0."""
    from maskquery.operators.tiling import regions

    grid = regions(frames.withColumnRenamed("sample_id", "section_id"), tile).withColumnRenamed("section_id", "sample_id")
    cut = split_to_cells(runs.select("sample_id", "y", "x0", "x1"), tile)
    hit = cut.groupBy(
        "sample_id", (F.floor(F.col("y") / tile) * tile).cast("int").alias("y0"), (F.col("cell") * tile).cast("int").alias("x0")
    ).agg(F.sum(F.col("x1") - F.col("x0")).alias("px"))
    area = (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))
    joined = grid.join(hit, ["sample_id", "y0", "x0"], "left")
    return joined.select("sample_id", "region_idx", (F.coalesce("px", F.lit(0)) / area).alias("cov"))


def bin_edges(regions: DataFrame, bins: int, group_count: int, n: int) -> list[float]:
    """Inner quantile edges of coverage bins; empty when one bin is all the data supports."""
    k = min(bins, max(1, n // group_count))
    if k <= 1:
        return []
    edges = exact_quantiles(regions, "cov", [i / k for i in range(k + 1)])
    flat = all(abs(e - edges[0]) <= 1e-8 + 1e-5 * abs(edges[0]) for e in edges)
    return [] if flat else edges[1:-1]


def coverage_bins(regions: DataFrame, bins: int, group_count: int) -> DataFrame:
    """Append ``bin``: the number of inner quantile edges below the coverage (bins are closed on the right)."""
    edges = bin_edges(regions, bins, group_count, regions.count())
    if not edges:
        return regions.withColumn("bin", F.lit(0))
    below = F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col("cov"))
    return regions.withColumn("bin", F.size(below))


def can_stratify(counts: list[int], val_count: int, n: int) -> bool:
    return min(counts) >= 2 and len(counts) <= val_count and len(counts) <= n - val_count


def stratified_split(
    regions: DataFrame, key: str, fraction: float, seed: int, bins: int = 10, min_coverage: float = MIN_COVERAGE
) -> DataFrame:
    """Append ``split`` ("train"/"val") to regions with coverage ``cov``.

    Regions under ``min_coverage`` only train. The rest is shuffled by a seeded hash; every bin gives one region to
    validation, then bins take turns and keep at least one each. The turn order is a closed form of the row's place
    in its bin and the (few) bin sizes, so no ranking over all regions is needed. Whenever stratifying is allowed,
    the turns alone cover the validation count, since bins <= n - val_count.
    """
    if not 0 < fraction < 1:
        raise ValueError("fraction must be in (0, 1)")
    eligible = regions.where(F.col("cov") >= min_coverage)
    n = eligible.count()
    if n < 2:
        raise ValueError(f"not enough validation-eligible regions ({n})")
    val_count = max(1, min(math.ceil(n * fraction), n - 1))
    binned = coverage_bins(eligible, bins, max(2, math.ceil(1 / fraction)))
    hashed = binned.withColumn("_h", seeded_hash(F.col(key), seed))
    # one row per bin, at most ``bins``
    stats = sorted(hashed.groupBy("bin").agg(F.min("_h"), F.count(F.lit(1))).collect(), key=lambda r: r[1])
    if can_stratify([r[2] for r in stats], val_count, n):
        ranked = hash_numbered(hashed, ["bin"], "_h", "_r")
        quota = [(r[0], max(1, r[2] - 1)) for r in stats]
        r = F.col("_r")
        turn = sum((F.least(r - 1, F.lit(q)) for _, q in quota), F.lit(0))
        place = F.coalesce(*[F.when(F.col("bin") == b, F.lit(i)) for i, (b, _) in enumerate(quota)])
        ahead = sum((F.when((place > i) & (r <= q), 1).otherwise(0) for i, (_, q) in enumerate(quota)), F.lit(0))
        own = F.coalesce(*[F.when(F.col("bin") == b, F.lit(q)) for b, q in quota])
        is_val = (r <= own) & (turn + ahead < val_count)
    else:
        ranked = hash_numbered(hashed, [], "_h", "_r")
        is_val = F.col("_r") <= val_count
    picked = ranked.select(*regions.columns, F.when(is_val, F.lit("val")).otherwise(F.lit("train")).alias("split"))
    rest = regions.where(F.col("cov") < min_coverage).withColumn("split", F.lit("train"))
    return picked.unionByName(rest)


def train_set(eligible: DataFrame, val: DataFrame, train_only: DataFrame, key: str) -> DataFrame:
    """(eligible EXCEPT val) UNION train_only."""
    return eligible.join(val.select(key), key, "left_anti").unionByName(train_only)
