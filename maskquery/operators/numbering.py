"""Ranks over large groups without a window over the whole group.

Rows are counted per block (a coarse prefix of the order), the few block counts are summed up, and rows are
numbered inside their block. A hot group is thus spread over many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from maskquery.session import cut_lineage

BLOCK = 4096


def block_numbered(df: DataFrame, keys: list[str], block: Column, order: list[Column], name: str) -> DataFrame:
    """Append the 1-based position of each row within ``keys`` by ``order``; ``block`` must be monotone in the order."""
    df = df.withColumn("_blk", block)
    cells = [*keys, "_blk"]
    counts = df.groupBy(*cells).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select(*cells, F.coalesce(before, F.lit(0)).alias("_off"))
    at = F.row_number().over(W.partitionBy(*cells).orderBy(*order))
    return df.join(offsets, cells).withColumn(name, (F.col("_off") + at).cast("long")).drop("_blk", "_off")


def numbered(df: DataFrame, keys: list[str], order: str, name: str, block: int = BLOCK) -> DataFrame:
    """1-based position by an integer column that is unique within ``keys``."""
    return block_numbered(df, keys, F.floor(F.col(order) / block), [F.col(order)], name)


def range_numbered(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Append the 1-based position of each row within ``keys`` by ``order``, which must tell all rows of a key apart.

    Rows are dealt to partitions by ranges of key and order that Spark samples, so a group with equal scores is cut by what breaks
    its ties; a row's place is the count of its key's rows in earlier partitions and its place in its own.
    """
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_p", F.spark_partition_id())
    ranged = cut_lineage(ranged)
    parts = [*keys, "_p"]
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy("_p").rowsBetween(W.unboundedPreceding, -1))
    counts = ranged.groupBy(*parts).agg(F.count(F.lit(1)).alias("_n")).select(*parts, F.coalesce(before, F.lit(0)).alias("_off"))
    at = F.row_number().over(W.partitionBy(*parts).orderBy(*order))
    return ranged.join(counts, parts).withColumn(name, (F.col("_off") + at).cast("long")).drop("_p", "_off")


def order_by_score(masks: DataFrame) -> DataFrame:
    """Masks with their place ``pos`` in their sample, best score first (as a float, missing counts as 0), ties by higher id."""
    s = F.coalesce("score", F.lit(0.0)).cast("float")
    return range_numbered(masks.select("*", s.alias("_s")), ["sample_id"], [F.desc("_s"), F.desc("inst_id")], "pos").drop("_s")


def hash_numbered(df: DataFrame, keys: list[str], hashed: str, name: str) -> DataFrame:
    """1-based position by a hex digest column (a seeded shuffle); blocks are digest prefixes as long as keeps them small."""
    digits = max(3, math.ceil(math.log(max(1, df.count()) / BLOCK, 16)))
    return block_numbered(df, keys, F.substring(F.col(hashed), 1, digits), [F.col(hashed)], name)
