"""Verification of candidate buckets in blocks, for joins whose buckets may hold a large group.

A bucket of n members is cut into chunks of about ``CHUNK`` by a hash of the member, and each pair of chunks is one block, so no
task gets more than two chunks of a bucket at once, and no pair ever becomes a row: a block gives counts per member. Buckets with
the same members are verified once. A pair that meets in several buckets counts in the first of its trees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskquery.llm.store import keep

CHUNK = 512


def blocks(rows: DataFrame, name: str, chunk: int = CHUNK) -> DataFrame:
    """``rows``: distinct ``id, tree, key`` (key a long that no two trees share) to ``id, tree, key, lo, hi, side``.

    ``side`` is the member's chunk; a block ``(key, lo, hi)`` holds chunks lo and hi of its bucket.
    """
    once = [F.sum(F.xxhash64("id", F.lit(k)).cast("decimal(20,0)")).alias(f"s{k}") for k in (0, 1)]
    buckets = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("tree").alias("tree"), *once).filter("n > 1")
    buckets = keep(buckets.groupBy("n", "s0", "s1").agg(F.min(F.struct("tree", "key")).alias("b")).select("b.key", "n"), f"{name}-buckets")
    parts = F.ceil(F.col("n") / chunk).cast("int")
    side = F.pmod(F.xxhash64("id", "key"), parts).cast("int")
    placed = rows.join(buckets, "key").select("id", "tree", "key", side.alias("side"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    return placed.select("id", "tree", "key", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side")


def by_block(df: DataFrame) -> DataFrame:
    return df.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")


def groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...] = ("key", "lo", "hi")) -> Iterator[pa.RecordBatch]:
    """Runs of rows with equal keys, whole even where a run crosses batches."""
    held: list[pa.RecordBatch] = []

    def key(batch: pa.RecordBatch, i: int) -> tuple:
        return tuple(batch.column(batch.schema.get_field_index(n))[i].as_py() for n in names)

    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for n in names:
            v = batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        if held and key(held[-1], held[-1].num_rows - 1) != key(batch, 0):
            yield _whole(held)
            held = []
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a:
                yield _whole(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield _whole(held)


def _whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def first_shared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The first tree (column) in which two members' keys are equal, for all pairs; the number of trees if there is none."""
    out = np.full((len(left), len(right)), left.shape[1], np.int16)
    for t in range(left.shape[1] - 1, -1, -1):
        out[left[:, t][:, None] == right[:, t][None, :]] = t
    return out


def local_minima(link: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every member of a block the least id that its links reach inside the block; ``link`` is the matrix rows x cols."""
    ids = np.unique(np.r_[rows, cols])
    low = ids.copy()
    i, j = np.nonzero(link)
    a, b = np.searchsorted(ids, rows[i]), np.searchsorted(ids, cols[j])
    while len(a):
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        if (new == low).all():
            break
        low = new
    return ids, low


def components(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """``id, comp`` from rows ``id, low``: comp is the least id reachable."""
    from maskquery.operators.graph import connected_components

    return connected_components(nodes, found.filter("id <> low").select(F.col("id").alias("src"), F.col("low").alias("dst")))


def number(column: Column, other: Column) -> Column:
    """A document's id; for a null id a negative number from its content."""
    return F.coalesce(column.cast("long"), -1 - F.shiftrightunsigned(F.xxhash64(other), 1))
