"""Iterative operators over sparse pair tables: components, suppression and merging.

Each round is a handful of joins and grouped aggregates whose result is written to the checkpoint folder, so the
plan stays short and a lost executor costs one round. No round gathers a component in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from maskquery.operators.choices import mask_places, suppressed
from maskquery.operators.runs import mask_areas, mask_iom, mask_iou, merge_runs, run_adjacency, union_masks
from maskquery.session import cut_lineage, round_table


def node_id(sample: Column, inst: Column) -> Column:
    """The pair as a node, so that ids of two samples never meet, however large."""
    return F.struct(sample.cast("long").alias("sample_id"), inst.cast("long").alias("inst_id"))


#: Edges that are contracted at a time.
CHUNK = 1 << 18


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least of 0..n-1 that edges ``a - b`` lead to, for each of them."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(root, above := root[root]):
            root = above
    return root


def _contract(batches: Iterator[pa.RecordBatch], width: int, chunk: int) -> Iterator[pa.RecordBatch]:
    """Edges, the ``width`` columns of one end before those of the other, as each end with the least end that a chunk's edges lead it to."""

    def settle(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        ends = [pa.concat_arrays([*table.column(k).chunks, *table.column(width + k).chunks]) for k in range(width)]
        code = np.zeros(2 * len(table), np.int64)
        for column in ends:
            place = pc.rank(column, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
            code = np.unique(code * (int(place.max()) + 1) + place, return_inverse=True)[1]
        _, at = np.unique(code, return_index=True)
        root = _roots(code[: len(table)], code[len(table) :], len(at))
        both = [c.take(pa.array(i)) for i in (at, at[root]) for c in ends]
        yield from pa.table(both, schema=table.schema).to_batches()

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= chunk:
            yield from settle(held)
            held, size = [], 0
    if held:
        yield from settle(held)


def contracted(edges: DataFrame) -> DataFrame:
    """``src, dst`` as ``u, v``: each end, and the least end that the edges of some chunk lead it to, which is a row of its own.

    Further columns of ``edges`` tell which edges lie near each other and so go into a chunk together.
    """
    near = [c for c in edges.columns if c not in ("src", "dst")]
    some = edges.where("src <> dst")
    if near:
        some = some.repartition(*near).sortWithinPartitions(*near)
    kind = edges.schema["src"].dataType
    leaves = _leaves(kind)
    flat = some.select(*[_at(e, leaf).alias(f"{e}{k}") for e in ("src", "dst") for k, leaf in enumerate(leaves)])
    width, chunk = len(leaves), CHUNK
    found = flat.mapInArrow(lambda it: _contract(it, width, chunk), flat.schema)
    return found.select(_built(kind, iter(found.columns[:width])).alias("u"), _built(kind, iter(found.columns[width:])).alias("v"))


def _leaves(kind: DataType) -> list[tuple[str, ...]]:
    """Paths to what a struct, or a struct of structs, holds."""
    return [(f.name, *leaf) for f in kind.fields for leaf in _leaves(f.dataType)] if isinstance(kind, StructType) else [()]


def _at(name: str, path: tuple[str, ...]) -> Column:
    col = F.col(name)
    for field in path:
        col = col[field]
    return col


def _built(kind: DataType, columns: Iterator[str]) -> Column:
    """The value of this type from its leaves."""
    return F.struct(*[_built(f.dataType, columns).alias(f.name) for f in kind.fields]) if isinstance(kind, StructType) else F.col(next(columns))


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, comp)`` with ``comp`` the least id of the component; nodes without edges keep their own id. Ids are numbers, strings or
    structs of these. Edges that share further columns of ``edges`` are taken to lie near each other.

    Edges are contracted in chunks first, so that only the least ids of parts that share a node are still to be joined. For these,
    alternating large-star and small-star steps until the edges form stars. Minima are partial aggregates joined
    back. Both sides of each of these joins are written first, so a shuffle stands right under the join on either side and
    skew-join handling can split the rows of a hub.
    """
    told = round_table(contracted(edges))
    own = round_table(told.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("last")))
    several = own.where("m <> last").select("u", "m")
    e = round_table(told.join(several, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
    while not _is_star(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = round_table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = round_table(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = round_table(large.groupBy("u").agg(F.min("v").alias("m")))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = round_table(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    star = own.select(F.col("u").alias("id"), "m").join(e.select(F.col("u").alias("m"), F.col("v").alias("top")), "m", "left")
    star = star.select("id", F.coalesce("top", "m").alias("comp"))
    return nodes.select("id").join(star, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))


def _is_star(e: DataFrame) -> bool:
    ends = e.select(
        F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("up")), F.struct(F.col("v").alias("n"), F.lit(0).alias("up")))).alias("s")
    )
    roles = ends.groupBy("s.n").agg(F.sum("s.up").alias("ups"), F.min("s.up").alias("lo"))
    return roles.where("ups > 1 OR (ups = 1 AND lo = 0)").isEmpty()


def merge_overlapping(runs: DataFrame, min_iom: float) -> tuple[DataFrame, DataFrame]:
    """Union of masks linked by overlap (intersection over smaller area >= ``min_iom``; any overlap when <= 0)."""
    if not 0.0 <= min_iom <= 1.0:
        raise ValueError("min_iom must be within [0, 1]")
    pairs = mask_iom(runs)
    if min_iom > 0:
        pairs = pairs.where(F.col("iom") >= min_iom)
    groups = mask_groups(mask_areas(runs), pairs)
    return union_masks(runs, groups)


def mask_groups(masks: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(sample_id, inst_id, group_id)`` with one group per component of the pair graph, named by its least id."""
    nodes = masks.select(node_id(F.col("sample_id"), F.col("inst_id")).alias("id"), "sample_id", "inst_id")
    edges = pairs.select(
        node_id(F.col("sample_id"), F.col("a_id")).alias("src"), node_id(F.col("sample_id"), F.col("b_id")).alias("dst"),
        "sample_id", F.floor(F.col("a_id") / 1024).alias("stretch"),
    )
    comp = connected_components(nodes, edges)
    kind = dict(masks.dtypes)
    return comp.select(
        F.col("id.sample_id").cast(kind["sample_id"]).alias("sample_id"),
        F.col("id.inst_id").cast(kind["inst_id"]).alias("inst_id"),
        F.col("comp.inst_id").cast(kind["inst_id"]).alias("group_id"),
    )


RASTER_BITS = 20  # rows and columns below 2**20, samples below 2**23 where a position is one number
SCAN_BITS = 31


def raster_pos(sample: Column, y: Column, x: Column) -> Column:
    """One BIGINT that sorts by sample, then in raster-scan order; a position that does not fit is an error."""
    side = 1 << RASTER_BITS
    fits = (sample >= 0) & (sample < 1 << (63 - 2 * RASTER_BITS)) & (y >= 0) & (y < side) & (x >= 0) & (x < side)
    pos = F.shiftleft(sample.cast("long"), 2 * RASTER_BITS) + F.shiftleft(y.cast("long"), RASTER_BITS) + x.cast("long")
    return F.when(fits, pos).otherwise(F.raise_error(F.lit("sample or pixel beyond the range of raster positions")).cast("long"))


def scan_node(sample: Column, y: Column, x: Column) -> Column:
    """A pixel as a node: its sample and its place in raster-scan order."""
    return F.struct(sample.alias("sample_id"), (F.shiftleft(y.cast("long"), SCAN_BITS) + x.cast("long")).alias("pos"))


def component_runs(runs: DataFrame, connectivity: int) -> DataFrame:
    """Maximal runs with ``comp``, the raster-scan place within the sample of the first pixel of their connected component."""
    spans = round_table(merge_runs(runs, ("sample_id",)))
    adj = run_adjacency(spans, connectivity)
    edges = adj.select(
        scan_node(F.col("sample_id"), F.col("ya"), F.col("xa")).alias("src"),
        scan_node(F.col("sample_id"), F.col("yb"), F.col("xb")).alias("dst"),
        "sample_id",
        F.floor(F.col("ya") / 256).alias("band"),
    )
    nodes = spans.select(scan_node(F.col("sample_id"), F.col("y"), F.col("x0")).alias("id"), "sample_id", "y", "x0", "x1")
    return nodes.join(connected_components(nodes, edges), "id").select("sample_id", "y", "x0", "x1", F.col("comp.pos").alias("comp"))


def label_components(runs: DataFrame, connectivity: int = 1, min_area_px: int = 0) -> DataFrame:
    """Connected components of a pixel set as a label table, ids 1..n per sample in raster order of first pixels."""
    from maskquery.operators.numbering import numbered

    comp = component_runs(runs, connectivity)
    first = comp.groupBy("sample_id", "comp").agg(F.sum(F.col("x1") - F.col("x0")).alias("area"))
    if min_area_px > 0:
        first = first.where(F.col("area") >= min_area_px)
    ids = numbered(first, ["sample_id"], "comp", "inst_id", block=64 << SCAN_BITS)
    return comp.join(ids.select("sample_id", "comp", "inst_id"), ["sample_id", "comp"]).select(
        "sample_id", F.col("inst_id").cast("int").alias("inst_id"), "y", "x0", "x1"
    )


def directed_by_score(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """Pairs turned so that ``hi`` outranks ``lo``: higher float score first, ties by higher id; missing score is 0."""
    s = F.coalesce("score", F.lit(0.0)).cast("float")
    a = scores.select("sample_id", F.col("inst_id").alias("a_id"), s.alias("sa"))
    b = scores.select("sample_id", F.col("inst_id").alias("b_id"), s.alias("sb"))
    p = pairs.join(a, ["sample_id", "a_id"]).join(b, ["sample_id", "b_id"])
    a_wins = F.struct("sa", "a_id") > F.struct(F.col("sb").alias("sa"), F.col("b_id").alias("a_id"))
    return p.select(
        "sample_id",
        F.when(a_wins, F.col("a_id")).otherwise(F.col("b_id")).alias("hi"),
        F.when(a_wins, F.col("b_id")).otherwise(F.col("a_id")).alias("lo"),
        F.greatest("sa", "sb").alias("hi_score"),
    )


def nms(masks: DataFrame, runs: DataFrame, iou_thr: float) -> DataFrame:
    """Masks kept by greedy suppression in score order; a mask goes when its IoU with a kept one exceeds ``iou_thr``.

    Masks without any run (no decodable mask) have no conflicts and stay.
    """
    clash = mask_iou(runs).where(F.col("iou") > iou_thr)
    drop = suppressed(directed_by_score(clash, masks), mask_places(runs))
    if drop is None:
        return masks
    return masks.join(drop.withColumnRenamed("lo", "inst_id"), ["sample_id", "inst_id"], "left_anti")


def greedy_merge(masks: DataFrame, runs: DataFrame, min_ios: float = 0.5, per_class: bool = True) -> tuple[DataFrame, DataFrame]:
    """Greedy merging of sliced detections: a kept mask absorbs the lower-scored ones of its class whose intersection
    over the smaller area reaches ``min_ios``; an absorbed mask goes to its best-ranked keeper."""
    pairs = mask_iom(runs).where(F.col("iom") >= min_ios)
    if per_class:
        cat = lambda n: masks.select("sample_id", F.col("inst_id").alias(n), F.col("category_id").alias(n + "_c"))
        pairs = pairs.join(cat("a_id"), ["sample_id", "a_id"]).join(cat("b_id"), ["sample_id", "b_id"]).where("a_id_c = b_id_c")
    ranked = cut_lineage(directed_by_score(pairs, masks))
    drop = suppressed(ranked, mask_places(runs))
    own = masks.select("sample_id", "inst_id", F.col("inst_id").alias("group_id"))
    if drop is None:
        return union_masks(runs, own)
    gone = drop.withColumnRenamed("lo", "inst_id")
    keep = own.join(gone, ["sample_id", "inst_id"], "left_anti")
    alive = ranked.join(drop.withColumnRenamed("lo", "hi"), ["sample_id", "hi"], "left_anti")
    taken = alive.groupBy("sample_id", F.col("lo").alias("inst_id")).agg(
        F.max(F.struct("hi_score", "hi")).getField("hi").alias("group_id")
    )
    return union_masks(runs, keep.unionByName(taken))
