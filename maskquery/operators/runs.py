"""Mask algebra on run tables.

A run row is ``(sample_id, side, inst_id, y, x0, x1)`` with half-open ``[x0, x1)``. Row-level work is keyed by
``(sample_id, y, cell)``, where a cell is a fixed stretch of columns: no key ever holds a whole sample, so a
section with a third of all masks still spreads over every task.

A strip row ``(..., y, y1, x0, x1)`` stands for the equal runs of the rows ``[y, y1)``. Painting, pairing and unions move strips by
tile, a band of rows by a cell, and take run tables as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

CELL = 64
BAND = 64
BOX = ("y", "y1", "x0", "x1")


def boxes_to_runs(boxes: DataFrame) -> DataFrame:
    """Expand half-open boxes ``(x0, y0, x1, y1)`` to one run per row."""
    keep = [c for c in boxes.columns if c not in ("x0", "y0", "x1", "y1")]
    rows = F.explode(F.sequence("y0", F.col("y1") - 1)).alias("y")
    return boxes.where("x1 > x0 AND y1 > y0").select(*keep, rows, "x0", "x1")


def split_to_cells(runs: DataFrame, cell: int = CELL) -> DataFrame:
    """Cut runs at cell borders, so that equal ``(sample_id, y, cell)`` holds every chance of overlap."""
    keep = [c for c in runs.columns if c not in ("x0", "x1")]
    first = F.floor(F.col("x0") / cell)
    last = F.floor((F.col("x1") - 1) / cell)
    cut = runs.where("x1 > x0").select(*keep, "x0", "x1", F.explode(F.sequence(first, last)).alias("cell"))
    return cut.select(
        *keep,
        "cell",
        F.greatest("x0", (F.col("cell") * cell).cast("int")).alias("x0"),
        F.least("x1", ((F.col("cell") + 1) * cell).cast("int")).alias("x1"),
    )


def by_cell(runs: DataFrame, cell: int = CELL) -> DataFrame:
    """Cell-cut runs, placed once by ``(sample_id, y, cell)``; joins, windows and groupings on that key reuse it."""
    return split_to_cells(runs, cell).repartition("sample_id", "y", "cell")


def as_strips(runs: DataFrame) -> DataFrame:
    """``runs`` with ``y1``: a strip is a stack of equal runs on the rows ``[y, y1)``, a run alone is a strip of one row."""
    return runs if "y1" in runs.columns else runs.withColumn("y1", F.col("y") + 1)


def as_runs(strips: DataFrame) -> DataFrame:
    """Strips as one run per row."""
    if "y1" not in strips.columns:
        return strips
    keep = [F.explode(F.sequence("y", F.col("y1") - 1)).alias("y") if c == "y" else c for c in strips.columns if c != "y1"]
    return strips.where("y1 > y").select(*keep)


def split_to_bands(strips: DataFrame, band: int = BAND) -> DataFrame:
    """Cut strips at the borders of bands of rows."""
    keep = [c for c in strips.columns if c not in ("y", "y1")]
    at = F.explode(F.sequence(F.floor(F.col("y") / band), F.floor((F.col("y1") - 1) / band))).alias("band")
    cut = strips.where("y1 > y").select(*keep, "y", "y1", at)
    return cut.select(
        *keep,
        "band",
        F.greatest("y", (F.col("band") * band).cast("int")).alias("y"),
        F.least("y1", ((F.col("band") + 1) * band).cast("int")).alias("y1"),
    )


def split_to_tiles(runs: DataFrame) -> DataFrame:
    """Runs or strips cut at the borders of tiles, each a ``band`` of rows by a ``cell`` of columns."""
    return split_to_bands(split_to_cells(as_strips(runs)))


def _spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``start[i], start[i] + 1, ...``, ``n[i]`` numbers for every ``i``."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


def _paint_tiles(tile: np.ndarray, box: np.ndarray, code: np.ndarray, codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strips of what is seen when strips are painted in row order; ``box`` holds y, y1, x0, x1 within the tile. Some tiles at a time."""
    out = []
    for lo in range(0, int(tile[-1]) + 1, 256):
        at = slice(*np.searchsorted(tile, [lo, lo + 256]))
        y, y1, x0, x1 = box[:, at]
        line = _spans((tile[at] - lo) * BAND + y, y1 - y)
        n, wide = np.repeat(code[at], y1 - y), np.repeat(x1 - x0, y1 - y)
        raster = np.full((min(int(tile[-1]) + 1 - lo, 256) * BAND, CELL), -1, np.int64)
        raster.ravel()[_spans(line * CELL + np.repeat(x0, y1 - y), wide)] = np.repeat(n, wide)
        new = np.ones((len(raster), CELL + 1), bool)
        np.not_equal(raster[:, 1:], raster[:, :-1], out=new[:, 1:-1])
        line, x0 = np.nonzero(new[:, :-1] & (raster >= 0))
        x1 = np.nonzero(new[:, 1:] & (raster >= 0))[1] + 1
        # equal runs of a label on successive rows follow each other in this order
        k = (((line // BAND * codes + raster[line, x0]) * CELL + x0) * (CELL + 1) + x1) * (2 * BAND) + line % BAND
        k.sort()
        first = np.diff(k, prepend=-2) != 1
        last = np.append(first[1:], True)
        y, rest = k[first] % (2 * BAND), k[first] // (2 * BAND)
        rest, x1 = np.divmod(rest, CELL + 1)
        rest, x0 = np.divmod(rest, CELL)
        t, c = np.divmod(rest, codes)
        out.append((t + lo, np.stack([y, k[last] % (2 * BAND) + 1, x0, x1]), c))
    return tuple(np.concatenate([o[i] for o in out], axis=-1) for i in range(3))


def changes(column: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before it."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    if pa.types.is_nested(column.type):
        return np.array([x != y for x, y in zip(a.to_pylist(), b.to_pylist())], bool)
    differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
    return differ.to_numpy(zero_copy_only=False)


def _painted(batches: Iterator[pa.RecordBatch], key: list[str], label: str) -> Iterator[pa.RecordBatch]:
    """Paint strips that come by tile, lowest rank first. What is painted of a batch's last tile goes in front of the next batch."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        table = table.combine_chunks()
        if not len(table):
            continue
        new = np.zeros(len(table), bool)
        for c in key:
            new[1:] |= changes(pa.concat_arrays(table[c].chunks))
        tile = np.cumsum(new)
        head = np.flatnonzero(np.diff(tile, prepend=-1))
        corner = [table["band"].to_numpy() * BAND] * 2 + [table["cell"].to_numpy() * CELL] * 2
        box = np.stack([table[c].to_numpy().astype(np.int64) - o for c, o in zip(BOX, corner)])
        names = pc.dictionary_encode(pa.concat_arrays(table[label].chunks))
        t, box, code = _paint_tiles(tile, box, names.indices.to_numpy().astype(np.int64), len(names.dictionary))
        row = head[t]
        cols = {c: table[c].take(pa.array(row)) for c in key}
        cols |= {c: pa.array(v + o[row], table.schema.field(c).type) for c, v, o in zip(BOX, box, corner)}
        cols[label] = names.dictionary.take(pa.array(code))
        out = pa.table(cols, schema=table.schema)
        ready = int(np.searchsorted(t, tile[-1]))
        rest = out.slice(ready)
        yield from out.slice(0, ready).to_batches()
    if rest is not None:
        yield from rest.to_batches()


def paint_strips(runs: DataFrame, label: str, rank: Column | None = None, groups: tuple[str, ...] = ()) -> DataFrame:
    """Disjoint strips in which each pixel carries the ``label`` of the covering run or strip with the greatest ``rank``.

    Without ``rank`` the greatest label wins; a given rank must be unique per label (a struct ending in the label).
    ``groups`` keeps independent layers (such as ground truth and prediction) apart. The result stays cut at tiles.

    One shuffle of strips by tile. A tile's strips come in rank order and are painted as a stream, so that a task holds one tile's
    raster and a batch of strips however many masks are stacked there.
    """
    key = ["sample_id", *groups, "band", "cell"]
    by = [] if rank is None else [rank.alias("_rank")]
    used = runs.where(F.col(label).isNotNull()).select("sample_id", *groups, *(["y", "y1"] if "y1" in runs.columns else ["y"]), "x0", "x1", label, *by)
    cols = [*key, *BOX, *([] if label in key else [label])]
    placed = split_to_tiles(used).repartition("sample_id", "band", "cell").sortWithinPartitions(*key, "_rank" if by else label).select(*cols)
    return placed.mapInArrow(lambda it: _painted(it, key, label), placed.schema)


def paint(runs: DataFrame, label: str, rank: Column | None = None, groups: tuple[str, ...] = ()) -> DataFrame:
    """``paint_strips`` as one run per row."""
    rows = as_runs(paint_strips(runs, label, rank, groups))
    return rows.select("sample_id", *groups, "y", "cell", "x0", "x1", label)


def paint_by_id(runs: DataFrame, groups: tuple[str, ...] = ("side",)) -> DataFrame:
    """Ascending ids, later paint wins: a pixel belongs to its greatest id. Strips give strips, runs give runs."""
    return (paint_strips if "y1" in runs.columns else paint)(runs, "inst_id", groups=groups)


def paint_by_score(runs: DataFrame, groups: tuple[str, ...] = ("side",)) -> DataFrame:
    """Ascending score (missing counts as 0), ties by input position: the best-scored mask is on top. Strips give strips."""
    rank = F.struct(F.coalesce("score", F.lit(0.0)).alias("s"), F.col("inst_id").alias("i"))
    return (paint_strips if "y1" in runs.columns else paint)(runs, "inst_id", rank, groups)


def rows_of(runs: DataFrame) -> Column:
    """How many rows a row of the table stands for."""
    return F.col("y1") - F.col("y") if "y1" in runs.columns else F.lit(1)


def instance_stats(runs: DataFrame, key: tuple[str, ...] = ("sample_id", "side", "inst_id")) -> DataFrame:
    """Area and tight half-open bounds of each instance of a disjoint run or strip table."""
    return runs.groupBy(*key).agg(
        F.sum((F.col("x1") - F.col("x0")) * rows_of(runs)).alias("area"),
        F.min("x0").alias("min_x"),
        F.min("y").alias("min_y"),
        F.max("x1").alias("max_x"),
        F.max("y1").alias("max_y") if "y1" in runs.columns else (F.max("y") + 1).alias("max_y"),
    )


def _shared(a: str, b: str) -> Column:
    return F.least(f"{a}.x1", f"{b}.x1") - F.greatest(f"{a}.x0", f"{b}.x0")


def _touch(a: str, b: str) -> Column:
    return (F.col(f"{a}.x0") < F.col(f"{b}.x1")) & (F.col(f"{b}.x0") < F.col(f"{a}.x1"))


def _shared_rows(a: str, b: str) -> Column:
    return F.least(f"{a}.y1", f"{b}.y1") - F.greatest(f"{a}.y", f"{b}.y")


def _touch_rows(a: str, b: str) -> Column:
    return (F.col(f"{a}.y") < F.col(f"{b}.y1")) & (F.col(f"{b}.y") < F.col(f"{a}.y1"))


def overlap_pixels(runs: DataFrame) -> DataFrame:
    """``|A and B|`` of every overlapping unordered pair within a sample: an interval self-join inside cells of runs, inside tiles of strips."""
    strips = "y1" in runs.columns
    used = runs.select("sample_id", "inst_id", *(BOX if strips else ("y", "x0", "x1")))
    place = ("sample_id", "band", "cell") if strips else ("sample_id", "y", "cell")
    cells = split_to_tiles(used).repartition(*place) if strips else by_cell(used)
    a, b = cells.alias("a"), cells.alias("b")
    on = [*(F.col(f"a.{k}") == F.col(f"b.{k}") for k in place), F.col("a.inst_id") < F.col("b.inst_id"), _touch("a", "b")]
    hit = a.join(b, [*on, _touch_rows("a", "b")] if strips else on)
    inter = _shared("a", "b") * _shared_rows("a", "b") if strips else _shared("a", "b")
    return hit.groupBy(
        F.col("a.sample_id").alias("sample_id"), F.col("a.inst_id").alias("a_id"), F.col("b.inst_id").alias("b_id")
    ).agg(F.sum(inter).cast("long").alias("inter"))


def with_areas(pairs: DataFrame, areas: DataFrame) -> DataFrame:
    """Attach both areas to pairs ``(sample_id, a_id, b_id)``."""
    a = areas.select("sample_id", F.col("inst_id").alias("a_id"), F.col("area").alias("a_area"))
    b = areas.select("sample_id", F.col("inst_id").alias("b_id"), F.col("area").alias("b_area"))
    return pairs.join(a, ["sample_id", "a_id"]).join(b, ["sample_id", "b_id"])


def iou(inter: Column, a: Column, b: Column) -> Column:
    union = a + b - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def mask_iou(runs: DataFrame) -> DataFrame:
    """IoU of overlapping pairs; pairs that are absent have IoU 0."""
    areas = mask_areas(runs)
    p = with_areas(overlap_pixels(runs), areas)
    return p.withColumn("iou", iou(F.col("inter"), F.col("a_area"), F.col("b_area")))


def mask_iom(runs: DataFrame) -> DataFrame:
    """Intersection over the smaller area."""
    p = with_areas(overlap_pixels(runs), mask_areas(runs))
    return p.withColumn("iom", F.col("inter") / F.least("a_area", "b_area"))


def mask_areas(runs: DataFrame) -> DataFrame:
    return runs.groupBy("sample_id", "inst_id").agg(F.sum((F.col("x1") - F.col("x0")) * rows_of(runs)).cast("long").alias("area"))


def label_pairs(gt: DataFrame, dt: DataFrame) -> DataFrame:
    """Pixels shared by each (true, predicted) pair of two disjoint label tables, both cell-cut runs or both strips cut at tiles."""
    strips = "y1" in gt.columns
    place = ("sample_id", "band", "cell") if strips else ("sample_id", "y", "cell")
    cols = (*place, "inst_id", "x0", "x1", *(("y", "y1") if strips else ()))
    a, b = gt.select(*cols).alias("a"), dt.select(*cols).alias("b")
    on = [*(F.col(f"a.{k}") == F.col(f"b.{k}") for k in place), _touch("a", "b")]
    inter = _shared("a", "b") * _shared_rows("a", "b") if strips else _shared("a", "b")
    return (
        a.join(b, [*on, _touch_rows("a", "b")] if strips else on)
        .groupBy(
            F.col("a.sample_id").alias("sample_id"), F.col("a.inst_id").alias("gt_id"), F.col("b.inst_id").alias("dt_id")
        )
        .agg(F.sum(inter).cast("long").alias("inter"))
    )


def merge_runs(runs: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Maximal runs of the union of all runs that share ``key`` and row ``y`` (gaps and islands)."""
    row = W.partitionBy(*key, "y").orderBy("x0", "x1")
    reach = F.max("x1").over(row.rowsBetween(W.unboundedPreceding, -1))
    starts = runs.select(*key, "y", "x0", "x1", (reach.isNull() | (F.col("x0") > reach)).cast("int").alias("s"))
    isl = starts.withColumn("isl", F.sum("s").over(row.rowsBetween(W.unboundedPreceding, 0)))
    return isl.groupBy(*key, "y", "isl").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("isl")


def union_masks(runs: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pixel union per group.

    ``runs`` may be strips. ``groups`` maps ``(sample_id, inst_id)`` to ``group_id``. Returns the union's runs and one row per group with
    area, tight bounds, number of members and the first member, whose attributes the union inherits.
    """
    grouped = runs.join(groups, ["sample_id", "inst_id"])
    if "y1" in runs.columns:  # the strips of a group's band meet and become runs only there
        bands = split_to_bands(grouped.select("sample_id", "group_id", *BOX)).repartition("sample_id", "group_id", "band")
        merged = merge_runs(as_runs(bands), ("sample_id", "group_id", "band")).drop("band")
    else:
        merged = merge_runs(grouped, ("sample_id", "group_id"))
    members = groups.groupBy("sample_id", "group_id").agg(
        F.min("inst_id").alias("first_id"), F.count(F.lit(1)).alias("members")
    )
    stats = instance_stats(merged, ("sample_id", "group_id")).join(members, ["sample_id", "group_id"])
    return merged, stats


def drop_small_components(runs: DataFrame, min_area_px: int, relabel: bool = True) -> DataFrame:
    """Drop instances under ``min_area_px`` and number the rest 1..n in old-id order; nothing happens at <= 0."""
    if min_area_px <= 0:
        return runs
    from maskquery.operators.numbering import numbered

    big = mask_areas(runs).where(F.col("area") >= min_area_px).select("sample_id", "inst_id")
    if not relabel:
        return runs.join(big, ["sample_id", "inst_id"], "left_semi")
    ids = numbered(big, ["sample_id"], "inst_id", "new_id")
    return runs.join(ids, ["sample_id", "inst_id"]).drop("inst_id").withColumnRenamed("new_id", "inst_id")


def relabel_sequential(runs: DataFrame) -> DataFrame:
    """New ids 1..n by old id, per sample."""
    return drop_small_components(runs, 1)


def _encoded(batches: Iterator[pa.RecordBatch], key: list[str], types: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Counts of masks whose strips are listed in ``rs``, all masks of a batch at once."""
    for batch in batches:
        if not batch.num_rows:
            continue
        listed = batch.column("rs")
        y, y1, x0, x1 = (np.asarray(pc.struct_field(listed.flatten(), c)).astype(np.int64) for c in BOX)
        h, w = (batch.column(c).to_numpy().astype(np.int64) for c in ("h", "w"))
        own = np.repeat(np.arange(len(listed)), pc.list_value_length(listed).to_numpy())
        row, own = _spans(y, y1 - y), np.repeat(own, y1 - y)
        start, end = row * w[own] + np.repeat(x0, y1 - y), row * w[own] + np.repeat(x1, y1 - y)
        order = np.lexsort((start, own))
        far = int(end.max()) + 1  # masks one after the other on a line, none reaching the next
        start, end, own = start[order] + own[order] * far, end[order] + own[order] * far, own[order]
        reach = np.maximum.accumulate(end)
        first = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))  # runs that meet over a row border are one
        o, x0, x1 = own[first], start[first], reach[np.append(first[1:], len(own)) - 1]
        n = np.bincount(o, minlength=len(listed))
        at = np.cumsum(n) - n
        gap = x0 - np.append(0, x1[:-1])
        gap[at] = x0[at] - np.arange(len(listed)) * far
        tail = h * w - (x1[at + n - 1] - np.arange(len(listed)) * far)
        offsets = np.append(0, np.cumsum(2 * n + (tail > 0)))
        values = np.zeros(offsets[-1], np.int64)
        to = offsets[o] + 2 * (np.arange(len(o)) - at[o])
        values[to], values[to + 1] = gap, x1 - x0
        values[offsets[1:][tail > 0] - 1] = tail[tail > 0]
        counts = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in (*key, "h", "w")] + [counts.cast(types.field("counts").type)], schema=types)


def rle_encode(runs: DataFrame, key: tuple[str, ...], height: str = "height", width: str = "width") -> DataFrame:
    """Row-major counts, zero run first, of one mask per ``key``; rows carry the mask's ``height`` and ``width``.

    Strips are taken as well and stay strips until a mask's are together. The counts array is the value itself, so one mask's runs
    meet in one row. An all-zero mask is not in a run table.
    """
    listed = as_strips(runs).where("x1 > x0 AND y1 > y").groupBy(*key).agg(
        F.max(height).alias("h"), F.max(width).alias("w"), F.collect_list(F.struct(*BOX)).alias("rs")
    )
    cols = list(key)
    schema = StructType([*listed.drop("rs").schema.fields, StructField("counts", ArrayType(LongType()))])
    types = to_arrow_schema(schema)
    coded = listed.mapInArrow(lambda it: _encoded(it, cols, types), schema)
    return coded.select(*key, F.array("h", "w").alias("size"), "counts", F.lit("C").alias("order"))


def _decoded(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.RecordBatch]:
    """The stretches ``a`` to ``b`` of line ``n`` that are set in masks given as counts; lines are columns for order "F"."""
    for batch in batches:
        counts = batch.column("counts")
        n = pc.fill_null(pc.list_value_length(counts), 0).to_numpy().astype(np.int64)
        c = pc.fill_null(counts.flatten(), 0).to_numpy().astype(np.int64)
        own, at = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
        total = np.append(0, np.cumsum(c))
        end = total[1:] - total[at[own]]
        on = ((np.arange(len(c)) - at[own]) % 2 == 1) & (c > 0)  # odd positions are set pixels
        own, end, start = own[on], end[on], (end - c)[on]
        line = batch.column("line").to_numpy()[own].astype(np.int64)
        first = start // line
        k = (end - 1) // line - first + 1
        no, line, own = _spans(first, k), np.repeat(line, k), np.repeat(own, k)
        a, b = np.maximum(np.repeat(start, k) - no * line, 0), np.minimum(np.repeat(end, k) - no * line, line)
        for lo in range(0, len(own), 1 << 16):
            s = slice(lo, lo + (1 << 16))
            cols = [batch.column(x).take(pa.array(own[s])) for x in (*key, "order")]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(v[s].astype(np.int32)) for v in (no, a, b)], [*key, "order", "n", "a", "b"])


def rle_decode(rles: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Runs of masks given as ``size``, ``counts`` and ``order`` ("C" row-major, "F" column-major).

    A leading pair of zero counts drops one of them. Runs are split at row borders; column-major masks decode to
    column runs first and are then re-cut by row.
    """
    c = F.col("counts")
    fixed = F.when((F.size(c) >= 2) & (c[0] == 0) & (c[1] == 0), F.slice(c, 2, F.size(c) - 1)).otherwise(c)
    h, w = F.col("size")[0], F.col("size")[1]
    coded = rles.select(*key, "order", F.when(F.col("order") == "F", h).otherwise(w).cast("long").alias("line"), fixed.alias("counts"))
    cols = list(key)
    schema = StructType([*coded.select(*key, "order").schema.fields, *(StructField(c, IntegerType()) for c in ("n", "a", "b"))])
    decoded = lambda some: coded.where(f"line > 0 AND counts IS NOT NULL AND {some}").mapInArrow(lambda it: _decoded(it, cols), schema)
    rows = decoded("order <> 'F'").select(*key, F.col("n").alias("y"), F.col("a").alias("x0"), F.col("b").alias("x1"))
    stood = decoded("order = 'F'").select(
        *key,
        F.explode(F.sequence(F.col("a"), F.col("b") - 1)).alias("y"),
        F.col("n").alias("x0"),
        (F.col("n") + 1).alias("x1"),
    )
    return rows.unionByName(merge_runs(stood, key).select(*rows.columns))


def dilate(runs: DataFrame, iterations: int | Column, frames: DataFrame) -> DataFrame:
    """8-neighbour dilation: each run grows by ``iterations`` in every direction, bounded by its frame."""
    if isinstance(iterations, int) and iterations <= 0:
        return merge_runs(runs, ("sample_id",))
    n = F.lit(iterations) if isinstance(iterations, int) else iterations
    grown = runs.join(frames, "sample_id").select(
        "sample_id",
        "height",
        F.greatest(F.col("x0") - n, F.lit(0)).alias("x0"),
        F.least(F.col("x1") + n, F.col("width")).alias("x1"),
        F.explode(F.sequence(F.col("y") - n, F.col("y") + n)).alias("y"),
    )
    return merge_runs(grown.where("y >= 0 AND y < height"), ("sample_id",))


def run_adjacency(runs: DataFrame, connectivity: int, cell: int = CELL) -> DataFrame:
    """Pairs of maximal runs ``(sample_id, y, x0)`` / ``(y + 1, x0)`` that touch; 2 widens by one pixel (8-connected)."""
    if connectivity not in (1, 2):
        raise ValueError("connectivity must be 1 or 2")
    wide = connectivity - 1
    rs = runs.select("sample_id", "y", "x0", "x1")
    up = rs.select("sample_id", (F.col("y") + 1).alias("y"), "x0", "x1", F.col("x0").alias("ax"))
    down = rs.select(
        "sample_id", "y", (F.col("x0") - wide).alias("x0"), (F.col("x1") + wide).alias("x1"), F.col("x0").alias("bx")
    )
    a, b = split_to_cells(up, cell).alias("a"), split_to_cells(down, cell).alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("sample_id", "y", "cell")]
    # a pair met in several cells is kept in the first one only
    owner = F.floor(F.greatest(F.col("a.ax"), F.col("b.bx") - wide) / cell) == F.col("a.cell")
    hit = a.join(b, [*same, _touch("a", "b")]).where(owner)
    return hit.select(
        F.col("a.sample_id").alias("sample_id"),
        (F.col("a.y") - 1).alias("ya"),
        F.col("a.ax").alias("xa"),
        F.col("a.y").alias("yb"),
        F.col("b.bx").alias("xb"),
    )
