"""Operators on polygon tables ``(sample_id, feature_id, rings)``: spatial joins, clipping, rasterising, tracing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from maskquery.functions import geometry as GE
from maskquery.operators.graph import label_components
from maskquery.operators.numbering import block_numbered
from maskquery.operators.outlines import trace_rings
from maskquery.operators.runs import merge_runs, paint
from maskquery.session import cut_lineage, spread


def with_bbox(polys: DataFrame) -> DataFrame:
    return polys.withColumn("bbox", GE.ring_bbox(F.col("rings")[0]))


def bbox_pairs(a: DataFrame, b: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """Pairs of rows whose boxes ``(minx, miny, maxx, maxy)`` meet, touching included.

    Both sides are listed under the grid cells they cover and meet by equality on the cell; the pair is kept in the
    cell that holds the lower corner of the common part only, so no deduplication follows. Columns other than the
    keys come out under the structs ``a`` and ``b``.
    """

    def listed(df: DataFrame, name: str) -> DataFrame:
        rng = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
        row = F.struct(*[c for c in df.columns if c not in keys]).alias(name)
        return df.select(*keys, row, F.explode(rng("miny", "maxy")).alias("cy"), "minx", "maxx").select(
            *keys, name, "cy", F.explode(rng("minx", "maxx")).alias("cx")
        )

    j = listed(a, "a").join(listed(b, "b"), [*keys, "cy", "cx"])
    meet = (
        (F.col("a.minx") <= F.col("b.maxx")) & (F.col("b.minx") <= F.col("a.maxx"))
        & (F.col("a.miny") <= F.col("b.maxy")) & (F.col("b.miny") <= F.col("a.maxy"))
    )
    own = (F.floor(F.greatest("a.minx", "b.minx") / cell) == F.col("cx")) & (F.floor(F.greatest("a.miny", "b.miny") / cell) == F.col("cy"))
    return j.where(meet & own).drop("cy", "cx")


def bbox_candidates(boxes: DataFrame, cell: float) -> DataFrame:
    """Unordered pairs of ids whose inclusive boxes meet, ``(sample_id, a_id, b_id)``."""
    p = bbox_pairs(boxes, boxes, ["sample_id"], cell).where("a.inst_id < b.inst_id")
    return p.select("sample_id", F.col("a.inst_id").alias("a_id"), F.col("b.inst_id").alias("b_id"))


def to_image_space(polys: DataFrame) -> DataFrame:
    """Negate y of all features when the whole layer lies at y <= 0; the layer's range is one aggregated row."""
    y = F.flatten(F.transform("rings", lambda r: F.transform(r, lambda p: p["y"])))
    lo, hi = polys.agg(F.min(F.array_min(y)), F.max(F.array_max(y))).first()
    if lo is None or not (hi <= 0 and lo < 0):
        return polys
    return polys.withColumn("rings", GE.flip_y(F.col("rings")))


def clip_features(polys: DataFrame, minx: float, miny: float, maxx: float, maxy: float) -> DataFrame:
    """Features cut to one rectangle; those without an outer ring left are dropped."""
    rings = GE.clipped(F.col("rings"), *[F.lit(float(v)) for v in (minx, miny, maxx, maxy)])
    return polys.select(*[c for c in polys.columns if c != "rings"], rings)


def clip_to_frame(polys: DataFrame, frames: DataFrame) -> DataFrame:
    """Features cut to ``(0, 0, width, height)`` of their sample; zero area is dropped."""
    j = polys.join(frames, "sample_id")
    cut = GE.clipped(F.col("rings"), F.lit(0.0), F.lit(0.0), F.col("width"), F.col("height"))
    return j.select(*[c for c in polys.columns if c != "rings"], cut).where(GE.polygon_area(F.col("rings")) > 0)


def clip_to_patches(polys: DataFrame, patches: DataFrame, cell: float) -> DataFrame:
    """Part of every polygon inside every patch it meets: patch columns, ``feature_id`` and ``rings``.

    Parts with fewer than three distinct points are dropped.
    """
    box = lambda c: [F.col(f"bbox.{n}").alias(n) for n in ("minx", "miny", "maxx", "maxy")]
    a = with_bbox(polys).select("sample_id", "feature_id", "rings", *box("bbox"))
    p = patches.select("*", *[F.col(s).cast("double").alias(d) for s, d in (("x0", "minx"), ("y0", "miny"), ("x1", "maxx"), ("y1", "maxy"))])
    j = bbox_pairs(a, p, ["sample_id"], cell)
    b = [F.col(f"b.{n}") for n in ("minx", "miny", "maxx", "maxy")]
    keep = [F.col(f"b.{c}").alias(c) for c in patches.columns if c != "sample_id"]
    cut = j.select("sample_id", *keep, F.col("a.feature_id").alias("feature_id"), GE.clipped(F.col("a.rings"), *b))
    return cut.where(GE.distinct_points(F.col("rings")[0]) >= 3)


def region_coverage(polys: DataFrame, regions: DataFrame, cell: float) -> DataFrame:
    """Summed polygon area over region area, overlaps counted twice, at most 1, single precision."""
    cut = clip_to_patches(polys, regions, cell)
    s = cut.groupBy("sample_id", "region_idx").agg(F.sum(GE.polygon_area(F.col("rings"))).alias("a"))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    cov = F.least(F.coalesce("a", F.lit(0.0)) / area, F.lit(1.0)).cast("float")
    return regions.join(s, ["sample_id", "region_idx"], "left").select("sample_id", "region_idx", cov.alias("cov"))


def number_annotations(polys: DataFrame) -> DataFrame:
    """Annotations numbered 1..n per sample in feature order, with area and xywh box; needs three points or more."""
    ring = GE.open_ring(GE.orient_ccw(F.col("rings")[0]))
    ok = polys.where(F.size(ring) >= 3)
    num = block_numbered(ok, ["sample_id"], F.floor(F.col("feature_id") / 4096), [F.col("feature_id")], "ann_id")
    b = GE.ring_bbox(F.col("rings")[0])
    return num.select(
        "sample_id", "ann_id", "feature_id", F.lit(1).alias("category_id"), F.lit(0).alias("iscrowd"), ring.alias("segmentation"),
        GE.polygon_area(F.col("rings")).alias("area"), b["minx"].alias("x"), b["miny"].alias("y"), (b["maxx"] - b["minx"]).alias("w"), (b["maxy"] - b["miny"]).alias("h"),
    )


def _edges(polys: DataFrame, keys: list[str]) -> DataFrame:
    """One row per ring side: ``ring``, ``ax, ay, bx, by``."""
    rings = polys.select(*keys, F.posexplode("rings").alias("ring", "r"))
    open_r = rings.select(*keys, "ring", GE.open_ring(F.col("r")).alias("r"))
    nxt = lambda p, i: F.struct(p.alias("a"), F.get(F.col("r"), (i + 1) % F.size("r")).alias("b"))
    e = open_r.select(*keys, "ring", F.explode(F.transform("r", nxt)).alias("e"))
    return e.select(*keys, "ring", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"))


def _x_at(y: Column) -> Column:
    return F.col("ax") + (y - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))


def _crossings(edges: DataFrame, keys: list[str], shift: float) -> DataFrame:
    """Where sides cross the rows' scan lines ``y + shift``, paired from the left: ``(keys, y, a, b)``."""
    lo = F.ceil(F.least("ay", "by") - shift).cast("int")
    hi = F.ceil(F.greatest("ay", "by") - shift).cast("int") - 1
    hit = edges.where("ay <> by").where(hi >= lo).select(*keys, "ax", "ay", "bx", "by", F.explode(F.sequence(lo, hi)).alias("y"))
    xs = hit.select(*keys, "y", _x_at(F.col("y") + shift).alias("a"))
    row = W.partitionBy(*keys, "y").orderBy("a")
    return xs.select(*keys, "y", "a", F.lead("a").over(row).alias("b"), F.row_number().over(row).alias("n")).where("n % 2 = 1").drop("n")


def fill_centres(polys: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of pixels whose centre lies inside (even-odd over all rings, so holes stay empty)."""
    c = _crossings(_edges(polys, keys), keys, 0.5)
    px = lambda n: F.ceil(F.col(n) - 0.5).cast("int")
    return c.select(*keys, "y", px("a").alias("x0"), px("b").alias("x1")).where("x1 > x0")


def fill_inclusive(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of integer points inside a ring or on its outline; ``keys`` must single out one ring."""
    inner = _crossings(edges, keys, 0.0).select(*keys, "y", F.ceil("a").cast("int").alias("x0"), (F.floor("b") + 1).cast("int").alias("x1"))
    flat = F.col("ay") == F.col("by")
    lo, hi = F.least("ay", "by"), F.greatest("ay", "by")
    rows = edges.select(*keys, "ax", "ay", "bx", "by", F.explode(F.sequence(F.ceil(lo - 0.5).cast("int"), F.floor(hi + 0.5).cast("int"))).alias("y"))
    at = lambda d: F.when(flat, F.lit(None)).otherwise(_x_at(F.least(F.greatest(F.col("y") + d, lo), hi)))
    xa = F.when(flat, F.col("ax")).otherwise(at(-0.5))
    xb = F.when(flat, F.col("bx")).otherwise(at(0.5))
    line = rows.select(*keys, "y", F.rint(F.least(xa, xb)).cast("int").alias("x0"), (F.rint(F.greatest(xa, xb)) + 1).cast("int").alias("x1"))
    return merge_runs(inner.unionByName(line).where("x1 > x0"), tuple(keys)).select(*keys, "y", "x0", "x1")


def _near(edges: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Runs of integer points closer than ``width`` to a side: a strip around a segment meets a row in one interval."""
    w2 = width * width
    ys = F.explode(F.sequence((F.floor(F.least("ay", "by") - width) + 1).cast("int"), (F.ceil(F.greatest("ay", "by") + width) - 1).cast("int"))).alias("y")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    sides = edges.select(*keys, "ax", "ay", "bx", "by", dx.alias("dx"), dy.alias("dy"), F.sqrt(dx * dx + dy * dy).alias("len")).where("len > 0")
    dx, dy, length = F.col("dx"), F.col("dy"), F.col("len")
    # each step is a projection of its own, so that what several columns of the next one name is computed once
    e = sides.select("*", ys).withColumn("up", F.col("y") - F.col("ay"))

    def half(cy: str) -> Column:
        h = F.lit(w2) - (F.col("y") - F.col(cy)) * (F.col("y") - F.col(cy))
        return F.when(h > 0, F.sqrt(h))

    # slab |distance to the carrier line| < width, cut to the stretch between the end points: 0 <= (p - a).(b - a) <= len^2 along the row
    c, base = dx * F.col("up"), dy * F.col("up")
    e = e.withColumns({
        "r1": half("ay"), "r2": half("by"), "base": base,
        "s1": F.when(dy != 0, F.col("ax") + (c - length * width) / dy), "s2": F.when(dy != 0, F.col("ax") + (c + length * width) / dy),
        "t1": F.when(dx != 0, F.col("ax") - base / dx), "t2": F.when(dx != 0, F.col("ax") + (length * length - base) / dx),
    })
    flat_ok = (dy == 0) & (F.abs("up") < width)
    e = e.withColumns({
        "slab_lo": F.when(dy != 0, F.least("s1", "s2")).when(flat_ok, F.least("ax", "bx")),
        "slab_hi": F.when(dy != 0, F.greatest("s1", "s2")).when(flat_ok, F.greatest("ax", "bx")),
        "along": (F.col("base") >= 0) & (F.col("base") <= length * length),
    })
    e = e.withColumns({
        "lo": F.when(dx != 0, F.greatest("slab_lo", F.least("t1", "t2"))).when(F.col("along"), F.col("slab_lo")),
        "hi": F.when(dx != 0, F.least("slab_hi", F.greatest("t1", "t2"))).when(F.col("along"), F.col("slab_hi")),
    })
    ok = F.col("hi") > F.col("lo")
    a = F.least(F.col("ax") - F.col("r1"), F.col("bx") - F.col("r2"), F.when(ok, F.col("lo")))
    b = F.greatest(F.col("ax") + F.col("r1"), F.col("bx") + F.col("r2"), F.when(ok, F.col("hi")))
    # open interval (a, b) in integer points; a generator keeps the condition on it from being worked out again below
    run = F.struct((F.floor(a) + 1).cast("int").alias("x0"), F.ceil(b).cast("int").alias("x1"))
    return e.select(*keys, "y", F.inline(F.filter(F.array(run), lambda r: r["x1"] > r["x0"])))


def rasterize(polys: DataFrame, frames: DataFrame, boundary_width: float, flip: bool = False) -> DataFrame:
    """Class runs: all polygons as 2 with holes 0, then the polygons shrunk by ``boundary_width`` as 1; later ones win.

    Vertices are truncated to whole pixels and outlines belong to the polygon. A hole grows when its polygon shrinks.
    """
    keys = ["sample_id", "feature_id", "ring"]
    e = _edges(polys, ["sample_id", "feature_id"])
    t = lambda c, s=1: (F.col(c).cast("int") * s).cast("double").alias(c)
    e = e.select(*keys, t("ax"), t("ay", -1 if flip else 1), t("bx"), t("by", -1 if flip else 1))
    e = cut_lineage(spread(e, "sample_id", "feature_id"))  # a few rows of a polygon cost the work of all its pixels
    full = cut_lineage(fill_inclusive(e, keys))
    near = _near(e, keys, boundary_width)
    lit = lambda p, c: [F.lit(p).alias("pass"), F.when(F.col("ring") == 0, c).otherwise(F.lit(0)).alias("cls")]
    # outer rings lose the strip along their sides, holes gain it
    part = full.select(*keys, "y", "x0", "x1", F.lit(0).alias("k")).unionByName(near.select(*keys, "y", "x0", "x1", F.lit(1).alias("k")))
    shrunk = paint(part.where("ring = 0"), "k", groups=("feature_id", "ring")).where("k = 0")
    grown = merge_runs(part.where("ring > 0"), tuple(keys))
    cols = [*keys, "y", "x0", "x1"]
    layers = full.select(*cols, *lit(1, 2)).unionByName(shrunk.select(*cols, *lit(2, 1))).unionByName(grown.select(*cols, *lit(2, 1)))
    framed = layers.join(frames, "sample_id").where("y >= 0 AND y < height").withColumns(
        {"x0": F.greatest("x0", F.lit(0)), "x1": F.least("x1", F.col("width"))}
    )
    rank = F.struct("pass", "feature_id", "ring", "cls")
    return paint(framed.where("x1 > x0"), "cls", rank).where("cls > 0")


def polygons_to_labels(polys: DataFrame, frames: DataFrame) -> DataFrame:
    """Instance label table of polygons cut to their frames: numbered in order, later ids on top."""
    anns = number_annotations(clip_to_frame(polys, frames))
    flat = anns.select("sample_id", F.col("ann_id").cast("int").alias("inst_id"), F.array("segmentation").alias("rings"))
    return paint(fill_centres(flat, ["sample_id", "inst_id"]), "inst_id")


def shifted_to_origin(polys: DataFrame, origins: DataFrame) -> DataFrame:
    """Polygons of a section once per requested patch, moved so that the patch's origin ``(ox, oy)`` is (0, 0)."""
    j = polys.join(origins, "section_id")
    return j.withColumn("rings", GE.translate(F.col("rings"), -F.col("ox"), -F.col("oy"))).drop("ox", "oy")


def segmentation_to_runs(anns: DataFrame) -> DataFrame:
    """Runs of annotations whose segmentation is a polygon list (``rings``) or a run-length code; others give nothing."""
    from maskquery.operators.runs import rle_decode

    keys = ["sample_id", "inst_id"]
    # every ring of the list is filled on its own, the mask is their union
    each = anns.where(F.size("rings") > 0).select(*keys, F.posexplode("rings").alias("part", "r"))
    polys = fill_centres(each.select(*keys, "part", F.array("r").alias("rings")), [*keys, "part"])
    codes = anns.where("rle IS NOT NULL AND (rings IS NULL OR size(rings) = 0)").select(*keys, "rle.*")
    return merge_runs(polys.select(*keys, "y", "x0", "x1").unionByName(rle_decode(codes, tuple(keys))), tuple(keys))


def segmentation_to_polygons(anns: DataFrame) -> DataFrame:
    """Annotations as polygons, ``sample_id, inst_id, part, rings``.

    Of polygon lists every ring is a part; rings with under three points or without area are dropped. Of run-length masks every
    outer outline is a part, holes are left out. An annotation with both counts as a polygon list.
    """
    r = anns.select("sample_id", "inst_id", F.posexplode("rings").alias("part", "ring"))
    ok = (F.size("ring") >= 3) & (GE.distinct_points(F.col("ring")) >= 3) & (F.abs(GE.signed_area(F.col("ring"))) > 0)
    lists = r.where(ok).select("sample_id", "inst_id", "part", F.array("ring").alias("rings"))
    if "rle" not in anns.columns:
        return lists
    codes = segmentation_to_runs(anns.where("rings IS NULL AND rle IS NOT NULL"))
    traced = trace_rings(codes, ["sample_id", "inst_id"], flip=False)
    outer = F.filter("rings", lambda ring: GE.signed_area(ring) > 0)
    parts = traced.select("sample_id", "inst_id", F.posexplode(outer).alias("part", "ring"))
    return lists.unionByName(parts.select("sample_id", "inst_id", "part", F.array("ring").alias("rings")))


def vectorize_components(runs: DataFrame, class_value: int, min_area: int = 0, flip: bool = True) -> DataFrame:
    """8-connected components of a pixel set as polygons with component id, class and pixel area."""
    labels = cut_lineage(label_components(runs, connectivity=2))
    area = labels.groupBy("sample_id", "inst_id").agg(F.sum(F.col("x1") - F.col("x0")).cast("long").alias("pixel_area"))
    big = area.where(F.col("pixel_area") >= min_area)
    traced = trace_rings(labels.join(big, ["sample_id", "inst_id"], "left_semi"), ["sample_id", "inst_id"], flip)
    return traced.join(big, ["sample_id", "inst_id"]).select(
        "sample_id", F.col("inst_id").alias("component_id"), F.lit(class_value).alias("class_value"), "pixel_area", "rings", "sides"
    )


def rle_to_polygons(masks: DataFrame, keys: list[str]) -> DataFrame:
    """Masks as polygons in section coordinates: the tile's offset is added and y is always negated."""
    from maskquery.operators.runs import rle_decode

    runs = rle_decode(masks.select(*keys, "rle.*"), tuple(keys)).join(masks.select(*keys, "tile_x", "tile_y"), keys)
    moved = runs.select(*keys, (F.col("y") + F.col("tile_y")).alias("y"), (F.col("x0") + F.col("tile_x")).alias("x0"), (F.col("x1") + F.col("tile_x")).alias("x1"))
    return trace_rings(moved, keys, flip=True)


def polygons_to_rle(polys: DataFrame, keys: list[str], height: Column, width: Column) -> DataFrame:
    """Polygons (y negative down) as run-length masks of a frame; vertices are rounded, empty masks dropped."""
    from maskquery.operators.runs import rle_encode

    snap = GE.map_points(F.col("rings"), lambda p: GE.point(F.rint(p["x"]), -F.rint(p["y"])))
    filled = fill_centres(polys.withColumn("rings", snap), keys)
    framed = filled.join(polys.select(*keys, height.alias("height"), width.alias("width")), keys).where("y >= 0 AND y < height")
    cut = framed.withColumns({"x0": F.greatest("x0", F.lit(0)), "x1": F.least("x1", F.col("width"))}).where("x1 > x0")
    return rle_encode(cut, tuple(keys))


def resize_nearest(runs: DataFrame, keys: list[str], from_hw: tuple[int, int], to_hw: tuple[int, int]) -> DataFrame:
    """Runs of masks enlarged or reduced by nearest neighbour: output pixel p shows input pixel floor(p * from / to)."""
    (h, w), (th, tw) = from_hw, to_hw
    up = lambda c, a, b: F.ceil(c * b / a).cast("int")
    if "y1" in runs.columns:  # strips stay strips
        rest = [c for c in runs.columns if c not in ("y", "y1", "x0", "x1")]
        sides = [up(F.col(c), *s).alias(c) for c, s in (("y", (h, th)), ("y1", (h, th)), ("x0", (w, tw)), ("x1", (w, tw)))]
        return runs.select(*rest, *sides).where("x1 > x0 AND y1 > y")
    rows = F.explode(F.sequence(up(F.col("y"), h, th), up(F.col("y") + 1, h, th) - 1)).alias("y")
    tall = runs.where(up(F.col("y") + 1, h, th) > up(F.col("y"), h, th))
    rest = [c for c in runs.columns if c not in ("y", "x0", "x1")]
    return tall.select(*rest, rows, up(F.col("x0"), w, tw).alias("x0"), up(F.col("x1"), w, tw).alias("x1")).where("x1 > x0")
