"""Ring geometry as column expressions on arrays of ``struct<x: double, y: double>``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

RING = "array<struct<x:double,y:double>>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Closed ring of a rectangle."""
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _next(r: Column) -> Column:
    return F.concat(F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1))


def signed_area(r: Column) -> Column:
    """Shoelace area, positive for counter-clockwise rings; closed and open rings alike."""
    cross = F.zip_with(r, _next(r), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.aggregate(cross, F.lit(0.0), lambda s, v: s + v) / 2.0


def polygon_area(rings: Column) -> Column:
    """Area of the outer ring minus its holes."""
    areas = F.transform(rings, lambda r, i: F.abs(signed_area(r)) * F.when(i == 0, 1.0).otherwise(-1.0))
    return F.aggregate(areas, F.lit(0.0), lambda s, v: s + v)


def ring_bbox(r: Column) -> Column:
    xs, ys = F.transform(r, lambda p: p["x"]), F.transform(r, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy")
    )


def open_ring(r: Column) -> Column:
    """Ring without its repeated last point."""
    closed = (F.size(r) > 1) & (F.get(r, F.lit(0)) == F.element_at(r, -1))
    return F.when(closed, F.slice(r, F.lit(1), F.size(r) - 1)).otherwise(r)


def close_ring(r: Column) -> Column:
    opened = (F.size(r) > 0) & (F.get(r, F.lit(0)) != F.element_at(r, -1))
    return F.when(opened, F.concat(r, F.slice(r, 1, 1))).otherwise(r)


def orient_ccw(r: Column) -> Column:
    return F.when(signed_area(r) < 0, F.reverse(r)).otherwise(r)


def canonical_ring(r: Column) -> Column:
    """Open counter-clockwise ring that starts at its least point."""

    def turned(o: Column) -> Column:
        return let(F.array_position(o, F.array_min(o)).cast("int"), lambda at: F.concat(F.slice(o, at, F.size(o)), F.slice(o, F.lit(1), at - 1)))

    return let(let(r, orient_ccw), lambda c: let(open_ring(c), turned))


def distinct_points(r: Column) -> Column:
    return F.size(F.array_distinct(r))


def dedupe_consecutive(r: Column) -> Column:
    """Drop entries equal to the one before."""
    return F.filter(r, lambda p, i: (i == 0) | (p != F.get(r, i - 1)))


def map_points(rings: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(rings, lambda r: F.transform(r, f))


def translate(rings: Column, dx: Column, dy: Column) -> Column:
    return map_points(rings, lambda p: point(p["x"] + dx, p["y"] + dy))


def flip_y(rings: Column) -> Column:
    return map_points(rings, lambda p: point(p["x"], F.lit(0.0) - p["y"]))


def _clip_half(pts: Column, edge: Column) -> Column:
    """Keep the part of an open ring on the inner side of one axis-parallel line."""
    at, sign = edge["at"], edge["sign"]
    coord = lambda p: F.when(edge["on_x"], p["x"]).otherwise(p["y"])
    inside = lambda p: sign * (coord(p) - at) >= 0

    def meet(a: Column, b: Column) -> Column:
        t = (at - coord(a)) / F.when(coord(b) == coord(a), F.lit(1.0)).otherwise(coord(b) - coord(a))
        x = F.when(edge["on_x"], at).otherwise(a["x"] + t * (b["x"] - a["x"]))
        y = F.when(edge["on_x"], a["y"] + t * (b["y"] - a["y"])).otherwise(at)
        return point(x, y)

    def step(cur: Column, i: Column) -> Column:
        prev = F.get(pts, F.when(i == 0, F.size(pts) - 1).otherwise(i - 1))
        return (
            F.when(inside(cur) & inside(prev), F.array(cur))
            .when(inside(cur), F.array(meet(prev, cur), cur))
            .when(inside(prev), F.array(meet(prev, cur)))
            .otherwise(F.array().cast(RING))
        )

    return F.flatten(F.transform(pts, step))


def clip_ring(ring: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Ring cut to a rectangle, sides in the order left, right, low, high; empty when fewer than four coordinates remain."""
    side = lambda on_x, sign, at: F.struct(
        F.lit(on_x).alias("on_x"), F.lit(sign).alias("sign"), at.cast("double").alias("at")
    )
    sides = F.array(side(True, 1.0, minx), side(True, -1.0, maxx), side(False, 1.0, miny), side(False, -1.0, maxy))
    cut = F.aggregate(sides, open_ring(ring).cast(RING), lambda pts, e: _clip_half(pts, e).cast(RING), lambda pts: close_ring(dedupe_consecutive(pts)))
    usable = (F.size(ring) >= 3) & (F.size(open_ring(ring)) >= 3)
    none = F.array().cast(RING)
    return F.when(usable, F.transform(F.array(cut), lambda c: F.when(F.size(c) >= 4, c).otherwise(none))[0]).otherwise(none)


def clip_rings(rings: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Polygon cut to a rectangle: null without an outer ring; holes are cut on their own and vanish when empty.

    A polygon that lies inside the rectangle is passed on as it is, without touching its sides.
    """
    xs = F.transform(F.get(rings, F.lit(0)), lambda p: p["x"])
    ys = F.transform(F.get(rings, F.lit(0)), lambda p: p["y"])
    inside = (F.array_min(xs) >= minx) & (F.array_max(xs) <= maxx) & (F.array_min(ys) >= miny) & (F.array_max(ys) <= maxy)
    cut = F.transform(rings, lambda r: clip_ring(r, minx, miny, maxx, maxy))
    kept = F.transform(
        F.array(cut), lambda c: F.when(F.size(F.get(c, F.lit(0))) > 0, F.filter(c, lambda r: F.size(r) > 0))
    )
    whole = inside & (F.size(F.get(rings, F.lit(0))) >= 4) & (distinct_points(F.get(rings, F.lit(0))) >= 3)
    return F.when(whole, F.transform(rings, close_ring)).when(F.size(rings) > 0, F.get(kept, F.lit(0)))


def clipped(rings: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Generator of the non-null ``clip_rings``: drops empty results and computes each polygon once."""
    return F.explode(F.filter(F.array(clip_rings(rings, minx, miny, maxx, maxy)), lambda r: r.isNotNull())).alias("rings")
