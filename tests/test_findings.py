"""Queries of earlier findings against their SQL, at the smallest scale."""

import compare
import pytest

from maskquery.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["a22_flatten_metric_sections"])
def test_matches_sql(spark, name):
    msg, rows, _, _ = compare.check(spark, compare.duck(SF), SF, catalog.QUERIES[name], catalog.ORACLES[name])
    assert msg is None and rows > 0


@pytest.mark.parametrize(
    "name, columns",
    [
        ("d3_iou_pairs", {"sample_id", "gt_id", "dt_id", "inter", "iou"}),
        ("c12_run_adjacency", {"sample_id", "ya", "xa", "yb", "xb"}),
        ("c12_run_adjacency_8", {"sample_id", "ya", "xa", "yb", "xb"}),
        ("i7a_local_peaks", {"sample_id", "y", "x", "d2"}),
    ],
)
def test_every_pair_and_peak_is_a_row(spark, name, columns):
    df = catalog.QUERIES[name](spark, SF)
    assert set(df.columns) == columns
    msg, rows, _, _ = compare.check(spark, compare.duck(SF), SF, lambda *_: df, catalog.ORACLES[name])
    assert msg is None and rows > 0


@pytest.mark.parametrize("chunk", [7, 1 << 18])
def test_a_long_chain_takes_few_rounds(spark, monkeypatch, chunk):
    """Neighbours are contracted before the rounds; chunks that cut the chain are joined again."""
    import random

    from maskquery.operators import graph

    tables = []
    kept = graph.round_table
    monkeypatch.setattr(graph, "round_table", lambda df: tables.append(df) or kept(df))
    monkeypatch.setattr(graph, "CHUNK", chunk)
    names = [(f"s{k % 2}", k // 2) for k in range(400)]
    links = [(names[k], names[k + 2], k // 100) for k in range(398) if k not in (200, 201)]
    random.Random(1).shuffle(links)
    kind = "struct<k:struct<s:string>, n:long>"
    node = lambda x: ((x[0],), x[1])
    edges = spark.createDataFrame([(node(a), node(b), at) for a, b, at in links], f"src {kind}, dst {kind}, at int")
    nodes = spark.createDataFrame([(node(x),) for x in names], f"id {kind}")
    got = {(r.id.k.s, r.id.n): (r.comp.k.s, r.comp.n) for r in graph.connected_components(nodes, edges).collect()}
    assert got == {(s, n): (s, 0 if n <= 100 else 101) for s, n in names}
    assert chunk == 7 or len(tables) <= 7


def test_a_pair_of_runs_over_many_cells_is_one_row(spark):
    from maskquery.operators.runs import run_adjacency

    runs = spark.createDataFrame([(0, 0, 60, 300), (0, 1, 10, 64), (0, 1, 65, 290), (0, 1, 301, 310)], "sample_id int, y int, x0 int, x1 int")
    got = lambda n: sorted((r.xa, r.xb) for r in run_adjacency(runs, n).collect())
    assert got(1) == [(60, 10), (60, 65)]
    assert got(2) == [(60, 10), (60, 65)]
    near = spark.createDataFrame([(0, 0, 60, 64), (0, 1, 64, 70), (0, 1, 50, 60)], "sample_id int, y int, x0 int, x1 int")
    assert sorted((r.xa, r.xb) for r in run_adjacency(near, 2).collect()) == [(60, 50), (60, 64)]
    assert run_adjacency(near, 1).count() == 0
    plan = run_adjacency(runs, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan


def test_rings_are_traced_in_one_shuffle(spark, monkeypatch):
    """Holes, pinched corners and equal areas come out alike however runs are cut into chunks; nothing is written on the way."""
    from maskquery.operators import outlines

    shapes = {
        1: [(0, 0, 3), (1, 0, 1), (1, 2, 3), (2, 0, 3)],  # a hole
        2: [(0, 0, 1), (1, 1, 2)],  # two pixels that meet at a corner
        3: [(5, 0, 2), (5, 4, 6)],  # equal areas
        4: [(7, 0, 4), (7, 2, 6)],  # runs that overlap
    }
    runs = spark.createDataFrame([("s", i, *r) for i, rs in shapes.items() for r in rs], "sample_id string, inst_id int, y int, x0 int, x1 int")
    ring = lambda *p: [(float(x), float(y)) for x, y in (*p, p[0])]
    want = {
        1: ([ring((0, 0), (3, 0), (3, 3), (0, 3)), ring((1, 1), (1, 2), (2, 2), (2, 1))], 16),
        2: ([ring((0, 0), (1, 0), (1, 1), (2, 1), (2, 2), (1, 2), (1, 1), (0, 1))], 8),
        3: ([ring((4, 5), (6, 5), (6, 6), (4, 6)), ring((0, 5), (2, 5), (2, 6), (0, 6))], 12),
        4: ([ring((0, 7), (6, 7), (6, 8), (0, 8))], 14),
    }
    for chunk in (1, 1 << 17):
        monkeypatch.setattr(outlines, "CHUNK", chunk)
        df = outlines.trace_rings(runs, ["sample_id", "inst_id"], flip=False)
        got = {r.inst_id: ([[(p.x, p.y) for p in g] for g in r.rings], r.sides) for r in df.collect()}
        assert got == want
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and not any(x in plan for x in ("Join", "Aggregate", "Window"))


def test_overlap_steps_are_compressed_tables(spark, monkeypatch):
    """Two masks that share two columns: decided without a checkpoint, which would be written in full and computed twice."""
    from pyspark.sql.classic.dataframe import DataFrame

    from maskquery.operators import overlaps

    def never(*args, **kwargs):
        raise AssertionError("checkpoint")

    monkeypatch.setattr(DataFrame, "checkpoint", never)
    runs = spark.createDataFrame([(0, 1, 0, 0, 6), (0, 2, 0, 4, 10)], "sample_id int, inst_id int, y int, x0 int, x1 int")
    got = {(r.x, r.loser) for r in overlaps.pair_decisions(runs, 0).collect()}
    assert got == {(4, 2), (5, 1)}


def test_a_mask_is_traced_whole_after_a_join_on_its_keys(spark):
    """The join deals by the same keys and may become a broadcast that leaves rows where they are; the trace's own shuffle must not go for it."""
    from maskquery.operators import outlines

    keys = ["sample_id", "inst_id"]
    data = spark.sparkContext.parallelize([(i % 3, i, y, 0, 3) for y in range(20) for i in range(300)], 8)
    rows = spark.createDataFrame(data, "sample_id int, inst_id int, y int, x0 int, x1 int")
    big = rows.groupBy(*keys).count().where("count > 0")
    traced = outlines.trace_rings(rows.join(big, keys, "left_semi"), keys).join(big, keys)
    plan = traced._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "REPARTITION_BY_COL" in plan
    got = traced.collect()
    assert len(got) == 300 and {r.sides for r in got} == {46}


def test_label_texts_are_worked_out_once(spark):
    """A ring is turned and a coordinate formatted once each, and both come out as they did."""
    from pyspark.sql import functions as F

    from maskquery.functions.geometry import canonical_ring
    from maskquery.functions.scalars import format_coord
    from maskquery.sources.reports import label_line

    numbers = {-0.0: "-0.0", 1.0: "1.0", 10.0: "10.0", 0.5: "0.5", 0.015625: "0.015625", -3.25: "-3.25", 1e-7: "0.0", 0.1000004: "0.1", 100.000001: "100.000001", float("nan"): "NaN.0"}
    got = spark.createDataFrame([(v,) for v in numbers], "v double").select("v", format_coord(F.col("v")).alias("t")).collect()
    assert len(got) == len(numbers) and {repr(r.v): r.t for r in got} == {repr(v): t for v, t in numbers.items()}
    rings = spark.createDataFrame([([(4.0, 0.0), (0.0, 0.0), (0.0, 2.0), (4.0, 2.0), (4.0, 0.0)],)], "r array<struct<x:double,y:double>>")
    df = rings.select(label_line(canonical_ring(F.col("r")), F.lit(0), F.lit(0), 8).alias("line"))
    assert df.first().line == "0 0.0 0.0 0.5 0.0 0.5 0.25 0.0 0.25"
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("zip_with") == 1 and plan.count("format_string") == 2


def test_the_strip_around_a_side_is_worked_out_once(spark):
    """A slanted, a flat and an upright side give the integer points nearer than the width; no step of it stands in the plan twice."""
    import math

    from maskquery.operators.polygons import _near

    sides = {1: (0.0, 0.0, 7.0, 4.0), 2: (-2.0, 3.0, 5.0, 3.0), 3: (4.0, 9.0, 4.0, 1.0), 4: (1.0, 1.0, 1.0, 1.0)}
    edges = spark.createDataFrame([(i, *s) for i, s in sides.items()], "i int, ax double, ay double, bx double, by double")
    df = _near(edges, ["i"], 2.0)

    def far(x, y, ax, ay, bx, by):
        t = ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)
        t = min(1.0, max(0.0, t))
        return math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay))

    got = sorted((r.i, r.y, x) for r in df.collect() for x in range(r.x0, r.x1))
    assert got == [(i, y, x) for i, s in sides.items() if i != 4 for y in range(-5, 15) for x in range(-6, 15) if far(x, y, *s) < 2.0 - 1e-9]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("SQRT(") <= 4
