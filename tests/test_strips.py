"""Masks as strips: painting, pairing and unions give what runs give, over tile borders and whatever the batches are."""

import pytest
from pyspark.sql import functions as F
from test_masks import box_runs, expand, painted, pixels, random_boxes

from maskquery.operators import metrics, runs


def strips(spark, boxes):
    rows = [(s, i, y0, y1, x0, x1) for s, i, x0, y0, x1, y1 in boxes]
    return spark.createDataFrame(rows, "sample_id int, inst_id int, y int, y1 int, x0 int, x1 int")


def wide(seed, n):
    """Boxes over several tiles of 64 x 64, some larger than a tile, negative places included."""
    return [(s, i, 4 * x0 - 40, 4 * y0 - 40, 4 * x1, 4 * y1) for s, i, x0, y0, x1, y1 in random_boxes(seed, n)]


@pytest.mark.parametrize("batch", [7, 10000])
def test_painted_strips_over_batches(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        b = wide(21, 40)
        got = runs.paint_by_id(strips(spark, b), groups=())
        rows = runs.as_runs(got)
        assert rows.agg(F.sum(F.col("x1") - F.col("x0"))).first()[0] == len(painted(b)) and expand(rows) == painted(b)
        assert expand(runs.paint_by_id(box_runs(spark, b), groups=())) == painted(b)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_lone_box_stays_one_strip_a_tile(spark):
    got = runs.paint_by_id(strips(spark, [(0, 1, 10, 10, 30, 50)]), groups=()).collect()
    assert [(r.y, r.y1, r.x0, r.x1, r.inst_id) for r in got] == [(10, 50, 10, 30, 1)]


def test_pairs_and_overlaps_of_strips(spark):
    g, d = wide(22, 30), wide(23, 30)
    lab = lambda make, b: runs.paint_by_id(make(spark, b), groups=())
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(metrics.iou_pairs(lab(strips, g), lab(strips, d))) == key(metrics.iou_pairs(lab(box_runs, g), lab(box_runs, d)))
    px = pixels(g)
    want = {(a[0], a[1], b[1]): len(px[a] & px[b]) for a in px for b in px if a[0] == b[0] and a[1] < b[1] and px[a] & px[b]}
    assert {(r.sample_id, r.a_id, r.b_id): r.inter for r in runs.overlap_pixels(strips(spark, g)).collect()} == want


def test_union_of_strips(spark):
    b = wide(24, 20)
    groups = spark.createDataFrame([(s, i, i % 3) for s, i, *_ in b], "sample_id int, inst_id int, group_id int")
    of = lambda make: sorted(tuple(r) for r in runs.union_masks(make(spark, b), groups)[1].collect())
    assert of(strips) == of(box_runs)


def test_codes_of_strips(spark):
    b = random_boxes(25, 12) + [(0, 50, 0, 3, 40, 9), (0, 51, 38, 0, 40, 4), (0, 51, 0, 1, 3, 5)]
    framed = strips(spark, b).selectExpr("*", "40 AS height", "40 AS width")
    got = {(r.sample_id, r.inst_id): list(r.counts) for r in runs.rle_encode(framed, ("sample_id", "inst_id")).collect()}
    want = {}
    for k, px in pixels(b).items():
        flat, on, counts = [(p // 40, p % 40) in px for p in range(1600)], False, [0]
        for v in flat:
            if v != on:
                counts.append(0)
                on = v
            counts[-1] += 1
        want[k] = counts
    assert got == want


def test_the_box_fixture_is_one_pass_over_lineitem(spark):
    """Both sides come from one shuffle, which the window and the count share; the rows are those of the common text."""
    from maskquery.plans import views

    sf = "/root/testdata/sf0.001"
    boxes = views.view(spark, sf, "fx_boxes")
    text = boxes._jdf.queryExecution().executedPlan().toString()
    assert text.count("Scan parquet") == 1 and text.count("Exchange hashpartitioning") == 1
    plain = spark.sql(views._with("SELECT * FROM fx_boxes", {**views.COMMON}))
    assert boxes.schema.simpleString() == plain.schema.simpleString()
    assert boxes.exceptAll(plain).isEmpty() and plain.exceptAll(boxes).isEmpty()
