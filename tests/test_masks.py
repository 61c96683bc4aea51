"""Mask operators against brute force on small hand-made or random masks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from maskquery.operators import coco, graph, metrics, overlaps, runs, watershed
from maskquery.operators.quantiles import exact_quantiles

FRAME = (40, 40)


def frames(spark, n=1):
    return spark.createDataFrame([(i, *FRAME) for i in range(n)], "sample_id int, height int, width int")


def box_runs(spark, boxes):
    """boxes: (sample, inst, x0, y0, x1, y1)"""
    rows = [(s, i, y, x0, x1) for s, i, x0, y0, x1, y1 in boxes for y in range(y0, y1)]
    return spark.createDataFrame(rows, "sample_id int, inst_id int, y int, x0 int, x1 int")


def random_boxes(seed, n, samples=2):
    r = random.Random(seed)
    out = []
    for s in range(samples):
        for i in range(1, n + 1):
            x, y = r.randrange(0, 32), r.randrange(0, 32)
            out.append((s, i, x, y, x + r.randrange(2, 8), y + r.randrange(2, 8)))
    return out


def pixels(boxes):
    px = {}
    for s, i, x0, y0, x1, y1 in boxes:
        px.setdefault((s, i), set()).update((y, x) for y in range(y0, y1) for x in range(x0, x1))
    return px


def painted(boxes):
    lab = {}
    for s, i, x0, y0, x1, y1 in sorted(boxes, key=lambda b: b[1]):
        for y in range(y0, y1):
            for x in range(x0, x1):
                lab[(s, y, x)] = i
    return lab


def expand(df):
    return {(r.sample_id, y, x): r.inst_id for r in df.collect() for y in [r.y] for x in range(r.x0, r.x1)}


def test_paint_last_wins(spark):
    b = random_boxes(1, 30)
    assert expand(runs.paint_by_id(box_runs(spark, b), groups=())) == painted(b)


def test_rle_round_trip(spark):
    b = random_boxes(2, 12)
    r = runs.merge_runs(box_runs(spark, b), ("sample_id", "inst_id"))
    rle = runs.rle_encode(r.join(frames(spark, 2), "sample_id"), ("sample_id", "inst_id"))
    key = lambda d: sorted((x.sample_id, x.inst_id, x.y, x.x0, x.x1) for x in d.collect())
    assert key(runs.rle_decode(rle, ("sample_id", "inst_id"))) == key(r)
    assert all(sum(x["counts"]) == FRAME[0] * FRAME[1] for x in rle.collect())


def test_rle_leading_zero_pair_and_column_major(spark):
    rows = [(0, 1, [2, 3], [0, 0, 2, 4], "C"), (0, 2, [2, 3], [1, 2, 3], "F")]
    d = spark.createDataFrame(rows, "sample_id int, inst_id int, size array<int>, counts array<bigint>, order string")
    got = {(r.inst_id, r.y, r.x0, r.x1) for r in runs.rle_decode(d, ("sample_id", "inst_id")).collect()}
    # [0, 0, 2, 4] reads as [0, 2, 4]; column-major 1..2 covers (1, 0) and (0, 1)
    assert got == {(1, 0, 0, 2), (2, 1, 0, 1), (2, 0, 1, 2)}


def brute_aji(gt, dt):
    g, d = {}, {}
    for k, v in gt.items():
        g.setdefault(v, set()).add(k)
    for k, v in dt.items():
        d.setdefault(v, set()).add(k)
    free, num, den = set(d), 0, 0
    for i in sorted(g):
        best = max(sorted(free), key=lambda j: len(g[i] & d[j]) / len(g[i] | d[j]), default=None)
        if best is None or not g[i] & d[best]:
            den += len(g[i])
            continue
        num, den = num + len(g[i] & d[best]), den + len(g[i] | d[best])
        free.discard(best)
    return num, den + sum(len(d[j]) for j in free)


@pytest.mark.parametrize("seed", [3, 4])
def test_aji_equals_sequential(spark, seed):
    gb, db = random_boxes(seed, 40), random_boxes(seed + 100, 40)
    lab = lambda b: runs.paint_by_id(box_runs(spark, b), groups=())
    out = metrics.aji(lab(gb), lab(db), frames(spark, 2))
    got = {r.sample_id: (r.aji_num, r.aji_den) for r in out.collect()}
    of = lambda b, s: {k[1:]: v for k, v in painted(b).items() if k[0] == s}
    assert got == {s: brute_aji(of(gb, s), of(db, s)) for s in (0, 1)}


def test_scores_of_empty_samples(spark):
    one = runs.paint_by_id(box_runs(spark, [(1, 1, 0, 0, 4, 4)]), groups=())
    m = {r.sample_id: r for r in metrics.instance_metrics(one, one.where("sample_id < 0"), frames(spark, 2)).collect()}
    assert m[0].f1_iou50 == 1.0 and m[1].f1_iou50 == 0.0
    a = {r.sample_id: r.aji for r in metrics.aji(one, one, frames(spark, 2)).collect()}
    assert a == {0: 1.0, 1: 1.0}


def test_half_masks_conflict_at_exactly_half(spark):
    gt = runs.split_to_cells(box_runs(spark, [(0, 1, 0, 0, 8, 4)]))
    dt = runs.split_to_cells(box_runs(spark, [(0, 1, 0, 0, 4, 4), (0, 2, 4, 0, 8, 4)]))
    m = metrics.match_tp(metrics.iou_pairs(gt, dt)).collect()
    assert [(r.gt_id, r.dt_id, r.thr) for r in m] == [(1, 1, 0.5)]


def test_nms_equals_greedy(spark):
    b = random_boxes(5, 40)
    score = {(s, i): ((i * 37) % 20) / 20 for s, i, *_ in b}
    masks = spark.createDataFrame([(s, i, score[(s, i)]) for s, i, *_ in b], "sample_id int, inst_id int, score double")
    got = {(r.sample_id, r.inst_id) for r in graph.nms(masks, box_runs(spark, b), 0.2).collect()}
    px, keep = pixels(b), []
    for k in sorted(score, key=lambda k: (-score[k], -k[1])):
        if all(k[0] != o[0] or len(px[k] & px[o]) / len(px[k] | px[o]) <= 0.2 for o in keep):
            keep.append(k)
    assert got == set(keep)


def test_greedy_merge_groups(spark):
    b = random_boxes(6, 30)
    masks = spark.createDataFrame([(s, i, i / 30, i % 2) for s, i, *_ in b], "sample_id int, inst_id int, score double, category_id int")
    _, stats = graph.greedy_merge(masks, box_runs(spark, b), 0.5)
    px, want = pixels(b), {}
    left = sorted(px, key=lambda k: (k[0], -k[1]))
    while left:
        k, rest = left[0], []
        members = [k]
        for o in left[1:]:
            near = o[0] == k[0] and o[1] % 2 == k[1] % 2 and len(px[k] & px[o]) / min(len(px[k]), len(px[o])) >= 0.5
            (members if near else rest).append(o)
        want[k] = (len(members), len(set().union(*[px[m] for m in members])))
        left = rest
    assert {(r.sample_id, r.group_id): (r.members, r.area) for r in stats.collect()} == want


def test_resolve_overlaps_is_disjoint_and_keeps_union(spark):
    b = random_boxes(7, 25)
    kept, lost = overlaps.resolve_overlaps(box_runs(spark, b), 3, "smaller")
    rows = [(r.sample_id, r.y, x) for r in kept.collect() for x in range(r.x0, r.x1)]
    assert len(rows) == len(set(rows))
    assert set(rows) == {(s, y, x) for (s, _), p in pixels(b).items() for y, x in p}
    assert lost.count() > 0


def test_containment_is_an_error(spark):
    r = box_runs(spark, [(0, 1, 0, 0, 9, 9), (0, 2, 2, 2, 6, 6)])
    with pytest.raises(Exception, match="exclusive"):
        overlaps.resolve_overlaps(r, 1)


def test_watershed_splits_two_grains_and_stays_inside(spark):
    # two discs joined by a neck
    disc = lambda cx: {(y, x) for y in range(40) for x in range(40) if (y - 15) ** 2 + (x - cx) ** 2 <= 49}
    px = disc(10) | disc(22)
    interior = spark.createDataFrame([(0, y, x, x + 1) for y, x in px], "sample_id int, y int, x0 int, x1 int")
    none = interior.where("y < 0")
    out = expand(watershed.watershed_instances(interior, none, frames(spark), min_distance=5))
    assert set(out) == {(0, y, x) for y, x in px}
    assert len(set(out.values())) == 2 and out[(0, 15, 8)] != out[(0, 15, 24)]
    edt = {(r.y, r.x): r.d for r in watershed.distance_transform(interior, frames(spark)).collect()}
    out_px = [(y, x) for y in range(40) for x in range(40) if (y, x) not in px]
    for y, x in list(px)[:60]:
        assert math.isclose(edt[(y, x)] ** 2, min((y - a) ** 2 + (x - b) ** 2 for a, b in out_px))


def test_coco_ap_of_perfect_and_missing(spark):
    b = [(0, 1, 0, 0, 8, 8), (0, 2, 10, 10, 20, 20), (1, 1, 0, 0, 8, 8)]
    r = box_runs(spark, b)
    scores = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.8)], "sample_id int, inst_id int, score double")
    out = {x.sample_id: x for x in coco.coco_mask_ap(r, r.where("sample_id = 0"), scores, frames(spark, 3)).collect()}
    assert out[0].AP == pytest.approx(1.0) and out[0].APs == pytest.approx(1.0) and out[0].APl == -1.0
    assert out[0].AR1 == pytest.approx(0.5) and out[0].AR100 == pytest.approx(1.0)
    assert out[1].AP == 0.0 and out[1].APs == -1.0
    assert out[2].AP == -1.0 and out[2].AR100 == -1.0


def test_exact_quantiles(spark):
    r = random.Random(9)
    v = sorted(r.choice([r.random(), 0.25]) for _ in range(501))
    df = spark.createDataFrame([(x,) for x in v], "v double")
    for p, q in zip([0.0, 0.05, 0.5, 0.333, 1.0], exact_quantiles(df, "v", [0.0, 0.05, 0.5, 0.333, 1.0])):
        s = p * 500
        assert q == pytest.approx(v[math.floor(s)] + (v[math.ceil(s)] - v[math.floor(s)]) * (s - math.floor(s)))


def test_exact_quantiles_with_an_outlier(spark, monkeypatch):
    import numpy as np

    from maskquery.operators import quantiles

    monkeypatch.setattr(quantiles, "SMALL", 20)
    r = random.Random(7)
    v = [r.choice([r.random(), r.randrange(3), 0.5]) for _ in range(500)] + [1e12, -1e9, 1e12]
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0]
    got = exact_quantiles(spark.createDataFrame([(float(x),) for x in v], "x double"), "x", probs)
    assert got == pytest.approx(list(np.quantile(np.array(v), probs)), rel=1e-12)


def test_components_are_a_partition(spark):
    r = random.Random(10)
    e = [(r.randrange(200), r.randrange(200)) for _ in range(150)]
    nodes = spark.range(200).select(F.col("id"))
    got = {x.id: x.comp for x in graph.connected_components(nodes, spark.createDataFrame(e, "src bigint, dst bigint")).collect()}
    comp = list(range(200))
    for _ in range(200):
        for a, b in e:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert got == dict(enumerate(comp))


def test_grid_search_prefers_the_right_spacing(spark):
    from maskquery.operators.trials import best_params

    disc = lambda cx: {(y, x) for y in range(40) for x in range(40) if (y - 15) ** 2 + (x - cx) ** 2 <= 49}
    a, b = disc(10), disc(22)
    row = lambda px, i: [(0, i, y, x, x + 1) for y, x in px]
    gt = spark.createDataFrame(row(a, 1) + row(b - a, 2), "sample_id int, inst_id int, y int, x0 int, x1 int")
    interior = gt.drop("inst_id")
    scores = watershed.grid_search([{"min_distance": 30}, {"min_distance": 5}], interior, interior.where("y < 0"), gt, frames(spark))
    got = {r.grid_idx: r.best for r in best_params(scores).collect()}
    assert got == {0: False, 1: True}
