"""Tile operators and component ids at their edges: gaps, empty windows, rewrites, large sample numbers."""

import tempfile

import pytest

from maskquery.operators import graph, rasters


def tile(section, band, y0, x0, value, side=4):
    return (section, band, y0, x0, side, side, 1, bytearray([value] * side * side))


@pytest.fixture(scope="module")
def gappy(spark):
    rows = [tile(1, "a", 0, 0, 10), tile(1, "b", 0, 0, 20), tile(1, "a", 0, 4, 30)]
    return spark.createDataFrame(rows, rasters.TILE_SCHEMA)


def test_align_bands_stops_at_a_gap(gappy):
    with pytest.raises(ValueError, match="section 1, tile at y 0, x 4: 1 of 2 bands"):
        rasters.align_bands(gappy, 2)
    assert [(r.y0, r.x0, r.bands) for r in rasters.misaligned(gappy, 2).collect()] == [(0, 4, 1)]
    assert rasters.align_bands(gappy.where("x0 = 0"), 2).count() == 2


def test_align_bands_stops_at_mixed_shapes(spark):
    with pytest.raises(ValueError, match="differing shapes"):
        rasters.align_bands(spark.createDataFrame([tile(1, "a", 0, 0, 1), tile(1, "b", 0, 0, 1, 3)], rasters.TILE_SCHEMA), 2)


def test_patches_over_gaps_are_zero(spark, gappy):
    patches = spark.createDataFrame([(1, "seen", 0, 4, 2, 6), (1, "gap", 8, 12, 8, 12)], "section_id int, stem string, y0 int, y1 int, x0 int, x1 int")
    got = {(r.stem, r.band): list(r.data) for r in rasters.extract_patches(gappy, patches, 4, 4).collect()}
    assert got == {
        ("seen", "a"): [10, 10, 30, 30] * 4,
        ("seen", "b"): [20, 20, 0, 0] * 4,
        ("gap", "a"): [0] * 16,
        ("gap", "b"): [0] * 16,
    }


def test_window_without_tiles_is_an_error(gappy):
    with pytest.raises(ValueError, match="no tile"):
        rasters.read_window(gappy, 100, 100, 110, 110)
    assert rasters.read_window(gappy, 2, 1, 6, 3).count() == 3


def test_rewritten_tiles_do_not_double(spark, gappy):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/tiles"
    for _ in range(2):
        rasters.write_tiles(gappy, path, "image")
    rasters.write_tiles(spark.createDataFrame([tile(2, "a", 0, 0, 5)], rasters.TILE_SCHEMA), path, "image")
    assert sorted((r.section_id, r.x0) for r in spark.read.parquet(path).collect()) == [(1, 0), (1, 0), (1, 4), (2, 0)]


def test_components_of_large_sample_numbers(spark):
    runs = [(s, 0, 0, 3) for s in (0, 1 << 23, 1 << 24, (1 << 31) - 1)] + [(1 << 24, 1, 2, 5), (1 << 24, 9, 2, 5)]
    got = graph.label_components(spark.createDataFrame(runs, "sample_id int, y int, x0 int, x1 int"), 1)
    assert sorted(tuple(r) for r in got.select("sample_id", "inst_id", "y", "x0", "x1").collect()) == [
        (0, 1, 0, 0, 3),
        (1 << 23, 1, 0, 0, 3),
        (1 << 24, 1, 0, 0, 3),
        (1 << 24, 1, 1, 2, 5),
        (1 << 24, 2, 9, 2, 5),
        ((1 << 31) - 1, 1, 0, 0, 3),
    ]


def test_polygon_parts_of_collections(spark):
    from maskquery.sources import vectors

    ring = "[[[0,0],[4,0],[4,4],[0,0]]]"
    polygon = f'{{"type":"Polygon","coordinates":{ring}}}'
    multi = f'{{"type":"MultiPolygon","coordinates":[{ring},{ring}]}}'

    def parts(*geometries):
        features = ",".join(f'{{"type":"Feature","properties":{{}},"geometry":{g}}}' for g in geometries)
        docs = spark.createDataFrame([(f'{{"type":"FeatureCollection","features":[{features}]}}',)], "text string")
        return vectors.polygon_parts(vectors.parse_geojson(docs)).count()

    assert parts(polygon, f'{{"type":"GeometryCollection","geometries":[{polygon},{multi}]}}', '{"type":"GeometryCollection","geometries":[]}') == 4
    with pytest.raises(Exception, match="in a collection: Point"):
        parts('{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[1,2]}]}')
    with pytest.raises(Exception, match="layer: LineString"):
        parts('{"type":"LineString","coordinates":[[1,2],[3,4]]}')
