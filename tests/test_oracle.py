"""Light registered queries against their SQL at the smallest scale; ``tests/compare.py`` runs all of them."""

import compare
import pytest

from maskquery.plans import catalog

SF = "/root/testdata/sf0.001"
NAMES = (
    "a1_sample_manifest a7_write_label_rows a8_read_eval_reports a12_read_training_log a17_dataset_splits a18_collect_split_pairs a20_to_long a21_read_window "
    "b13_check_params b14_names b20_parse_stem b23_polygon_measures c1_bbox_candidates c2_overlap_pixels c6_clip_to_patches c9_clip_features "
    "d2_contingency d6_instance_metrics d7_aji d12_ci95 d18_union_masks d19_stitch_predictions d21_screen_blend e2_paint_by_score e3_rle_encode "
    "e4_rle_decode e6_gaussian_smooth i1_connected_components i4_nms i9_distance_transform j3_patch_grid j8_stratified_split j11_augment k2_stream_training_metrics"
).split()


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    msg, rows, _, _ = compare.check(spark, con, SF, catalog.QUERIES[name], catalog.ORACLES[name])
    assert msg is None and rows > 0


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
