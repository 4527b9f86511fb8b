"""Registered queries against the same question in DuckDB SQL, on the smallest tables."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from geoloom.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()
#: The quicker ones of each group; the driver compares all.
PICKED = """a2_stats a3_histogram a4_histogram_edges a6_a7_change_summary p1_band_math p2_ndvi p8_threshold_otsu p14_enhance_equalize p16_colormap p18_change_ratio p22_pansharpen_ihs
w1_filter_gaussian w2_filter_median w6_morph_open w8_edge_sobel p9_threshold_adaptive_mean w12_template_ccoeff_normed t1_clip_extent t3_mosaic t4_split w14_overviews_mode r3_transform_utm
r2_resample_lanczos r2_resample_mode r2_reproject_bilinear f2_filter_extent f4_overlap_ratio j1_grid_join j11_points_in_areas j3_clip_lines j5_difference_lines v1_rasterize_many a8_feature_stats
c1_components v2_polygonize c2_contours w11_edge_canny c5_hough_lines k2_two_nearest k3_corners_harris p15_enhance_clahe j7_union_bent_lines r1_reproject_features w14_overviews_gaussian j2_clip j4_difference j6_union a1_dissolve v3_buffer_areas f6_make_valid s7_convert_geojson s7_convert_kml
f2_filter_extent_exact f5_areas_intersect f5_areas_contain f5_areas_within_holed f5_lines_intersect f5_points_within_holed p21_pansharpen_mean_two_grids p22_pansharpen_ihs_two_grids a5_raster_info
c3_boundaries c3_segment_count k2_pruned_nearest k2_match_lsh a8_stats_over_rasters s5_tile_store""".split()


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else str(int(v)) if v == int(v) else repr(round(v, 9))
    return "" if v is None else str(v)


@pytest.mark.parametrize("name", PICKED)
def test_same_rows(spark, data, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    con = duckdb.connect()
    for f in Path(data).iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(row[names.index(c)]) for c in columns) for row in result.fetchall())
    assert got == want


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
