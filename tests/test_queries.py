"""Every terrain query against its SQL form in DuckDB; those without one are held against plain versions in test_yardsticks."""

import math
from pathlib import Path

import duckdb
import pytest

from catena.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


#: Where a query finds nothing on the smallest tables, it is held against these.
LARGER = "/root/testdata/sf0.01"


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if type(value).__name__ == "Decimal":
        value = float(value)
    return None if isinstance(value, float) and math.isnan(value) else value + 0.0 if isinstance(value, float) else value


def same(a, b):
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6) if isinstance(a, float) and isinstance(b, (int, float)) else a == b


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sf_dir, name):
    for tables in (sf_dir, LARGER):
        df = QUERIES[name](spark, tables)
        columns = sorted(df.columns)
        got = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)
        if got:
            break
    names = ", ".join(f'"{c}"' for c in columns)
    want = sorted((tuple(plain(v) for v in r) for r in duck(tables).sql(f"SELECT {names} FROM ({ORACLE_SQL[name]})").fetchall()), key=repr)
    assert got and len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(same(x, y) for x, y in zip(a, b, strict=True)), (a, b)


def test_queries_without_sql_have_a_yardstick():
    text = (Path(__file__).parent / "test_yardsticks.py").read_text()
    assert [n for n in QUERIES if n not in ORACLE_SQL and f'"{n}"' not in text and n not in ("sampled_segments", "concavity_chain")] == []


def test_names_cover_the_plan():
    """The agreed list of query names is registered."""
    planned = """d8_receiver d8_slope contributing_cells drainage_area basin_root base_level_nodes upslope_sum upslope_mean distance_from_outlet flow_path chi_tree
    sources_area_threshold sources_slope_area donors_count strahler_order junction_list upstream_closure is_upstream_pairs largest_basin prune_area_window
    prune_nested tag_upstream farthest_upslope nearest_channel_relief snap_points burn_raster_to_points raster_add raster_sub raster_mul raster_div
    mask_below mask_by_raster raster_diff_count clip_window trim_bounds resample_centre categorise scale_minmax zonal_mean zonal_min_max_range zonal_stddev zonal_median
    zonal_percentile zonal_litho_count descriptive_stats mad_by_group modified_zscore histogram linear_bins log_bins small_bin_filter regression_by_group
    durbin_watson mann_whitney_u ks_statistic quantile_points interp1d_asof neighbour_mean neighbour_relief hillshade knickpoint_diffs
    stepped_knickpoints chi_profile_integral slope_area_bins disorder_metric movern_grid_disorder nci swath_bins hypsometric_integral junction_angles
    connected_components small_patch_filter basin_perimeter adjacency_pairs point_in_polygon utm_forward be10_steady_state binary_quality unique_values union_networks""".split()
    assert not set(planned) - set(QUERIES)
