"""Plans stay as they are meant to be: few exchanges, pruned scans, no Cartesian products."""

import re

import pytest

from voxlake.plans.queries import QUERIES

from .oracle import DATA

#: Most exchanges of each query; joins count theirs.
EXCHANGES = {
    "fd_quality": 1, "fd_frames": 1, "motion_rms": 1, "motion_detrended": 1, "spike_regressors": 1, "percent_change": 1, "dvars_frames": 1, "motion_detrended_polynomial": 1, "mean_of_run_means": 2, "value_histogram": 1, "histogram_equalised": 1,
    "volume_slice": 0, "volume_crop": 0, "volume_clip": 0, "volume_reorient": 0, "volume_threshold": 0, "resample_nearest": 0, "resample_trilinear": 0, "apply_matrix": 0, "first_volume": 1, "temporal_mean": 1,
    "template_filled": 0, "preprocessing_template": 0, "model_template": 0, "short_model_template": 0, "volume_pad": 1, "search_ranges": 0, "run_grid": 0,
    "series_high_pass": 2, "series_slice_timing": 2, "volume_smoothed": 1, "volume_smoothed_in_rows": 0, "matrix_files": 0,
}


def plan(spark, name: str) -> str:
    if not DATA.exists():
        pytest.skip("the driver's tables aren't here")
    return QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(EXCHANGES))
def test_exchanges(spark, name):
    assert len(re.findall(r"(?<!Broadcast)Exchange ", plan(spark, name))) <= EXCHANGES[name]


def test_scans_read_only_what_is_used(spark):
    assert re.search(r"ReadSchema: struct<label:int>|ReadSchema: struct<vec_id:bigint,embedding:array<float>>", plan(spark, "volume_crop"))
    assert "l_shipdate" in plan(spark, "fd_quality") and "l_returnflag" not in plan(spark, "fd_quality")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"regions_grown"}))
def test_no_cartesian_products(spark, name):
    assert "CartesianProduct" not in plan(spark, name) and "NestedLoop" not in plan(spark, name)
