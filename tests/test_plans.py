"""Physical plans: what is scanned, joined and shuffled."""

import re

import pytest

from starloom.plans import catalogue


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["xmatch_radec", "xmatch_notself", "xmatch_nearest", "xmatch_count", "match_xy", "sky_knn"])
def test_distance_joins_are_equi_joins(spark, sf, name):
    p = plan(catalogue.QUERIES[name](spark, sf))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|Python|Arrow", p)
    assert re.search(r"(SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin) \[_bucket", p)


def test_scans_are_pruned_and_filtered(spark, sf):
    p = plan(catalogue.QUERIES["matches_for_field"](spark, sf))
    assert "PushedFilters: [IsNotNull(o_custkey), EqualTo(o_custkey,77)]" in p
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>", p)
    p = plan(catalogue.QUERIES["hist1d"](spark, sf))
    assert "ReadSchema: struct<l_extendedprice:double>" in p


@pytest.mark.parametrize("name", ["best_per_group", "best_job", "xmatch_nearest", "hist1d", "coadd", "block_average"])
def test_best_of_and_histograms_are_partial_aggregates(spark, sf, name):
    p = plan(catalogue.QUERIES[name](spark, sf))
    assert "partial_" in p and "Window" not in p


def test_top_k_is_limited_before_the_shuffle(spark, sf):
    assert "WindowGroupLimit" in plan(catalogue.QUERIES["head_per_group"](spark, sf))
    assert "TakeOrderedAndProject" in plan(catalogue.QUERIES["brightest_k"](spark, sf))


def test_equalisation_has_no_single_sorted_task(spark, sf):
    p = plan(catalogue.QUERIES["rank_stretch"](spark, sf))
    assert "rangepartitioning" in p or "Scan ExistingRDD" in p
    assert "BroadcastNestedLoopJoin" not in p


@pytest.mark.parametrize("name", ["remove_lines", "remove_lines_any_angle"])
def test_lines_leave_without_nested_loops(spark, sf, name):
    assert "NestedLoop" not in plan(catalogue.QUERIES[name](spark, sf))


def test_streams_leave_rows_in_files(spark, sf):
    df = catalogue.QUERIES["tumbling_window"](spark, sf)
    assert all("/out/batch=" in f for f in df.inputFiles()) and len({re.search("batch=([0-9]+)", f)[1] for f in df.inputFiles()}) > 2


def test_no_local_checkpoint_and_no_collect_in_operators():
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "starloom"
    for path in [p for folder in ("operators", "plans", "streaming", "functions") for p in (root / folder).glob("*.py")]:
        text = path.read_text()
        assert "localCheckpoint" not in text and ".collect()" not in text and "crossJoin" not in text, path
