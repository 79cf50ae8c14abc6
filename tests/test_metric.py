"""Metric joins by node bounds against brute force."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from starloom.operators import metric as mt


def frame(spark, rows, prefix):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in enumerate(rows)], f"{prefix}_id long, {prefix} array<double>")


def brute(a, b, radius, metric):
    gap = mt.METRICS[metric](np.array(a, float), np.array(b, float)) if len(a) and len(b) else np.zeros((0, 0))
    return {(int(i), int(j)) for i, j in zip(*np.nonzero(gap <= radius), strict=True)}


def clusters(seed, n=600, dims=5, centres=12):
    rng = np.random.default_rng(seed)
    c = rng.normal(0, 10, (centres, dims))
    return c[rng.integers(0, centres, n)] + rng.normal(0, 0.3, (n, dims))


@pytest.mark.parametrize(("metric", "radius"), [("euclidean", 0.7), ("manhattan", 1.2), ("angular", 3.0)])
@pytest.mark.parametrize("node_rows", [20, 100_000])
def test_clusters(spark, metric, radius, node_rows):
    a, b = clusters(1), clusters(1)[:300]
    got = mt.metric_join(frame(spark, a, "p"), frame(spark, b, "q"), radius, "p", "q", metric, node_rows=node_rows)
    rows = got.collect()
    assert got.columns == ["p_id", "p", "q_id", "q", "dist"]
    assert sorted((r.p_id, r.q_id) for r in rows) == sorted(brute(a, b, radius, metric))
    exact = mt.METRICS[metric](a, b)
    assert all(abs(r.dist - exact[r.p_id, r.q_id]) < 1e-9 and list(a[r.p_id]) == r.p for r in rows[:500])


def test_most_nodes_never_meet(spark):
    a = clusters(2, 2000)
    left, right = frame(spark, a, "p"), frame(spark, a, "q")
    tree = mt.plant(left, right, "p", "q", mt.euclidean, 40, 12, 4000)
    bounds = mt.node_bounds(mt._placed(left, "p", tree), len(tree.pivots)).persist()
    n = bounds.count()
    met = mt.node_pairs(bounds, bounds, 0.5).collect()
    assert n > 30 and len(met) < 0.25 * n * n
    # the bounds hold for every pair of rows
    node = tree.nodes(tree.coordinates(a))
    gap = mt.euclidean(a, a)
    near = {(r.l_node, r.r_node): (r.nearest, r.farthest) for r in met}
    for i in range(0, 2000, 7):
        for j in np.flatnonzero(gap[i] <= 0.5):
            low, high = near[int(node[i]), int(node[j])]
            assert low - 1e-9 <= gap[i, j] <= high + 1e-9


def test_one_vector_in_a_third_of_the_rows(spark):
    a = clusters(3, 300)
    a[::3] = a[0]
    left, right = frame(spark, a, "p"), frame(spark, a[:40], "q")
    got = mt.metric_join(left, right, 0.4, "p", "q", node_rows=16)
    assert sorted((r.p_id, r.q_id) for r in got.select("p_id", "q_id").collect()) == sorted(brute(a, a[:40], 0.4, "euclidean"))


def test_odd_rows(spark):
    a = [[0.0, 0.0], None, [1.0, None], [1.0], [float("nan"), 1.0], [float("inf"), 0.0], [3.0, 4.0]]
    b = [[3.0, 4.0], [0.0, 0.0], None]
    got = mt.metric_join(frame(spark, a, "p"), frame(spark, b, "q"), 5.0, "p", "q")
    assert sorted((r.p_id, r.q_id, r.dist) for r in got.collect()) == [(0, 0, 5.0), (0, 1, 0.0), (6, 0, 0.0), (6, 1, 5.0)]
    none = frame(spark, a, "p").limit(0)
    assert mt.metric_join(none, frame(spark, b, "q"), 5.0, "p", "q").count() == 0
    # a zero vector has no direction
    turned = mt.metric_join(frame(spark, a, "p"), frame(spark, b, "q"), 180.0, "p", "q", "angular")
    assert [(r.p_id, r.q_id) for r in turned.collect()] == [(6, 0)]


def test_a_metric_of_ones_own(spark):
    def largest(x, y):
        return np.abs(x[:, None] - y[None]).max(axis=2)

    a = clusters(5, 200, 3)
    got = mt.metric_join(frame(spark, a, "p"), frame(spark, a, "q"), 0.3, "p", "q", largest, node_rows=25)
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(largest(a, a) <= 0.3), strict=True)}
    assert {(r.p_id, r.q_id) for r in got.collect()} == want


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 6), st.integers(0, 10**6), st.sampled_from(sorted(mt.METRICS)))
def test_metrics_obey_the_triangle_inequality(dims, seed, name):
    rng = np.random.default_rng(seed)
    p = rng.normal(size=(6, dims))
    p[3] = p[2] + 1e-7
    d = mt.METRICS[name](p, p)
    assert (d[:, None, :] <= d[:, :, None] + d[None] + 1e-6).all()
    assert np.abs(np.diag(d)).max() < 1e-6


@pytest.mark.parametrize(("metric", "radius"), [("euclidean", 0.7), ("angular", 3.0), ("angular", 180.0), ("angular", 0.0)])
@pytest.mark.parametrize("node_rows", [40, 100_000])
def test_pairs_of_the_same_rows_are_found_once(spark, metric, radius, node_rows):
    a = clusters(7, 300)
    a[:20], a[20:40] = a[5], 2.0 * a[5]
    left, right = frame(spark, a, "p"), frame(spark, a, "q")
    got = mt.metric_join(left, right, radius, "p", "q", metric, node_rows=node_rows, once=("p_id", "q_id"), columns=["p_id", "q_id"])
    assert got.columns == ["p_id", "q_id", "dist"]
    rows = got.collect()
    exact = mt.METRICS[metric](a, a)
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(exact <= radius + 1e-6), strict=True) if i < j}
    sure = {(i, j) for i, j in want if exact[i, j] <= radius - 1e-6}
    found = [(r.p_id, r.q_id) for r in rows]
    assert len(set(found)) == len(found) and sure <= set(found) <= want
    assert all(abs(r.dist - exact[r.p_id, r.q_id]) < 1e-6 for r in rows)


def test_angles_send_ids_only_and_compare_pairs_once(spark, sf):
    """What the query's kernel returns holds no vectors, and of two nodes only one stands."""
    from starloom.plans import catalogue

    plan = catalogue.QUERIES["nd_angle_join"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow run" in plan and "p#" not in next(line for line in plan.splitlines() if "MapInArrow run" in line).rsplit("[", 1)[-1]
    a = clusters(8, 400)
    dealt = mt._met(frame(spark, a, "p"), frame(spark, a, "q"), 50.0, "p", "q", mt.euclidean, 50, 32_768, 12, 4_000, 1_000_000, True)
    both = mt._met(frame(spark, a, "p"), frame(spark, a, "q"), 50.0, "p", "q", mt.euclidean, 50, 32_768, 12, 4_000, 1_000_000)
    assert dealt.where("_side > 0").count() < 0.7 * both.where("_side > 0").count()
