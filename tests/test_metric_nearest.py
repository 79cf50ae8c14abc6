"""Nearest partners by streaming blocks against brute force, and how the work is dealt."""

import numpy as np
import pytest

from starloom.operators import metric as mt


def frame(spark, rows, prefix, kind="double", first=0):
    return spark.createDataFrame([(first + i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in enumerate(rows)], f"{prefix}_id long, {prefix} array<{kind}>")


def brute(a, b, radius, metric, first=0, differ=True):
    gap = mt.METRICS[metric](a, b) if metric != "euclidean" else np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    if differ:
        gap[np.equal.outer(np.arange(len(a)), np.arange(len(b)) + first)] = np.inf
    return {i: (int(g.argmin()) + first, float(g.min())) for i, g in enumerate(gap) if g.min() <= radius}


def rows_of(df):
    return {r[0]: (r[1], r[2]) for r in df.collect()}


def same(got, want):
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


@pytest.mark.parametrize(("metric", "radius"), [("euclidean", 2.4), ("manhattan", 5.5), ("angular", 40.0)])
@pytest.mark.parametrize(("node_rows", "segment_rows"), [(60, 50), (100_000, 100_000)])
def test_nearest_of_every_row(spark, metric, radius, node_rows, segment_rows):
    a = np.random.default_rng(1).normal(0, 1, (900, 8))
    a[100:160] = a[0:60]  # copies tie at zero with each other
    a[200:230] = a[0:30]
    got = mt.metric_nearest(frame(spark, a, "p"), frame(spark, a, "q"), radius, "p", "q", "p_id", "q_id", metric, node_rows=node_rows, segment_rows=segment_rows)
    want = brute(a, a, radius, metric)
    if metric == "angular":  # copies are not told at exactly no angle
        want, got = ({k: v for k, v in d.items() if v[1] > 1e-5} for d in (want, rows_of(got)))
        same(got, want)
    else:
        same(rows_of(got), want)
    assert 300 < len(want) <= 900


def test_two_tables_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(0, 1, (300, 4)).astype("f4").astype(float), rng.normal(0, 1, (200, 4)).astype("f4").astype(float)
    left = frame(spark, [*a, None, [1.0, None, 0.0, 0.0], [1.0], [float("nan")] * 4], "p", "float")
    for differ in (False, True):
        same(rows_of(mt.metric_nearest(left, frame(spark, b, "q", "float", 150), 0.8, "p", "q", "p_id", "q_id", differ=differ, node_rows=40, segment_rows=30)), brute(a, b, 0.8, "euclidean", 150, differ))
    assert mt.metric_nearest(left.limit(0), left.withColumnsRenamed({"p": "q", "p_id": "q_id"}), 0.8, "p", "q", "p_id", "q_id").count() == 0


def test_rows_that_leave_the_kernels_do_not_grow_with_the_pairs(spark):
    """A row a block and segment at most, where everything is near everything; pairs would be 360,000."""
    a = np.random.default_rng(3).normal(0, 0.1, (600, 8))
    plan = mt.metric_nearest(frame(spark, a, "p"), frame(spark, a, "q"), 9.0, "p", "q", "p_id", "q_id", node_rows=10_000, segment_rows=200)
    rows = plan.collect()
    assert len(rows) == 600

    def nodes(p):
        yield p
        for i in range(p.children().size()):
            yield from nodes(p.children().apply(i))

    final = plan._jdf.queryExecution().executedPlan()
    final = final.finalPhysicalPlan() if "Adaptive" in final.nodeName() else final
    out = []
    while final is not None:
        for n in nodes(final):
            if "MapInArrow" in n.nodeName():
                out.append(n.metrics().apply("pythonNumRowsReceived").value())
            if "QueryStage" in n.nodeName():
                final = n.plan()
                break
        else:
            final = None
    assert out and 600 <= max(out) <= 600 * 3


def test_pairs_are_dealt_to_segments(spark):
    a = np.random.default_rng(4).normal(0, 1, (500, 3))
    got = mt.metric_join(frame(spark, a, "p"), frame(spark, a, "q"), 0.4, "p", "q", node_rows=10_000, segment_rows=64)
    gap = mt.euclidean(a, a)
    assert sorted((r.p_id, r.q_id) for r in got.collect()) == sorted((int(i), int(j)) for i, j in zip(*np.nonzero(gap <= 0.4), strict=True))
    dealt = mt._met(frame(spark, a, "p"), frame(spark, a, "q"), 0.4, "p", "q", mt.euclidean, 10_000, 64, 12, 4_000, 1_000_000)
    parts = {(r._to, r._block, r._segment, r._side): r["count"] for r in dealt.groupBy("_to", "_block", "_segment", "_side").count().collect()}
    assert len(parts) == 16 and all(n == 500 for k, n in parts.items() if k[3] == 0) and sum(n for k, n in parts.items() if k[3] == 1) == 500
