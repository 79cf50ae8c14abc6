"""Exact order statistics against sorting."""

import math

import numpy as np
import pytest

from starloom.operators import selection as sel


def frame(spark, groups):
    return spark.createDataFrame([(g, None if v is None else float(v)) for g, vs in groups.items() for v in vs], "g string, v double")


def interpolated(values, p):
    s = sorted(values)
    at = p * (len(s) - 1)
    lo, hi = s[math.floor(at)], s[math.ceil(at)]
    return lo + (hi - lo) * (at - math.floor(at))


RNG = np.random.default_rng(6)
GROUPS = {
    "even": RNG.uniform(0, 1, 4000), "heavy": np.exp(RNG.normal(0, 40, 3000)), "ties": RNG.integers(0, 3, 3000), "one": [7.5], "two": [1.0, 2.0], "same": [3.0] * 2500,
    # two values that fill nearly all bins, and many rare ones between them, where the median is
    "between": [0.0] * 1480 + [*np.linspace(0.1, 0.9, 41)] + [1.0] * 1480, "signs": [*(-(10.0 ** np.arange(-200, 200, 0.5))), *(10.0 ** np.arange(-200, 200, 0.5)), 0.0, -0.0],
}
PROBS = [0.0, 0.013, 0.25, 0.5, 0.77, 0.999, 1.0]


@pytest.mark.parametrize(("last", "bins", "accuracy"), [(1000, 1000, 10_000), (5, 20, 200), (1, 4, 10)])
def test_quantiles(spark, monkeypatch, last, bins, accuracy):
    """Also with a sketch that is far too coarse: the counts are exact, so only the number of rounds changes."""
    monkeypatch.setattr(sel, "BINS", bins)
    df = frame(spark, {g: v for g, v in GROUPS.items() if last > 1 or len(v) < 1000 or g == "between"})
    df = df.unionByName(spark.createDataFrame([("even", None), ("even", float("nan")), ("none", None)], "g string, v double"))
    got = {r.g: r for r in sel.quantiles(df, ["g"], "v", PROBS, last=last, accuracy=accuracy).collect()}
    have = {g for g in GROUPS if last > 1 or len(GROUPS[g]) < 1000 or g == "between"}
    assert set(got) == have
    for g in have:
        assert got[g].n == len(GROUPS[g])
        for i, p in enumerate(PROBS):
            assert got[g][f"q{i}"] == interpolated([float(v) for v in GROUPS[g]], p), (g, p)


def test_null_groups_several_columns_and_none(spark):
    rows = [(None, 1, 5.0), (None, 1, 7.0), ("a", None, 1.0), ("a", 2, 3.0), ("a", 2, 4.0)]
    df = spark.createDataFrame(rows, "x string, y int, v double")
    got = {(r.x, r.y): (r.n, r.q0) for r in sel.quantiles(df, ["x", "y"], "v", [0.5]).collect()}
    assert got == {(None, 1): (2, 6.0), ("a", None): (1, 1.0), ("a", 2): (2, 3.5)}
    assert [tuple(r) for r in sel.quantiles(df, [], "v", [0.5, 1.0]).collect()] == [(5, 4.0, 7.0)]
    assert sel.quantiles(df.limit(0), ["x"], "v", [0.5]).count() == 0
    with pytest.raises(ValueError, match="between"):
        sel.quantiles(df, ["x"], "v", [1.5])


def test_no_array_of_a_groups_values(spark):
    """However large a group is, what is collected is what its last interval holds."""
    df = spark.range(200_000).selectExpr("'g' as g", "cast(hash(id) as double) as v")
    plan = sel.quantiles(df, ["g"], "v", [0.5], last=50)
    seen = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in seen
    values = sorted(r.v for r in df.collect())
    assert plan.first().q0 == (values[99_999] + values[100_000]) / 2
