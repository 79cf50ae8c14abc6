"""The chain before solving, step by step against plain lists."""

import math
from collections import Counter, defaultdict

import numpy as np

from starloom.operators.prefilter import prefilter, without_lines
from starloom.operators.uniformize import grid_shape


def slow_lines(rows, at, cut):
    n = Counter(math.floor(r[at] + 0.5) for r in rows)
    full = {b: c - 1 for b, c in n.items() if c > 1}
    mean = sum(full.values()) / len(full) if full else 0
    bad = {b for b, k in full.items() if k * math.log(mean) - mean - k * (k - 1) / 2 < -cut}
    return [r for r in rows if math.floor(r[at] + 0.5) not in bad]


def slow_chain(rows, cut, boxes, keep):
    """Ids of one field (id, x, y, flux, sky) in order."""
    rows = slow_lines(slow_lines(rows, 1, cut), 2, cut)
    one, two = (sorted(rows, key=lambda r: (-f(r), r[0])) for f in (lambda r: r[3], lambda r: r[3] + r[4]))
    order, seen = [], set()
    for pair in zip(one, two, strict=True):
        for r in pair:
            if r[0] not in seen:
                seen.add(r[0])
                order.append(r)
    xs, ys = ([r[k] for r in rows] for k in (1, 2))
    nx, ny = grid_shape(max(xs) - min(xs), max(ys) - min(ys), boxes)
    cell = lambda v, vs, n: min(int((v - min(vs)) / (max(vs) - min(vs)) * n), n - 1)
    piles = defaultdict(list)
    for r in order:
        piles[cell(r[2], ys, ny) * nx + cell(r[1], xs, nx)].append(r[0])
    out = []
    for k in range(max(map(len, piles.values()))):
        out += [piles[b][k] for b in sorted(piles) if k < len(piles[b])]
    return out[:keep]


def test_the_chain_of_several_fields(spark):
    rng = np.random.default_rng(4)
    rows = []
    for f in range(4):
        n = 150 + 60 * f
        x, y = rng.uniform(0, 400 + 200 * f, n), rng.uniform(0, 300, n)
        x[: 40 if f % 2 else 0] = 77.0
        rows += [(f, 1000 * f + i, float(x[i]), float(y[i]), float(rng.integers(1, 90)), float(rng.integers(0, 50))) for i in range(n)]
    odd = [(0, 9000, None, 1.0, 1.0, 1.0), (0, 9001, 1.0, float("nan"), 1.0, 1.0), (0, 9002, 1.0, 1.0, None, 1.0), (7, 9003, 5.0, 5.0, 1.0, 0.0), (7, 9004, 5.0, 5.0, 2.0, 0.0)]
    df = spark.createDataFrame(rows + odd, "field_id long, id long, x double, y double, flux double, sky double")
    got = defaultdict(list)
    for r in sorted(prefilter(df, background="sky", cut=30.0, boxes=12, keep=90).collect(), key=lambda r: (r.field_id, r.place)):
        assert r.place == len(got[r.field_id])
        got[r.field_id].append(r.id)
    assert got.pop(7) == [9004, 9003]
    for f in range(4):
        assert got[f] == slow_chain([r[1:] for r in rows if r[0] == f], 30.0, 12, 90), f
        assert not set(got[f]) & {1000 * f + i for i in range(40)} or f % 2 == 0


def test_parts_of_the_chain(spark):
    df = spark.createDataFrame([(1, i, float(i % 7), float(i), float(i % 3)) for i in range(30)], "field_id long, id long, x double, y double, flux double")
    plain = prefilter(df, cut=None, boxes=0)
    assert [r.id for r in plain.orderBy("place").collect()] == sorted(range(30), key=lambda i: (-(i % 3), i))
    assert prefilter(df, keep=4).count() == 4 and prefilter(df.limit(0)).count() == 0
    assert without_lines(df, "field_id", ["x"], cut=1e9).count() == 30
