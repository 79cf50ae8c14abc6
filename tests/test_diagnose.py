"""Why-not diagnosis against a plain loop, and pixels that two headers agree on."""

import numpy as np
import pytest

from starloom.functions.wcs import Wcs, fit_tan
from starloom.operators import diagnose as dg
from starloom.operators.geohash import build_quads, enforce, np_code, np_sky_code
from starloom.operators.verify import Rules, decide, header_values

SIZE = 1000


def sky(n, seed):
    rng = np.random.default_rng(seed)
    return rng.uniform(207, 213, n), rng.uniform(22, 28, n), rng.permutation(n).astype(float)


def plain_reason(w, xy, stars, quads, radius, ab_px, depth, tolerance, rules, scale):
    """One field: the reason of every quad with a star on it, by loops."""
    px, py = w.np_radec_to_pixel(stars[0], stars[1])
    on = (px >= 0.5) & (px <= SIZE + 0.5) & (py >= 0.5) & (py <= SIZE + 0.5)
    out = {}
    for qid, members, code in quads:
        here = [s for s in members if on[s]]
        if not here:
            continue
        found = {}
        for s in here:
            d = np.hypot(xy[:, 0] - px[s], xy[:, 1] - py[s])
            if len(d) and d.min() <= radius:
                found[s] = int(d.argmin())
        if len(here) < 4:
            out[qid] = "outside"
        elif len(found) < 4:
            out[qid] = "no_source"
        elif len(set(found.values())) < 4:
            out[qid] = "shared_source"
        else:
            at = [found[s] for s in members]
            p = xy[at]
            codes = [np_code(q[None])[0] for q in (p, p[:, ::-1])]
            gaps = [np.sqrt(((c - code) ** 2).sum()) for c in codes]
            own = codes[1] if gaps[1] < gaps[0] else codes[0]
            circle = [own[i] ** 2 - own[i] + own[i + 1] ** 2 - own[i + 1] > 0.02 for i in (0, 2)]
            if not ab_px[0] <= np.hypot(*(p[1] - p[0])) <= ab_px[1]:
                out[qid] = "scale"
            elif max(at) >= depth:
                out[qid] = "depth"
            elif min(gaps) > tolerance:
                out[qid] = "code"
            elif own[0] + own[2] > 1 + 3 * tolerance or own[0] > own[2] + 1.5 * tolerance or any(circle):
                out[qid] = "pruned"
            else:
                m = np.array(members)
                h = fit_tan(p[:, 0], p[:, 1], stars[0][m], stars[1][m], crpix=(0.5 + SIZE / 2, 0.5 + SIZE / 2))
                h = Wcs(h.crval, h.crpix, h.cd, SIZE, SIZE)
                got = decide(h, xy, stars[0][on], stars[1][on], rules, at) if scale[0] <= h.pixel_scale <= scale[1] else None
                ok = scale[0] <= h.pixel_scale <= scale[1]
                out[qid] = "scale" if not ok else "solves" if got and got[0].logodds >= rules.solve else "verify"
    return out


@pytest.mark.parametrize("noise", [0.2, 1.2])
def test_equals_a_plain_loop(spark, noise):
    ra, dec, mag = sky(160, 5)
    stars = spark.createDataFrame([(i, float(a), float(d), float(m)) for i, (a, d, m) in enumerate(zip(ra, dec, mag, strict=True))], "id long, ra double, dec double, mag double")
    quads = build_quads(stars, 30, 0.8, 1.8, passes=2).select("quad_id", "stars", "code").persist()
    heads = {1: Wcs((210.0, 25.0), (500.5, 500.5), ((-0.004, 0.0008), (0.0008, 0.004)), SIZE, SIZE), 2: Wcs((209.0, 24.5), (450.0, 530.0), ((0.0036, 0.001), (-0.001, 0.0036)), SIZE, SIZE)}
    rng = np.random.default_rng(int(noise * 10))
    fields, rows = {}, []
    for f, w in heads.items():
        x, y = w.np_radec_to_pixel(ra, dec)
        on = np.flatnonzero((x >= 0.5) & (x <= SIZE + 0.5) & (y >= 0.5) & (y <= SIZE + 0.5))
        on = on[np.argsort(mag[on])][: 45 if f == 1 else 30]
        on = on[rng.random(len(on)) > 0.08]
        xy = np.stack([x[on], y[on]], axis=1) + rng.normal(0, noise, (len(on), 2))
        xy = np.vstack([xy, rng.uniform(0, SIZE, (5, 2))])
        fields[f] = xy
        rows += [(f, r, float(a), float(b)) for r, (a, b) in enumerate(xy)]
    headers = spark.createDataFrame([(f, *map(float, header_values(w))) for f, w in heads.items()], "field_id long, " + ", ".join(f"{h} double" for h in dg.HEADER))
    sources = spark.createDataFrame(rows, "field_id long, rank long, x double, y double")
    rules, scale = Rules(), (12.0, 18.0)
    got = dg.why_not(headers, sources, stars, quads, SIZE, SIZE, scale, (0.8, 1.8), depth=40, rules=rules)
    ab = (0.8 * 3600 / scale[1] * 0.9, 1.8 * 3600 / scale[0] * 1.1)
    listed = [(r.quad_id, list(r.stars), np.array(r.code)) for r in quads.collect()]
    want = {(f, q): reason for f, w in heads.items() for q, reason in plain_reason(w, fields[f], (ra, dec), listed, 3.0, ab, 40, 0.01, rules, scale).items()}
    have = {(r.field_id, r.quad_id): r.reason for r in got.collect()}
    assert have == want
    assert {"outside", "no_source"} < set(want.values()) <= set(dg.REASONS)
    if noise < 1:
        assert "solves" in want.values()


def test_stages_of_single_quads(spark):
    """One quad, moved so that it falls out at each stage in turn."""
    base = np.array([(200.0, 200.0), (500.0, 520.0), (300.0, 330.0), (380.0, 360.0)])
    order, code = enforce([0, 1, 2, 3], np_code(base[None])[0].tolist())
    quads = spark.createDataFrame([(7, order, code)], "quad_id long, stars array<bigint>, code array<double>")
    on = spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate(base)], "field_id long, star long, x double, y double")

    def reason(moved, on=on, depth=10, ab=(100.0, 900.0)):
        src = spark.createDataFrame([(1, r, float(x), float(y)) for r, (x, y) in enumerate(moved)], "field_id long, rank long, x double, y double")
        (row,) = dg.geometric_stages(on, src, quads, 5.0, ab, depth).collect()
        return row.reason

    assert reason(base) is None
    assert reason(base[:3]) == "no_source"
    assert reason(base, on.where("star < 3")) == "outside"
    assert reason(base, depth=3) == "depth"
    assert reason(base, ab=(500.0, 900.0)) == "scale"
    assert reason(base + [(0, 0), (0, 0), (4, -2.5), (0, 4.5)]) == "code"
    close = on.unionByName(on.limit(0)).where("star <> 3").unionByName(spark.createDataFrame([(1, 3, 303.0, 331.0)], on.schema))
    assert reason(base[:3], close) == "shared_source"
    assert dg.geometric_stages(on, on.limit(0).withColumnRenamed("star", "rank"), quads, 5.0, (1.0, 2.0), 3).first().n_found == 0


def test_codes_on_the_sky_and_in_pixels_agree():
    w = Wcs((210.0, 25.0), (500.5, 500.5), ((-0.0004, 0.00008), (0.00008, 0.0004)), SIZE, SIZE)
    x, y = np.array([200.0, 700.0, 420.0, 510.0]), np.array([250.0, 640.0, 400.0, 520.0])
    ra, dec = (np.radians(v) for v in w.np_pixel_to_radec(x, y))
    v = np.stack([np.cos(dec) * np.cos(ra), np.cos(dec) * np.sin(ra), np.sin(dec)], axis=1)
    codes = [np_code(p[None])[0] for p in (np.stack([x, y], axis=1), np.stack([y, x], axis=1))]
    assert min(np.abs(c - np_sky_code(v[None])[0]).max() for c in codes) < 1e-4


def test_headers_agree_at_one_pixel(spark):
    rng = np.random.default_rng(2)
    pairs = []
    for i in range(40):
        w = Wcs((float(rng.uniform(0, 360)), float(rng.uniform(-80, 80))), (500.5, 480.5), ((-0.002, 1e-4), (1e-4, 0.002)), SIZE, SIZE)
        v = w.rotated(float(rng.uniform(5, 300)))
        v = Wcs((w.crval[0] + float(rng.uniform(-0.05, 0.05)), w.crval[1] + float(rng.uniform(-0.05, 0.05))), v.crpix, v.cd, SIZE, SIZE)
        pairs.append((i, w, v))
    same = Wcs((10.0, 10.0), (1.0, 1.0), ((-0.002, 0.0), (0.0, 0.002)), SIZE, SIZE)
    pairs.append((40, same, same.shifted(3.0, 0.0)))  # agree nowhere
    rows = [(i, *map(float, header_values(a)), *map(float, header_values(b))) for i, a, b in pairs]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{p}_{h} double" for p in ("a", "b") for h in dg.HEADER))
    got = {r.id: r for r in dg.agreeing_pixels(df, "id", SIZE, SIZE).collect()}
    for i, a, b in pairs[:40]:
        assert got[i].converged
        ra, dec = a.np_pixel_to_radec(np.array([got[i].x]), np.array([got[i].y]))
        x, y = b.np_radec_to_pixel(ra, dec)
        assert abs(x[0] - got[i].x) < 1e-6 and abs(y[0] - got[i].y) < 1e-6
    assert not got[40].converged and got[40].x is None
