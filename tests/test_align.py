"""Shifts by vote and plane polynomials as distortion by pixels."""

from dataclasses import replace

import numpy as np
import pytest

from starloom.functions.wcs import Wcs, fit_sip, tpv_distort
from starloom.operators import align


@pytest.mark.parametrize(("dx", "dy"), [(0.0, 0.0), (310.5, -180.25), (-7.9, 4.1), (8.0, 8.0)])
def test_a_header_off_by_hundreds_of_pixels(spark, dx, dy):
    """Found by vote, moved, and then good enough for a fit."""
    rng = np.random.default_rng(5)
    true = Wcs((150.0, 20.0), (500.5, 500.5), ((-0.0004, 0.00002), (0.00002, 0.0004)), 1000, 1000)
    x, y = rng.uniform(1, 1000, (2, 80))
    ra, dec = true.np_pixel_to_radec(x, y)
    wrong = true.shifted(dx, dy)
    rx, ry = wrong.np_radec_to_pixel(ra, dec)
    seen = [(1, float(a), float(b)) for a, b in zip(x[:60] + rng.normal(0, 0.4, 60), y[:60] + rng.normal(0, 0.4, 60), strict=True)] + [(1, float(a), float(b)) for a, b in rng.uniform(1, 1000, (30, 2))] + [(2, 5.0, 5.0)]
    refs = [(1, float(a), float(b)) for a, b in zip(rx, ry, strict=True)]
    got = align.voted_shifts(spark.createDataFrame(seen, "field_id long, x double, y double"), spark.createDataFrame(refs, "field_id long, x double, y double"), 400.0, 6.0).collect()
    assert [r.field_id for r in got] == [1] and got[0].votes >= 55
    moved = replace(wrong, crpix=(wrong.crpix[0] + got[0].dx, wrong.crpix[1] + got[0].dy))
    px, py = moved.np_radec_to_pixel(ra, dec)
    assert np.hypot(px - x, py - y).max() < 0.6
    near = [int(np.hypot(px - a, py - b).argmin()) for _, a, b in seen[:60]]
    assert near == list(range(60))
    fitted = fit_sip(np.array([s[1] for s in seen[:60]]), np.array([s[2] for s in seen[:60]]), ra[near], dec[near], moved, 1)
    assert np.hypot(*(p - q for p, q in zip(fitted.np_radec_to_pixel(ra, dec), (x, y), strict=True))).max() < 0.6


def test_terms_of_the_convention():
    assert align.plane_terms(12) == [(0, 0), (1, 0), (0, 1), 1, (2, 0), (1, 1), (0, 2), (3, 0), (2, 1), (1, 2), (0, 3), 3]
    assert align.plane_terms(40)[39] == 7 and align.plane_terms(40)[23] == 5 and align.plane_terms(40)[24] == (6, 0)
    u, v = np.random.default_rng(0).normal(0, 1, (2, 20))
    one, two = [0.01, 1.1, -0.2, 0.03, 0.4, 0.05, 0.6, 0.07, 0.08, 0.09, 0.1, 0.11], [0.02, 0.9, 0.1, 0.0, 0.3, 0.2, 0.1, 0.05, 0.04, 0.03, 0.02, 0.01]
    for got, want in zip(align.plane_polynomial(u, v, dict(enumerate(one)), dict(enumerate(two))), tpv_distort(u, v, one, two), strict=True):
        assert np.allclose(got, want)


@pytest.mark.parametrize("radial", [0.0, 2e-4])
def test_pixels_agree_with_the_plane(radial):
    w = Wcs((10.0, 70.0), (530.0, 380.0), ((-0.0007, 0.0001), (0.0001, 0.0007)), 1000, 800)
    first, second = {0: 1e-4, 1: 1.002, 2: 1e-3, 4: 3e-3, 6: -2e-3, 9: 4e-3, 11: radial}, {1: 0.998, 5: 2e-3, 8: -3e-3, 11: radial}
    out, error = align.pixel_distortion(w, first, second, order=5)
    assert error < 1e-3
    rng = np.random.default_rng(1)
    x, y = rng.uniform(1, 1000, 300), rng.uniform(1, 800, 300)
    plane = align.plane_polynomial(*(np.array(w.cd) @ np.stack([x - w.crpix[0], y - w.crpix[1]])), first, second)
    flat = replace(w, crpix=(0.0, 0.0), cd=((1.0, 0.0), (0.0, 1.0)))
    ra, dec = flat.np_pixel_to_radec(*plane)
    px, py = out.np_radec_to_pixel(ra, dec)
    assert np.hypot(px - x, py - y).max() < 2e-3
    again = out.np_pixel_to_radec(x, y)
    assert np.hypot((again[0] - ra) * np.cos(np.radians(dec)), again[1] - dec).max() < 1e-3 * 0.0007


def test_odd_headers(spark):
    row = (1, 500.0, 500.0, 0.001, 0.0, 0.0, 0.001, 1000.0, 1000.0, None, {})
    df = spark.createDataFrame([row], "id long, crpix0 double, crpix1 double, cd00 double, cd01 double, cd10 double, cd11 double, width double, height double, first map<int,double>, second map<int,double>")
    got = align.pixel_distortions(df, "id").first()
    assert got.error < 1e-9 and np.allclose(got.cd, [0.001, 0, 0, 0.001]) and all(abs(t.c) < 1e-9 for t in got.a + got.b)


def test_headers_of_several_sizes_at_once(spark):
    """The fit of many headers together is that of each alone, whatever their sizes, matrices and coefficients; without any there are none."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(30):
        cd = rng.normal(size=4) * 1e-3 + [0.01, 0.0, 0.0, 0.012]
        first = {int(k): float(c) for k, c in zip((0, 4, 5, 9), rng.normal(size=4) * 1e-3, strict=True)} if i % 5 else None
        second = {1: 1.01, 3: 1e-4 * i} if i % 3 else {}
        rows.append((i, 500.5 - i % 2, 400.5, *cd.tolist(), 1000.0 + 200 * (i % 3), 800.0, first, second))
    names = ["crpix0", "crpix1", "cd00", "cd01", "cd10", "cd11", "width", "height"]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{n} double" for n in names) + ", first map<int,double>, second map<int,double>")
    got = {r.id: r for r in align.pixel_distortions(df, "id", 3).collect()}
    assert len(got) == 30 and align.pixel_distortions(df.limit(0), "id", 3).collect() == []
    for i, x0, y0, a, b, c, d, width, height, first, second in rows:
        w, error = align.pixel_distortion(Wcs((0.0, 0.0), (x0, y0), ((a, b), (c, d)), width, height), first or {}, second, 3)
        r = got[i]
        assert np.allclose(r.cd, np.ravel(w.cd), rtol=1e-9, atol=1e-15) and abs(r.error - error) < 1e-8
        for poly, want in ((r.a, w.a), (r.b, w.b)):
            assert [(t.p, t.q) for t in poly] == sorted(want)
            for t in poly:
                assert abs(t.c - want[t.p, t.q]) * 500.0 ** (t.p + t.q) < 1e-7


def test_headers_are_not_fitted_one_by_one(spark, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("a header of its own")

    monkeypatch.setattr(align, "pixel_distortion", refuse)
    one = {"id": 1, "crpix0": 5.5, "crpix1": 5.5, "cd00": 0.01, "cd01": 0.0, "cd10": 0.0, "cd11": 0.01, "width": 10.0, "height": 10.0, "first": {4: 1e-3}, "second": {4: 1e-3}}
    assert len(align.pixel_distortions(spark.createDataFrame([one]), "id", 3).collect()) == 1
