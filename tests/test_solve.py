import math

import numpy as np

from starloom.functions.wcs import Wcs, fit_sip, fit_tan
from starloom.operators import geohash as gh
from starloom.operators import verify as vf


def test_wcs_golden_values(spark):
    tan = Wcs((10.4, -74.1), (512.0, 512.0), ((-3e-4, 2e-5), (2e-5, 3e-4)), 1024, 1024)
    for sin in (False, True):
        w = Wcs(tan.crval, tan.crpix, tan.cd, 1024, 1024, sin)
        x, y = np.array([1.0, 512.0, 900.5]), np.array([1.0, 512.0, 33.25])
        ra, dec = w.np_pixel_to_radec(x, y)
        bx, by = w.np_radec_to_pixel(ra, dec)
        assert np.allclose(bx, x, atol=1e-8) and np.allclose(by, y, atol=1e-8) and np.isclose(ra[1], 10.4) and np.isclose(dec[1], -74.1)
        df = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x double, y double")
        got = df.select(*[c.alias(n) for c, n in zip(w.pixel_to_radec("x", "y"), ("ra", "dec"), strict=True)])
        assert np.allclose(got.toPandas().to_numpy(), np.stack([ra, dec], axis=1), atol=1e-9)
        back = got.select(*[c.alias(n) for c, n in zip(w.radec_to_pixel("ra", "dec"), ("px", "py"), strict=True)]).toPandas().to_numpy()
        assert np.allclose(back, np.stack([x, y], axis=1), atol=1e-7)
    assert tan.parity == -1 and abs(tan.pixel_scale - 3600 * math.sqrt(9e-8 + 4e-10)) < 1e-9


def test_fits():
    rng = np.random.default_rng(2)
    true = Wcs((150.0, 30.0), (500.0, 400.0), ((-4e-4, 1e-4), (1e-4, 4e-4)), 1000, 800)
    x, y = rng.uniform(0, 1000, 60), rng.uniform(0, 800, 60)
    got = fit_tan(x, y, *true.np_pixel_to_radec(x, y), crpix=(500.0, 400.0))
    assert np.allclose(got.crval, true.crval, atol=1e-6) and abs(got.pixel_scale / true.pixel_scale - 1) < 1e-4
    fx, fy = got.np_radec_to_pixel(*true.np_pixel_to_radec(x, y))
    assert np.hypot(fx - x, fy - y).max() < 0.1
    bent = Wcs(true.crval, true.crpix, true.cd, 1000, 800, a={(2, 0): 2e-5, (1, 1): -1e-5}, b={(0, 2): 1.5e-5})
    ra, dec = bent.np_pixel_to_radec(x, y)
    sip = fit_sip(x, y, ra, dec, true, 2, 4)
    px, py = sip.np_radec_to_pixel(ra, dec)
    assert np.hypot(px - x, py - y).max() < 0.05
    back = sip.np_pixel_to_radec(x, y)
    assert np.abs(back[0] - ra).max() < 1e-6 and np.abs(back[1] - dec).max() < 1e-6


def test_codes_are_invariant():
    rng = np.random.default_rng(3)
    p = rng.uniform(0, 100, (50, 4, 2))
    t = 0.7
    q = 3.0 * p @ np.array([[math.cos(t), math.sin(t)], [-math.sin(t), math.cos(t)]]) + 5
    assert np.allclose(gh.np_code(p), gh.np_code(q))
    assert np.allclose(gh.np_code(p[:, [1, 0, 2, 3]]), 1 - gh.np_code(p))
    for c in gh.np_code(p):
        s, k = gh.enforce([10, 11, 12, 13], c.tolist())
        assert gh.obeys(k) and sorted(s) == [10, 11, 12, 13]


def test_verify_prefers_the_truth():
    rng = np.random.default_rng(4)
    refs = rng.uniform(0, 1000, (60, 2))
    test = np.concatenate([refs[:30] + rng.normal(0, 0.7, (30, 2)), rng.uniform(0, 1000, (10, 2))])[rng.permutation(40)]
    good = vf.verify(test, refs, 1e6, np.ones(40))
    bad = vf.verify(test + 50, refs, 1e6, np.ones(40))
    assert good.logodds > 100 > 20 > bad.logodds and good.counts[0] >= 27
    twice = np.concatenate([refs[:1] + 2.0, refs[:1] + 0.1, refs[1:20]])
    f = vf.verify(twice, refs, 1e6, np.ones(21))
    assert f.theta[1] == 0 and f.theta[0] == -2


def slow_verify(test, refs, area, sigma2, d=0.25):
    """Log-odds and counts by plain lists: every candidate explanation is priced from the start again."""
    n, owner, theta, best, top = len(refs), {}, [], -math.inf, []

    def price(theta):
        total, mu, sums = 0.0, 0, []
        for p, s2, t in zip(test, sigma2, theta, strict=False):
            if t >= 0:
                d2 = sum((a - b) ** 2 for a, b in zip(p, refs[t], strict=True))
                total += math.log((1 - d) / (2 * math.pi * s2 * n)) - d2 / (2 * s2) + math.log(area)
                mu += 1
            else:
                total += math.log(d + (1 - d) * mu / n)
            sums.append(total)
        return sums

    for i, p in enumerate(test):
        gaps = [sum((a - b) ** 2 for a, b in zip(p, r, strict=True)) for r in refs]
        j = min(range(n), key=lambda k: gaps[k]) if n else -1
        if j < 0 or gaps[j] >= 25 * sigma2[i] or price([*theta, j])[-1] <= price([*theta, -1])[-1]:
            theta.append(-1)
        elif j not in owner:
            owner[j] = i
            theta.append(j)
        else:
            handed = [*theta[: owner[j]], -2, *theta[owner[j] + 1 :], j]
            kept = [*theta, -2]
            # matches after the old one keep their price while the two ways are compared
            if sum(_terms(handed, price, owner[j], theta)) > sum(_terms(kept, price, owner[j], theta)):
                theta, owner[j] = handed, i
            else:
                theta = kept
        if (now := price(theta)[-1]) > best:
            best, top = now, list(theta)
    return best, (sum(t >= 0 for t in top), sum(t == -1 for t in top), sum(t == -2 for t in top))


def _terms(theta, price, old, before):
    sums = [0.0, *price(theta)]
    return [sums[k + 1] - sums[k] for k in range(old, len(theta)) if k in (old, len(theta) - 1) or before[k] < 0]


def test_verify_against_plain_lists():
    rng = np.random.default_rng(12)
    for n in (1, 5, 30):
        for _ in range(12):
            refs = rng.uniform(0, 60, (n, 2))
            test = np.concatenate([refs[rng.integers(0, n, 2 * n)] + rng.normal(0, 1.0, (2 * n, 2)), rng.uniform(0, 60, (n, 2))])[rng.permutation(3 * n)]
            s2 = rng.uniform(0.5, 2, len(test))
            fold = vf.verify(test, refs, 3600.0, s2, bail=-1e9)
            logodds, counts = slow_verify(test.tolist(), refs.tolist(), 3600.0, s2.tolist())
            assert abs(fold.logodds - logodds) < 1e-8 and fold.counts == counts


def test_dedup_drops_fainter_neighbours():
    rng = np.random.default_rng(5)
    xy, r = rng.uniform(0, 100, (300, 2)), rng.uniform(0.5, 6, 300)
    kept = []
    gone = set()
    for i in range(300):
        if i not in gone:
            kept.append(i)
            gone |= {j for j in range(i + 1, 300) if ((xy[i] - xy[j]) ** 2).sum() <= r[i] ** 2}
    assert vf.dedup_sources(xy, r).tolist() == kept and len(kept) < 290
    assert vf.dedup_sources(np.zeros((0, 2)), np.zeros(0)).tolist() == []


def test_turns_over_bins():
    bins = np.array([3, 3, 0, 3, 1, 0])
    assert vf.in_turns(bins).tolist() == [2, 4, 0, 5, 1, 3]
    assert vf.test_bins(np.array([[0.5, 0.5], [99.9, 0.5], [100.0, 100.0], [10.0, 60.0]]), 100, 100, 4, 2).tolist() == [0, 3, 7, 4]


def test_quad_stars_do_not_testify_and_a_near_header_is_refitted():
    rng = np.random.default_rng(9)
    true = Wcs((80.0, 10.0), (500.5, 500.5), ((-0.004, 0.0), (0.0, 0.004)), 1000, 1000)
    xy = rng.uniform(20, 980, (80, 2))
    ra, dec = true.np_pixel_to_radec(xy[:, 0], xy[:, 1])
    seen = xy + rng.normal(0, 0.4, xy.shape)
    fold, test, _ = vf.verify_header(true, seen, ra, dec, vf.Rules(), [0, 1, 2, 3])
    assert len(test) <= 76 and not any((test == seen[i]).all(axis=1).any() for i in range(4)) and fold.counts[0] > 60
    binned, fewer, _ = vf.verify_header(true, seen, ra, dec, vf.Rules(pix_err=60.0, bin_arcmin=30.0), [0, 1, 2, 3])
    assert len(fewer) < len(test)  # errors so large that only bins near the quad say anything
    off = Wcs((80.004, 10.003), (500.5, 500.5), ((-0.00401, 0.00001), (-0.00001, 0.00401)), 1000, 1000)
    rough = vf.verify_header(off, seen, ra, dec, vf.Rules())[0].logodds
    rules = vf.Rules(tune=rough - 1, keep=rough + 1)
    got, better, tuned, rms = vf.decide(off, seen, ra, dec, rules, None)
    assert tuned and got.logodds > rough + 1 and rms < 0.8 * true.pixel_scale and better.a
    assert vf.decide(off, seen, ra, dec, vf.Rules(tune=rough + 1, keep=rough + 2), None) is None


def test_solves_a_made_up_field(spark):
    rng = np.random.default_rng(6)
    ra, dec = 210 + rng.uniform(-7, 7, 500), 25 + rng.uniform(-6, 6, 500)
    mag = rng.permutation(500)
    stars = spark.createDataFrame([(i, float(a), float(d), float(m)) for i, (a, d, m) in enumerate(zip(ra, dec, mag, strict=True))], "id long, ra double, dec double, mag double")
    quads = gh.build_quads(stars, 30, 0.8, 1.8, passes=3, reuse=8).cache()
    assert quads.count() > 60
    for r in quads.take(50):
        assert gh.obeys(list(r.code)) and len(set(r.stars)) == 4
    assert quads.selectExpr("array_sort(stars) s").distinct().count() == quads.count()
    true = Wcs((210.0, 25.0), (500.5, 500.5), ((-0.004, 0.0008), (0.0008, 0.004)), 1000, 1000)
    x, y = true.np_radec_to_pixel(ra, dec)
    ok = np.flatnonzero((x > 0.5) & (x < 1000) & (y > 0.5) & (y < 1000))
    ok = ok[np.argsort(mag[ok])]
    xy = np.stack([x[ok], y[ok]], axis=1) + rng.normal(0, 0.3, (len(ok), 2))
    xy = np.insert(xy, 5, rng.uniform(0, 1000, (2, 2)), axis=0)
    sources = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "field_id long, rank long, x double, y double")
    got = vf.solve(sources, stars, quads, 1000, 1000, (12.0, 18.0), (0.8, 1.8), depths=(8, 20), rules=vf.Rules(bin_arcmin=75.0)).collect()
    assert len(got) == 1 and got[0].logodds > math.log(1e9) and abs(got[0].scale - true.pixel_scale) < 0.2
    assert abs(got[0].crval0 - 210.0) < 0.02 and abs(got[0].crval1 - 25.0) < 0.02
    found = Wcs((got[0].crval0, got[0].crval1), (got[0].crpix0, got[0].crpix1), ((got[0].cd00, got[0].cd01), (got[0].cd10, got[0].cd11)), 1000, 1000)
    assert got[0].depth == 8 or got[0].n_tried >= 1
    elsewhere = vf.solve(sources, stars, quads, 1000, 1000, (12.0, 18.0), (0.8, 1.8), depths=(20,), within=(100.0, -40.0, 20.0))
    assert elsewhere.count() == 0
    better = vf.tweak(found, xy, ra, dec, order=2)
    bx, by = better.np_radec_to_pixel(ra[ok], dec[ok])
    assert np.median(np.hypot(bx - x[ok], by - y[ok])) < 0.5
    pairs = vf.correspondences(sources, stars, found, 8.0)
    assert pairs.count() >= 0.8 * len(ok)
