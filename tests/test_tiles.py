"""Tiled images against the same kernels over whole images."""

import time

import numpy as np
import pytest

from starloom.functions.wcs import Wcs
from starloom.operators import images as im
from starloom.operators import tiles as tl

W, H = 77, 50


def tiled(spark, images, size, width=W, height=H):
    rows = [(k, x, y, float(img[y, x])) for k, img in images.items() for y in range(img.shape[0]) for x in range(img.shape[1])]
    return tl.cut(spark.createDataFrame(rows, "image long, x int, y int, v double"), width, height, size)


def whole(tiles, size, width=W, height=H):
    out = {}
    for r in tl.to_pixels(tiles, size).collect():
        out.setdefault(r.image, np.full((height, width), np.nan))[r.y, r.x] = np.nan if r.v is None else r.v
    return out


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(2)
    return {1: rng.integers(0, 200, (H, W)).astype(float), 2: rng.normal(0, 1, (H, W)).cumsum(axis=1)}


@pytest.mark.parametrize(("radius", "size", "levels"), [(1, 16, 1024), (3, 16, 10), (9, 16, 1024), (20, 16, 1024), (4, 100, 1024), (40, 64, 1024)])
def test_median(spark, images, radius, size, levels):
    """Also halos wider than a tile and wider than the image."""
    got = whole(tl.median(tiled(spark, images, size), radius, W, H, size, levels), size)
    for k, img in images.items():
        assert np.array_equal(got[k], im.median_filter(img, radius)), k


def test_the_work_does_not_grow_with_the_radius():
    img = np.random.default_rng(0).integers(0, 64, (300, 300)).astype(float)

    def took(radius):
        patch = np.pad(img, radius, mode="edge")
        return min((lambda t: (tl.sliding_median(patch, radius), time.perf_counter() - t)[1])(time.perf_counter()) for _ in range(3))

    assert took(30) < 2.5 * took(2)
    assert np.array_equal(tl.sliding_median(np.pad(img[:40, :40], 5, mode="edge"), 5), im.median_filter(img[:40, :40], 5))


@pytest.mark.parametrize(("half", "size"), [(5, 16), (8, 16), (13, 16), (20, 64), (30, 16)])
def test_background(spark, images, half, size):
    got = whole(tl.background(tiled(spark, images, size), half, W, H, size), size)
    for k, img in images.items():
        assert np.allclose(got[k], im.median_background(img, half), atol=1e-12), k


SOURCE = Wcs((120.0, -30.0), (38.0, 25.0), ((-0.01, 0.001), (0.001, 0.01)), W, H)


@pytest.mark.parametrize("order", [0, 3])
@pytest.mark.parametrize("turn", [0.0, 33.0, 200.0])
def test_resample(spark, images, order, turn):
    target = SOURCE.rotated(turn)
    target = Wcs((120.1, -29.9), (45.0, 40.0), tuple(tuple(0.8 * v for v in row) for row in target.cd), 90, 80)
    got = whole(tl.resample(tiled(spark, images, 16), SOURCE, target, order, 16), 16, 90, 80)
    xx, yy = np.meshgrid(np.arange(90.0), np.arange(80.0))
    x, y = SOURCE.np_radec_to_pixel(*target.np_pixel_to_radec(xx.ravel() + 1, yy.ravel() + 1))
    x, y = x.reshape(xx.shape) - 1, y.reshape(xx.shape) - 1
    for k, img in images.items():
        want = im.resample(img, x, y, order)
        # the surface through the nodes is off by a hundred-thousandth of a pixel, so edges and ties may fall differently
        assert (np.isnan(got[k]) != np.isnan(want)).sum() <= 5
        both = np.isfinite(got[k]) & np.isfinite(want)
        off = np.abs(got[k][both] - want[both])
        assert both.sum() > 1000 and (off > 1e-2).sum() <= (0 if order else 5)


def test_surface_is_exact_enough():
    target = Wcs((120.4, -30.2), (200.0, 200.0), ((-0.02, 0.0), (0.0, 0.02)), 400, 400)
    for top, left in ((0, 0), (336, 336), (128, 64)):
        x, y = tl._surface(target, SOURCE, top, left, 64, 64)
        xx, yy = np.meshgrid(np.arange(left, left + 64.0), np.arange(top, top + 64.0))
        ex, ey = SOURCE.np_radec_to_pixel(*target.np_pixel_to_radec(xx.ravel() + 1, yy.ravel() + 1))
        assert np.abs(x.ravel() - ex + 1).max() < 1e-4 and np.abs(y.ravel() - ey + 1).max() < 1e-4


def test_too_little_overlap(spark, images):
    t = tiled(spark, images, 32)
    with pytest.raises(tl.NoOverlap):
        tl.resample(t, SOURCE, Wcs((140.0, 10.0), (10.0, 10.0), SOURCE.cd, 60, 60), size=32)
    with pytest.raises(tl.NoOverlap):
        tl.resample(t, SOURCE, Wcs((300.0, 30.0), (10.0, 10.0), SOURCE.cd, 60, 60), size=32)
    edge = SOURCE.shifted(-70.0, 0.0)
    with pytest.raises(tl.SmallOverlap, match="fewer than 16"):
        tl.resample(t, SOURCE, Wcs(edge.crval, edge.crpix, edge.cd, 60, 60), size=32)


def test_missing_pixels_and_tiles(spark):
    df = spark.createDataFrame([(5, 40, 40, 3.0), (5, 999, 0, 1.0), (5, -1, 0, 1.0)], "image long, x int, y int, v double")
    t = tl.cut(df, W, H, 16, empty=-1.0)
    rows = t.collect()
    assert len(rows) == 5 * 4 and sum(len(r.pixels) for r in rows) == W * H and sum(sum(r.pixels) for r in rows) == 3.0 - (W * H - 1)
    assert tl.median(t, 1, W, H, 16).count() == 20
    assert tl.cut(df.limit(0), W, H, 16).count() == 0
