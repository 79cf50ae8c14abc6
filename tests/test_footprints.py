"""Overlaps of many square footprints at once."""

import numpy as np

from starloom.functions.wcs import box, np_boxes_overlap


def test_pairs_at_once_are_pairs_one_by_one():
    rng = np.random.default_rng(5)
    ra, dec = rng.uniform(0, 360, 400), np.degrees(np.arcsin(rng.uniform(-1, 1, 400)))
    dec[:4] = 89.0, -89.5, 90.0, 0.0
    way, far = rng.uniform(0, 2 * np.pi, 400), rng.choice([0.5, 5.9, 6.0, 6.1, 8.4, 8.5, 60.0, 175.0], 400)
    dec2 = np.clip(dec + far * np.sin(way), -90, 90)
    ra2 = (ra + far * np.cos(way) / np.maximum(np.cos(np.radians(dec)), 0.01)) % 360
    got = np_boxes_overlap((ra, dec), (ra2, dec2), 6.0, 600)
    want = [box(a, b, 6.0, 600).overlaps(box(c, d, 6.0, 600)) for a, b, c, d in zip(ra, dec, ra2, dec2, strict=True)]
    assert got.tolist() == want and 50 < sum(want) < 350
    assert np_boxes_overlap((ra[:0], dec[:0]), (ra2[:0], dec2[:0]), 6.0, 600).tolist() == []
