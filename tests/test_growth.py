"""Areas grown cell by cell against distances measured one by one."""

import numpy as np
import pytest

from starloom.functions import healpix as hp
from starloom.operators.growth import margins, split_with_margin


@pytest.fixture(scope="module")
def sky():
    rng = np.random.default_rng(6)
    ra, dec = rng.uniform(0, 360, 250), np.degrees(np.arcsin(rng.uniform(-1, 1, 250)))
    dec[:2] = 90.0, -90.0
    return [(i, float(a), float(d)) for i, (a, d) in enumerate(zip(ra, dec, strict=True))]


@pytest.mark.parametrize(("area_nside", "nside", "margin"), [(1, 4, 6.0), (2, 8, 5.0), (2, 2, 5.0)])
def test_equals_measuring_every_star(spark, sky, area_nside, nside, margin):
    df = spark.createDataFrame(sky, "id long, ra double, dec double").selectExpr("*", "'x' as name")
    got = split_with_margin(df, area_nside, nside, margin)
    assert got.columns == ["id", "ra", "dec", "name", "area", "inside"]
    rows = got.collect()
    want = set()
    for i, ra, dec in sky:
        own = int(hp.np_xyz_to_cell(hp.np_radec_to_xyz(ra, dec)[None], area_nside)[0])
        for area in range(12 * area_nside**2):
            if area == own or margin and hp.np_distance_deg(area, area_nside, ra, dec) <= margin:
                want.add((i, area, area == own))
    have = [(r.id, r.area, r.inside) for r in rows]
    assert len(have) == len(set(have))
    # at a margin of nothing a star may stand on an edge to the last digit
    assert {h for h in have if margin or h[2]} == want


def test_growth_reaches_all_cells_and_no_others(spark):
    got = {(r.area, r.cell): r.whole for r in margins(spark, 1, 8, 7.0).collect()}
    for area in (0, 4, 9):
        for cell in range(12 * 64):
            v = hp.np_cell_to_xyz(np.array([cell]), 8)[0]
            gap = hp.np_distance_deg(area, 1, float(np.degrees(np.arctan2(v[1], v[0])) % 360), float(np.degrees(np.arcsin(v[2]))))
            own = cell // 64 == area
            assert not (own and (area, cell) in got)
            if not own and gap <= 7.0:
                assert (area, cell) in got
            if (area, cell) in got:
                assert gap <= 7.0 + 6.5 and (not got[(area, cell)] or gap <= 7.0)
    with pytest.raises(ValueError, match="fill"):
        margins(spark, 2, 3, 1.0)
