"""Sky polygons whose sides stand for curves."""

import numpy as np

from starloom.functions import healpix as hp
from starloom.operators.polygons import containing
from starloom.plans.outputs import base_cells, in_base_cell


def test_positions_beside_curved_sides(spark):
    """Straight sides between 40 vertices cut a little off a base cell; positions just inside and outside its outline tell."""
    rng = np.random.default_rng(4)
    t, side, cell = rng.uniform(0, 1, 3000), rng.integers(0, 4, 3000), rng.integers(4, 8, 3000)
    off = rng.choice([-1e-5, 1e-5], 3000)
    dx, dy = np.select([side == 0, side == 1], [off, 1 + off], t), np.select([side == 2, side == 3], [off, 1 + off], t)
    v = hp.np_cell_to_xyz(cell, 1, dx, dy)
    own = hp.np_xyz_to_cell(v, 1)
    ra, dec = np.degrees(np.arctan2(v[:, 1], v[:, 0])) % 360, np.degrees(np.arcsin(v[:, 2]))
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(ra, dec, strict=True))], "id long, ra double, dec double")
    want = {(i, f"region {c}") for i, c in enumerate(own.tolist()) if 4 <= c <= 7}
    assert {tuple(r) for r in containing(points, base_cells()[4:8], in_base_cell).collect()} == want
    assert {tuple(r) for r in containing(points, base_cells()[4:8]).collect()} != want
