"""Hierarchical equal-area cells of the sphere for any number of cells a side.

Cells are numbered base * nside^2 + x * nside + y (the "xy" scheme); ring and nested numbers are converted. Point to
cell and the renumbering are Column expressions; neighbours and range searches are Arrow-batched kernels that return
arrays for ``explode``.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from starloom.functions.base import C, clip, col, f64, let
from starloom.functions.sphere import radec_to_xyz


def side_length_arcmin(nside: float) -> float:
    return math.sqrt(4.0 * math.pi * (180.0 * 60.0 / math.pi) ** 2 / (12.0 * nside * nside))


def nside_for_side_length(arcmin: float) -> float:
    return math.sqrt(4.0 * math.pi * (180.0 * 60.0 / math.pi) ** 2 / 12.0) / arcmin


# --- Column expressions -----------------------------------------------------------------------------------------


def xyz_to_cell(x: C, y: C, z: C, nside: int) -> Column:
    """Cell of a unit vector, as a long.

    What later steps mention several times is worked out once: written out in full, the expression has thousands of
    nodes, and what is built on it tens of thousands, which only the driver's time and memory pay for.
    """
    half, n = math.pi / 2, F.lit(float(nside))
    start = F.struct(f64(z).alias("z"), F.atan2(f64(y), f64(x)).alias("phi"))

    def faced(p: Column) -> Column:
        phi = F.when(p["phi"] < 0, p["phi"] + 2 * math.pi).otherwise(p["phi"])
        return F.struct(p["z"].alias("z"), phi.alias("phi"))

    def turned(p: Column) -> Column:
        quarter = F.floor(p["phi"] / half)
        return F.struct(p["z"].alias("z"), (quarter.cast("int") % 4).alias("turn"), (p["phi"] - quarter * half).alias("phit"), (F.sqrt(F.greatest(F.lit(0.0), 3.0 * (1.0 - F.abs(p["z"])))) * n).alias("root"))

    def placed(p: Column) -> Column:
        kx, ky = p["root"] * (half - p["phit"]) / half, p["root"] * p["phit"] / half
        zu, pu = (p["z"] + 2.0 / 3.0) / (4.0 / 3.0), p["phit"] / half
        # polar faces: x grows with decreasing distance from the eastern edge, y from the western one
        north = p["z"] > 0
        px, py = F.when(north, n - kx).otherwise(ky), F.when(north, n - ky).otherwise(kx)
        return F.struct(p["z"].alias("z"), p["turn"].alias("turn"), px.alias("px"), py.alias("py"), ((zu + pu) * n).alias("ex"), ((zu - pu + 1.0) * n).alias("ey"))

    def numbered(p: Column) -> Column:
        turn, ex, ey = p["turn"], p["ex"], p["ey"]
        over_x, over_y, polar = ex >= n, ey >= n, F.abs(p["z"]) >= 2.0 / 3.0
        pole_base = F.when(p["z"] > 0, turn).otherwise(8 + turn)
        belt_base = F.when(over_x & over_y, turn).when(over_x, (turn + 1) % 4 + 4).when(over_y, turn + 4).otherwise(turn + 8)
        inner = lambda cap, belt, over: clip(F.floor(F.when(polar, cap).otherwise(F.when(over, belt - n).otherwise(belt))), F.lit(0).cast("long"), F.lit(nside - 1).cast("long"))
        base = F.when(polar, pole_base).otherwise(belt_base).cast("long")
        return base * F.lit(nside).cast("long") * nside + inner(p["px"], ex, over_x) * nside + inner(p["py"], ey, over_y)

    return let(let(let(let(start, faced), turned), placed), numbered)


def radec_to_cell(ra: C, dec: C, nside: int) -> Column:
    return xyz_to_cell(*radec_to_xyz(ra, dec), nside)


def decompose(cell: C, nside: int) -> tuple[Column, Column, Column]:
    """(base, x, y)."""
    c = col(cell).cast("long")
    within = c % (nside * nside)
    return F.floor(c / (nside * nside)).cast("long"), F.floor(within / nside).cast("long"), within % nside


def compose(base: Column, x: Column, y: Column, nside: int) -> Column:
    return base * (nside * nside) + x * nside + y


def _spread(v: Column, bits: int) -> Column:
    out = F.lit(0).cast("long")
    for i in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(v, i).bitwiseAND(F.lit(1).cast("long")), 2 * i))
    return out


def _gather(v: Column, bits: int) -> Column:
    out = F.lit(0).cast("long")
    for i in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(v, 2 * i).bitwiseAND(F.lit(1).cast("long")), i))
    return out


def _bits(nside: int) -> int:
    if nside & (nside - 1):
        raise ValueError("nested numbers exist for powers of two only")
    return nside.bit_length() - 1


def xy_to_nested(cell: C, nside: int) -> Column:
    base, x, y = decompose(cell, nside)
    bits = _bits(nside)
    return base * (nside * nside) + _spread(x, bits).bitwiseOR(F.shiftleft(_spread(y, bits), 1))


def nested_to_xy(cell: C, nside: int) -> Column:
    c, bits = col(cell).cast("long"), _bits(nside)
    base, within = F.floor(c / (nside * nside)).cast("long"), c % (nside * nside)
    return compose(base, _gather(within, bits), _gather(F.shiftright(within, 1), bits), nside)


def xy_to_ring(cell: C, nside: int) -> Column:
    """Ring numbering: rings from north to south, eastwards within a ring."""
    base, x, y = decompose(cell, nside)
    parts = F.struct(base.alias("b"), x.alias("x"), y.alias("y"), ((F.floor(base / 4) + 2) * nside - (x + y) - 1).alias("ring"))
    return let(parts, lambda p: _ring_index(p["b"], p["x"], p["y"], p["ring"], nside))


def _ring_index(base: Column, x: Column, y: Column, ring: Column, nside: int) -> Column:
    row, turn, n = F.floor(base / 4), base % 4, F.lit(nside).cast("long")
    total = n * n * 12
    # northern cap: ring r holds 4 r cells; belt: 4 nside; southern cap mirrored
    north_index = 2 * ring * (ring - 1) + turn * ring + (nside - 1 - y)
    south = 4 * n - ring
    south_index = total - 2 * south * (south + 1) + turn * south + x
    # half cells east of the meridian: an odd face row begins on it, the others half a face later
    halves = F.when(row == 1, 2 * turn).otherwise(2 * turn + 1) * n + x - y + F.when((ring - n) % 2 == 0, 0).otherwise(1)
    belt_index = 2 * n * (n - 1) + (ring - n) * 4 * n + F.pmod(F.floor(halves / 2), 4 * n)
    return F.when((row == 0) & (ring < n), north_index).when((row == 2) & (ring > 3 * n), south_index).otherwise(belt_index).cast("long")


def ring_to_xy(cell: C, nside: int) -> Column:
    """The inverse of ``xy_to_ring``: the cell at the centre of that place in its ring."""
    n, total, cap = nside, 12 * nside * nside, 2 * nside * (nside - 1)
    c = col(cell).cast("long")

    def polar(k: Column) -> Column:
        """(ring, place) within the northern cap."""
        first = F.floor((1.0 + F.sqrt(1.0 + 2.0 * k.cast("double"))) / 2.0).cast("long")
        fixed = let(first, lambda r: F.when(2 * r * (r - 1) > k, r - 1).when(2 * r * (r + 1) <= k, r + 1).otherwise(r))
        return let(fixed, lambda r: F.struct((1.0 - r.cast("double") * r / (3.0 * n * n)).alias("z"), ((k - 2 * r * (r - 1) + 0.5) / r).alias("q")))

    def belt(k: Column) -> Column:
        ring = F.floor(k / (4 * n)).cast("long") + n
        shift = F.when((ring - n) % 2 == 0, 0.5).otherwise(0.0)
        return F.struct(((2.0 * n - ring.cast("double")) * 2.0 / (3.0 * n)).alias("z"), ((k % (4 * n) + shift) / n).alias("q"))

    mirrored = let(polar(total - 1 - c), lambda p: F.struct((-p["z"]).alias("z"), (4.0 - p["q"]).alias("q")))
    centre = F.when(c < cap, polar(c)).when(c >= total - cap, mirrored).otherwise(belt(c - cap))
    half = math.pi / 2
    xyz = let(centre, lambda p: F.array(F.sqrt(F.greatest(F.lit(0.0), 1.0 - p["z"] * p["z"])) * F.cos(p["q"] * half), F.sqrt(F.greatest(F.lit(0.0), 1.0 - p["z"] * p["z"])) * F.sin(p["q"] * half), p["z"]))
    return let(xyz, lambda v: xyz_to_cell(v[0], v[1], v[2], n))


def convert_nside(cell: C, nside: int, to: int) -> Column:
    """The cell of another resolution that holds the centre of this one."""
    move = lambda v: F.floor((v.cast("double") + 0.5) / nside * to).cast("long")

    def moved(c: Column) -> Column:
        base, x, y = decompose(c, nside)
        return compose(base, move(x), move(y), to)

    return let(col(cell).cast("long"), moved)


# --- arrays -----------------------------------------------------------------------------------------------------


def np_cell_to_xyz(cell: np.ndarray, nside: int, dx=0.5, dy=0.5) -> np.ndarray:
    """Unit vectors of points inside cells; (0, 0) is the southern corner, (1, 1) the northern one."""
    cell = np.asarray(cell, np.int64)
    base, within = cell // (nside * nside), cell % (nside * nside)
    x, y = within // nside + dx, within % nside + dy
    row, turn = base // 4, base % 4
    n = float(nside)
    north, south = (row == 0) & (x + y > n), (row == 2) & (x + y < n)
    half = math.pi / 2
    # equatorial belt
    base_z, base_p = np.choose(row, [0.0, -2.0 / 3.0, -4.0 / 3.0]), np.where(row == 1, -0.5, 0.0)
    z = base_z + (x + y) / n * (2.0 / 3.0)
    phi = (turn + base_p + 0.5 + (x - y) / (2 * n)) * half
    # polar caps
    kx, ky = np.where(north, n - x, y), np.where(north, n - y, x)
    total = kx + ky
    zc = 1.0 - (total / n) ** 2 / 3.0
    with np.errstate(invalid="ignore", divide="ignore"):
        pc = np.where(total > 0, ky / np.where(total > 0, total, 1.0), 0.5) * half + turn * half
    cap = north | south
    z, phi = np.where(cap, np.where(south, -zc, zc), z), np.where(cap, pc, phi)
    r = np.sqrt(np.maximum(0.0, 1 - z * z))
    return np.stack([r * np.cos(phi), r * np.sin(phi), z], axis=-1)


def np_xyz_to_cell(v: np.ndarray, nside: int) -> np.ndarray:
    vx, vy, vz = v[..., 0], v[..., 1], np.clip(v[..., 2], -1, 1)
    half, n = math.pi / 2, float(nside)
    phi = np.arctan2(vy, vx) % (2 * math.pi)
    turn = np.floor(phi / half).astype(np.int64)
    phit, turn = phi - turn * half, turn % 4
    root = np.sqrt(np.maximum(0, 3 * (1 - np.abs(vz)))) * n
    kx, ky, north = root * (half - phit) / half, root * phit / half, vz > 0
    px, py = np.where(north, n - kx, ky), np.where(north, n - ky, kx)
    zu, pu = (vz + 2 / 3) / (4 / 3), phit / half
    ex, ey = (zu + pu) * n, (zu - pu + 1) * n
    ox, oy = ex >= n, ey >= n
    belt = np.where(ox & oy, turn, np.where(ox, (turn + 1) % 4 + 4, np.where(oy, turn + 4, turn + 8)))
    polar = np.abs(vz) >= 2 / 3
    x = np.clip(np.floor(np.where(polar, px, np.where(ox, ex - n, ex))), 0, n - 1).astype(np.int64)
    y = np.clip(np.floor(np.where(polar, py, np.where(oy, ey - n, ey))), 0, n - 1).astype(np.int64)
    base = np.where(polar, np.where(north, turn, 8 + turn), belt)
    return base * nside * nside + x * nside + y


def np_radec_to_xyz(ra, dec) -> np.ndarray:
    a, d = np.radians(ra), np.radians(dec)
    return np.stack([np.cos(d) * np.cos(a), np.cos(d) * np.sin(a), np.sin(d)], axis=-1)


@lru_cache(maxsize=100_000)
def np_neighbours(cell: int, nside: int) -> list[int]:
    """The cells that share an edge or a corner with ``cell`` (seven or eight, six at some corners of large cells).

    Points on small circles around the four corners and the middles of the edges are mapped back to cells, so the
    adjacency of faces needs no table.
    """
    ends = [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.5, 0.0), (0.0, 0.5), (1.0, 0.5), (0.5, 1.0)]
    centres = np.stack([np_cell_to_xyz(np.array([cell]), nside, dx, dy)[0] for dx, dy in ends])
    eps = 1e-3 / nside
    angle = np.arange(16) * (2 * math.pi / 16) + 0.1
    around = []
    for c in centres:
        other = np.array([0.0, 0.0, 1.0]) if abs(c[2]) < 0.9 else np.array([1.0, 0.0, 0.0])
        e = np.cross(other, c)
        e /= np.linalg.norm(e)
        f = np.cross(c, e)
        around.append(c + eps * (np.cos(angle)[:, None] * e + np.sin(angle)[:, None] * f))
    p = np.concatenate(around)
    found = np.unique(np_xyz_to_cell(p / np.linalg.norm(p, axis=1)[:, None], nside))
    return [int(c) for c in found if c != cell]


def np_distances_deg(cell: np.ndarray, nside: int, p: np.ndarray, rounds: int = 14) -> np.ndarray:
    """Angle from each unit vector to the nearest point of its cell; 0 inside. All four edges are searched on shrinking grids."""
    cell, out = np.asarray(cell, np.int64), np.zeros(len(cell))
    outside = np.flatnonzero(np_xyz_to_cell(p, nside) != cell)
    fixed, along = np.array([0.0, 1.0, 0.0, 1.0])[None, :, None], np.array([True, True, False, False])[None, :, None]
    for at in np.array_split(outside, max(1, -(-len(outside) // 2048))):
        c, v = cell[at][:, None, None], p[at][:, None, None, :]
        low, high = np.zeros((len(at), 4, 1)), np.ones((len(at), 4, 1))
        best = np.full(len(at), math.inf)
        for _ in range(rounds):
            t = low + (high - low) * np.linspace(0, 1, 17)
            d2 = ((np_cell_to_xyz(np.broadcast_to(c, t.shape), nside, np.where(along, t, fixed), np.where(along, fixed, t)) - v) ** 2).sum(axis=-1)
            best = np.minimum(best, d2.min(axis=(1, 2)))
            k, step = d2.argmin(axis=2)[..., None], (high - low) / 16
            low, high = np.maximum(low + step * (k - 1), low), np.minimum(low + step * (k + 1), high)
        out[at] = np.degrees(2 * np.arcsin(np.minimum(1.0, np.sqrt(best) / 2)))
    return out


def np_within_deg(cell: np.ndarray, nside: int, p: np.ndarray, radius: float) -> np.ndarray:
    """Whether each cell is within ``radius`` degrees of its unit vector; only those that points along the edges leave open are searched."""
    cell = np.asarray(cell, np.int64)
    out = np_xyz_to_cell(p, nside) == cell
    t, none, one = np.linspace(0, 1, 17), np.zeros(17), np.ones(17)
    x, y = np.stack([t, t, none, one]), np.stack([none, one, t, t])
    outside = np.flatnonzero(~out)
    open_ = []
    for at in np.array_split(outside, max(1, -(-len(outside) // 8192))):
        kinds, kind = np.unique(cell[at], return_inverse=True)
        edge = np_cell_to_xyz(kinds[:, None, None], nside, x, y)
        # no point of an edge is farther from one of these than the widest step between two
        step = np.linalg.norm(np.diff(edge, axis=2), axis=-1).max(axis=(1, 2))[kind] if len(kinds) else np.zeros(0)
        gap = np.sqrt(((edge[kind] - p[at][:, None, None, :]) ** 2).sum(axis=-1).min(axis=(1, 2))) if len(at) else np.zeros(0)
        chord = 2 * math.sin(math.radians(min(radius, 180.0)) / 2) * (1 + 1e-12)
        out[at] = gap <= chord * (1 - 1e-9)
        open_.append(at[(gap > chord * (1 - 1e-9)) & (gap - step <= chord)])
    left = np.concatenate(open_) if open_ else outside
    out[left] = np_distances_deg(cell[left], nside, p[left]) <= radius
    return out


def np_distance_deg(cell: int, nside: int, ra: float, dec: float, rounds: int = 14) -> float:
    """``np_distances_deg`` of one point."""
    return float(np_distances_deg(np.array([cell]), nside, np_radec_to_xyz(ra, dec)[None], rounds)[0])


def np_may_be_within(cell: np.ndarray, nside: int, p: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether each cell can be, and whether it surely is, within ``radius`` degrees of its unit vector, by its circle alone."""
    middle = np_cell_to_xyz(cell, nside)
    gap = np.degrees(2 * np.arcsin(np.minimum(1.0, np.linalg.norm(middle - p, axis=-1) / 2)))
    return gap - _reach_deg(nside) <= radius, gap <= radius


@lru_cache(maxsize=64)
def _reach_deg(nside: int) -> float:
    """Degrees from the centre of a cell to its farthest point at most, with room; of all cells up to nside 64, else of the coarsest kind scaled."""
    n = min(nside, 64)
    cells = np.arange(12 * n * n)
    t = np.linspace(0, 1, 17)
    middle, far = np_cell_to_xyz(cells, n), 0.0
    for dx, dy in [(a, b) for a in t for b in (0.0, 1.0)] + [(a, b) for a in (0.0, 1.0) for b in t]:
        far = max(far, float(np.linalg.norm(np_cell_to_xyz(cells, n, dx, dy) - middle, axis=1).max()))
    return math.degrees(2 * math.asin(min(1.0, far / 2))) * 1.1 * n / nside


def np_range_searches(ra: np.ndarray, dec: np.ndarray, radius: float, nside: int) -> list[list[int]]:
    """All cells within ``radius`` degrees of each point, growing outwards from its own cell, all points at once."""
    p = np_radec_to_xyz(np.asarray(ra, float), np.asarray(dec, float))
    own = np_xyz_to_cell(p, nside)
    rim_i, rim_c = np.arange(len(p)), own
    total = 12 * nside * nside
    seen, found = rim_i * total + rim_c, [(rim_i, rim_c)]
    while len(rim_i):
        kinds, kind = np.unique(rim_c, return_inverse=True)
        around = [np.array(np_neighbours(int(c), nside), np.int64) for c in kinds]
        size = np.array([len(a) for a in around])
        i = np.repeat(rim_i, size[kind])
        c = np.concatenate([around[k] for k in kind])
        new = np.setdiff1d(np.unique(i * total + c), seen, assume_unique=False)
        seen = np.concatenate([seen, new])
        i, c = new // total, new % total
        can, sure = np_may_be_within(c, nside, p[i], radius)
        check = np.flatnonzero(can & ~sure)
        sure[check] = np_within_deg(c[check], nside, p[i[check]], radius)
        rim_i, rim_c = i[sure], c[sure]
        found.append((rim_i, rim_c))
    i, c = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    turn = np.lexsort((c, i))
    return [part.tolist() for part in np.split(c[turn], np.cumsum(np.bincount(i, minlength=len(p)))[:-1])] if len(p) else []


def np_range_search(ra: float, dec: float, radius: float, nside: int) -> list[int]:
    """All cells within ``radius`` degrees of a point."""
    return np_range_searches(np.array([ra]), np.array([dec]), radius, nside)[0]


def neighbours(nside: int):
    """pandas UDF: cell -> array of its neighbours."""

    @F.pandas_udf("array<bigint>")
    def run(cell: pd.Series) -> pd.Series:
        known = {int(c): np_neighbours(int(c), nside) for c in cell.unique()}
        return cell.map(lambda c: known[int(c)])

    return run


def range_search(nside: int, radius: float):
    """pandas UDF: (ra, dec) -> cells within ``radius`` degrees."""

    @F.pandas_udf("array<bigint>")
    def run(ra: pd.Series, dec: pd.Series) -> pd.Series:
        return pd.Series(np_range_searches(ra.to_numpy(), dec.to_numpy(), radius, nside))

    return run


def within(nside: int, radius: float):
    """pandas UDF: (cell, ra, dec) -> whether the cell is within ``radius`` degrees of the point."""

    @F.pandas_udf("boolean")
    def run(cell: pd.Series, ra: pd.Series, dec: pd.Series) -> pd.Series:
        return pd.Series(np_within_deg(cell.to_numpy(), nside, np_radec_to_xyz(ra.to_numpy(), dec.to_numpy()), radius))

    return run


def distance(nside: int):
    """pandas UDF: (cell, ra, dec) -> degrees from the point to the cell."""

    @F.pandas_udf("double")
    def run(cell: pd.Series, ra: pd.Series, dec: pd.Series) -> pd.Series:
        return pd.Series(np_distances_deg(cell.to_numpy(), nside, np_radec_to_xyz(ra.to_numpy(), dec.to_numpy())))

    return run
