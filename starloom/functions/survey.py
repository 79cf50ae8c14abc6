"""Survey geometry and further WCS constructors and distortions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from starloom.functions.base import C, f64
from starloom.functions.sphere import axis_angle_matrix, radec_to_xyz, xyz_to_dec, xyz_to_ra


def radec_to_munu(ra: C, dec: C, node: float = 95.0, incl: float = 0.0) -> tuple[Column, Column]:
    """Great-circle coordinates of a drift-scan stripe: a rotation about its node by the inclination."""
    x, y, z = radec_to_xyz(f64(ra) - node, dec)
    s, c = math.sin(math.radians(incl)), math.cos(math.radians(incl))
    yy, zz = y * c + z * s, z * c - y * s
    return F.pmod(xyz_to_ra(x, yy) + node, F.lit(360.0)), xyz_to_dec(x, yy, zz)


def munu_to_radec(mu: C, nu: C, node: float = 95.0, incl: float = 0.0) -> tuple[Column, Column]:
    return radec_to_munu(mu, nu, node, -incl)


# fixed values: solar velocity in kpc a year along the direction of galactic rotation, and that direction
SUN_SPEED = 240.0 * 1.02268944e-9


def rotation_direction() -> tuple[float, float, float]:
    """Unit vector towards galactic longitude 90, latitude 0, from the galactic pole and the longitude of the pole."""
    pole, node = (192.8595, 27.12825), 122.932
    a, d, t = math.radians(pole[0]), math.radians(pole[1]), math.radians(node - 90.0)
    east = (-math.sin(a), math.cos(a), 0.0)
    north = (-math.sin(d) * math.cos(a), -math.sin(d) * math.sin(a), math.cos(d))
    return tuple(math.cos(t) * n + math.sin(t) * e for n, e in zip(north, east, strict=True))


def remove_solar_motion(ra: C, dec: C, dist_kpc: C, pm_ra: C, pm_dec: C) -> tuple[Column, Column]:
    """Proper motions (mas/yr, RA component times cos dec) as seen without the sun's motion."""
    r, d = f64(ra), f64(dec)
    p = radec_to_xyz(r, d)
    q = radec_to_xyz(r + f64(pm_ra) / F.cos(F.radians(d)) / 3.6e6, d + f64(pm_dec) / 3.6e6)
    sun = rotation_direction()
    moved = [f64(dist_kpc) * a + f64(dist_kpc) * (b - a) - SUN_SPEED * s for a, b, s in zip(p, q, sun, strict=True)]
    ra3, dec3 = xyz_to_ra(moved[0], moved[1]), xyz_to_dec(*moved)
    dra = F.pmod(ra3 - r + 180.0, F.lit(360.0)) - 180.0
    return dra * F.cos(F.radians(dec3)) * 3.6e6, (dec3 - d) * 3.6e6


def tpv_distort(u: C, v: C, pv1: dict[int, float], pv2: dict[int, float]) -> tuple[Column, Column]:
    """TPV polynomial of intermediate coordinates by term number of the convention, up to the third order."""
    u, v = f64(u), f64(v)
    r = F.sqrt(u * u + v * v)

    def one(pv: dict[int, float], x: Column, y: Column) -> Column:
        terms = [F.lit(1.0), x, y, r, x * x, x * y, y * y, x * x * x, x * x * y, x * y * y, y * y * y, r * r * r]
        return sum((terms[i] * c for i, c in sorted(pv.items())), F.lit(0.0))

    return one(pv1, u, v), one(pv2, v, u)


def mollweide(lon: C, lat: C, rounds: int = 12) -> tuple[Column, Column]:
    """Mollweide coordinates; the auxiliary angle by unrolled Newton steps."""
    lam, phi = F.radians(F.pmod(f64(lon) + 180.0, F.lit(360.0)) - 180.0), F.radians(f64(lat))
    goal = math.pi * F.sin(phi)
    steps = F.sequence(F.lit(1), F.lit(rounds))
    theta = F.aggregate(steps, phi, lambda t, _: t - F.when(F.abs(F.cos(t)) > 1e-6, (2 * t + F.sin(2 * t) - goal) / (2 + 2 * F.cos(2 * t))).otherwise(F.lit(0.0)))
    return 2 * math.sqrt(2) / math.pi * lam * F.cos(theta), math.sqrt(2) * F.sin(theta)


def cylindrical_equal_area(lon: C, lat: C) -> tuple[Column, Column]:
    return F.pmod(f64(lon) + 180.0, F.lit(360.0)) - 180.0, F.degrees(F.sin(F.radians(f64(lat))))


__all__ = ["axis_angle_matrix", "cylindrical_equal_area", "mollweide", "munu_to_radec", "radec_to_munu", "remove_solar_motion", "rotation_direction", "tpv_distort"]
