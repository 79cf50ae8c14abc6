"""Angles, distances, unit vectors, sexagesimal text and reference frames as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from starloom.functions.base import C, col, f64

ARCSEC = 3600.0


# --- unit vectors -----------------------------------------------------------------------------------------------


def radec_to_xyz(ra: C, dec: C) -> tuple[Column, Column, Column]:
    """Unit vector of a sky position in degrees."""
    a, d = F.radians(f64(ra)), F.radians(f64(dec))
    return F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d)


def xyz_to_ra(x: C, y: C) -> Column:
    return F.pmod(F.degrees(F.atan2(f64(y), f64(x))), F.lit(360.0))


def xyz_to_dec(x: C, y: C, z: C) -> Column:
    x, y, z = f64(x), f64(y), f64(z)
    return F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))


def ra_normalize(ra: C) -> Column:
    return F.pmod(f64(ra), F.lit(360.0))


def derivatives_at_radec(ra: C, dec: C) -> tuple[tuple[Column, ...], tuple[Column, ...]]:
    """Unit tangents towards increasing RA (at fixed dec) and increasing dec."""
    a, d = F.radians(f64(ra)), F.radians(f64(dec))
    return (-F.sin(a), F.cos(a), F.lit(0.0)), (-F.sin(d) * F.cos(a), -F.sin(d) * F.sin(a), F.cos(d))


# --- distances --------------------------------------------------------------------------------------------------


def deg_to_dist(deg: C) -> Column:
    """Chord on the unit sphere of an angle."""
    return 2.0 * F.sin(F.radians(f64(deg)) / 2.0)


def dist_to_deg(dist: C) -> Column:
    return F.degrees(2.0 * F.asin(F.least(f64(dist) / 2.0, F.lit(1.0))))


def rad_to_distsq(rad: C) -> Column:
    return 2.0 * (1.0 - F.cos(f64(rad)))


def distsq_to_rad(d2: C) -> Column:
    return F.acos(1.0 - f64(d2) / 2.0)


def distsq_to_arcsec(d2: C) -> Column:
    return F.degrees(distsq_to_rad(d2)) * ARCSEC


def distsq_between(ra1: C, dec1: C, ra2: C, dec2: C) -> Column:
    """Squared chord between two positions."""
    p, q = radec_to_xyz(ra1, dec1), radec_to_xyz(ra2, dec2)
    return sum(((a - b) * (a - b) for a, b in zip(p, q, strict=True)), F.lit(0.0))


def degrees_between(ra1: C, dec1: C, ra2: C, dec2: C) -> Column:
    return dist_to_deg(F.sqrt(distsq_between(ra1, dec1, ra2, dec2)))


def arcsec_between(ra1: C, dec1: C, ra2: C, dec2: C) -> Column:
    return degrees_between(ra1, dec1, ra2, dec2) * ARCSEC


def within_radius(ra: C, dec: C, ra0: float, dec0: float, radius: float, inner: float = 0.0) -> Column:
    """Cone, or annulus if ``inner`` is positive, by the dot product with a fixed centre."""
    x, y, z = radec_to_xyz(ra, dec)
    a, d = math.radians(ra0), math.radians(dec0)
    dot = x * (math.cos(d) * math.cos(a)) + y * (math.cos(d) * math.sin(a)) + z * math.sin(d)
    inside = dot >= math.cos(math.radians(radius))
    return inside & (dot <= math.cos(math.radians(inner))) if inner > 0 else inside


def ra_ranges_overlap(a1: C, a2: C, b1: C, b2: C) -> Column:
    """Whether two RA intervals, each from its first to its second end eastwards and under 360 degrees, meet."""
    width_a, width_b = F.pmod(f64(a2) - f64(a1), F.lit(360.0)), F.pmod(f64(b2) - f64(b1), F.lit(360.0))
    return (F.pmod(f64(b1) - f64(a1), F.lit(360.0)) <= width_a) | (F.pmod(f64(a1) - f64(b1), F.lit(360.0)) <= width_b)


# --- sexagesimal ------------------------------------------------------------------------------------------------


def hms_to_ra(h: C, m: C, s: C) -> Column:
    return 15.0 * (f64(h) + (f64(m) + f64(s) / 60.0) / 60.0)


def dms_to_dec(sign: C, d: C, m: C, s: C) -> Column:
    return f64(sign) * (f64(d) + (f64(m) + f64(s) / 60.0) / 60.0)


def _clock(millis: Column) -> Column:
    sec = F.floor(millis / 1000)
    part = lambda v, n: F.lpad(v.cast("string"), n, "0")
    return F.concat(part(F.floor(sec / 3600), 2), F.lit(":"), part(F.floor(sec / 60) % 60, 2), F.lit(":"), part(sec % 60, 2), F.lit("."), part(millis % 1000, 3))


def ra_to_hms(ra: C) -> Column:
    """``HH:MM:SS.mmm`` of an RA in degrees, rounded with carry and wrapped at 24 hours."""
    millis = F.floor(ra_normalize(ra) / 15.0 * 3600000.0 + 0.5).cast("long") % 86400000
    return _clock(millis)


def dec_to_dms(dec: C) -> Column:
    """``+DD:MM:SS.mmm`` of a declination in degrees, rounded with carry."""
    millis = F.floor(F.abs(f64(dec)) * 3600000.0 + 0.5).cast("long")
    return F.concat(F.when(f64(dec) < 0, F.lit("-")).otherwise(F.lit("+")), _clock(millis))


_PARTS = r"^\s*([+-])?(\d{1,2}):(\d{1,2}):(\d*(?:\.\d*)?)\s*$"


def _sexagesimal(text: Column) -> Column:
    part = lambda i: F.regexp_extract(text, _PARTS, i)
    value = part(2).cast("double") + (part(3).cast("double") + F.when(part(4).isin("", "."), F.lit(0.0)).otherwise(part(4).try_cast("double")) / 60.0) / 60.0
    return F.when(part(1) == "-", -value).otherwise(value)


def parse_ra(text: C) -> Column:
    """Degrees of ``H:M:S`` or of a decimal number; null if neither."""
    t = col(text)
    return F.when(t.rlike(_PARTS), 15.0 * _sexagesimal(t)).otherwise(t.try_cast("double"))


def parse_dec(text: C) -> Column:
    t = col(text)
    return F.when(t.rlike(_PARTS), _sexagesimal(t)).otherwise(t.try_cast("double"))


# --- frames -----------------------------------------------------------------------------------------------------

# fixed values: J2000 galactic pole, galactic longitude of the celestial pole, in degrees
GALACTIC_POLE = (192.8595, 27.12825)
NORTH_IN_GALACTIC = 122.932


def obliquity(epoch: float = 2000.0) -> float:
    """Inclination of the ecliptic in degrees; fixed values: the polynomial in Julian centuries, in arcseconds."""
    t = (epoch - 2000.0) / 100.0
    return 23.0 + 26.0 / 60.0 + (21.448 - 46.82 * t - 0.0006 * t * t - 0.0018 * t * t * t) / 3600.0


def _rotate(ra: C, dec: C, pole: tuple[float, float], node: float) -> tuple[Column, Column]:
    """Longitude and latitude in the frame whose pole is at ``pole``; ``node`` is the longitude of the old pole."""
    a, d = F.radians(f64(ra) - pole[0]), F.radians(f64(dec))
    sp, cp = math.sin(math.radians(pole[1])), math.cos(math.radians(pole[1]))
    lat = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(d) * sp + F.cos(d) * cp * F.cos(a))))
    lon = F.atan2(F.cos(d) * F.sin(a), F.sin(d) * cp - F.cos(d) * sp * F.cos(a))
    return F.pmod(node - F.degrees(lon), F.lit(360.0)), F.degrees(lat)


def radec_to_galactic(ra: C, dec: C) -> tuple[Column, Column]:
    return _rotate(ra, dec, GALACTIC_POLE, NORTH_IN_GALACTIC)


def galactic_to_radec(lon: C, lat: C) -> tuple[Column, Column]:
    return _rotate(lon, lat, (NORTH_IN_GALACTIC, GALACTIC_POLE[1]), GALACTIC_POLE[0])


def radec_to_ecliptic(ra: C, dec: C, epoch: float = 2000.0) -> tuple[Column, Column]:
    x, y, z = radec_to_xyz(ra, dec)
    s, c = math.sin(math.radians(obliquity(epoch))), math.cos(math.radians(obliquity(epoch)))
    yy, zz = c * y + s * z, c * z - s * y
    return xyz_to_ra(x, yy), xyz_to_dec(x, yy, zz)


def ecliptic_to_radec(lon: C, lat: C, epoch: float = 2000.0) -> tuple[Column, Column]:
    x, y, z = radec_to_xyz(lon, lat)
    s, c = math.sin(math.radians(obliquity(epoch))), math.cos(math.radians(obliquity(epoch)))
    yy, zz = c * y - s * z, c * z + s * y
    return xyz_to_ra(x, yy), xyz_to_dec(x, yy, zz)


def pm_radec_to_galactic(ra: C, dec: C, pm_ra: C, pm_dec: C) -> tuple[Column, Column]:
    """Proper motion (RA component times cos dec) turned into the galactic frame."""
    a, d, p = F.radians(f64(ra) - GALACTIC_POLE[0]), F.radians(f64(dec)), math.radians(GALACTIC_POLE[1])
    c1 = math.sin(p) * F.cos(d) - math.cos(p) * F.sin(d) * F.cos(a)
    c2 = math.cos(p) * F.sin(a)
    cosb = F.sqrt(c1 * c1 + c2 * c2)
    return (c1 * f64(pm_ra) + c2 * f64(pm_dec)) / cosb, (c1 * f64(pm_dec) - c2 * f64(pm_ra)) / cosb


def axis_angle_matrix(axis: tuple[float, float, float], degrees: float) -> list[list[float]]:
    """Rotation matrix about a unit axis."""
    (x, y, z), s, c = axis, math.sin(math.radians(degrees)), math.cos(math.radians(degrees))
    k = 1 - c
    return [[c + x * x * k, x * y * k - z * s, x * z * k + y * s], [y * x * k + z * s, c + y * y * k, y * z * k - x * s], [z * x * k - y * s, z * y * k + x * s, c + z * z * k]]


def rotate_xyz(matrix: list[list[float]], x: C, y: C, z: C) -> tuple[Column, Column, Column]:
    return tuple(row[0] * f64(x) + row[1] * f64(y) + row[2] * f64(z) for row in matrix)


# --- map projections of the whole sky ---------------------------------------------------------------------------


def mercator_x(ra: C) -> Column:
    """0 to 1 over the circle."""
    return F.pmod(f64(ra), F.lit(360.0)) / 360.0


def mercator_y(dec: C) -> Column:
    return 0.5 + F.asinh(F.tan(F.radians(f64(dec)))) / (2.0 * math.pi)


def equal_area(x: C, y: C, z: C) -> tuple[Column, Column]:
    """Azimuthal equal-area coordinates of the hemisphere of positive z, in the unit square."""
    k = F.sqrt(1.0 / (1.0 + f64(z)))
    return 0.5 * (1.0 + f64(x) * k), 0.5 * (1.0 + f64(y) * k)


def hammer_aitoff(x: C, y: C, z: C) -> tuple[Column, Column]:
    """Hammer-Aitoff coordinates in the unit square: the longitude about the y axis is halved first."""
    half, r = F.atan2(f64(x), f64(z)) / 2.0, F.sqrt(f64(x) * f64(x) + f64(z) * f64(z))
    return equal_area(r * F.sin(half), f64(y), r * F.cos(half))
