"""Dates, magnitudes, orbits, scale units and other scalar conversions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from starloom.functions.base import C, col, f64

# --- dates ------------------------------------------------------------------------------------------------------

JD_OF_MJD = 2400000.5
UNIX_EPOCH_JD = 2440587.5
DAYS_PER_YEAR = 365.25
# fixed values: metres in an astronomical unit, speed of light in m/s
METRES_PER_AU = 1.4959e11
LIGHT = 2.99792458e8


def mjd_to_jd(mjd: C) -> Column:
    return f64(mjd) + JD_OF_MJD


def jd_to_mjd(jd: C) -> Column:
    return f64(jd) - JD_OF_MJD


def timestamp_to_jd(ts: C) -> Column:
    return F.unix_micros(col(ts).cast("timestamp")) / 86400e6 + UNIX_EPOCH_JD


def timestamp_to_mjd(ts: C) -> Column:
    return F.unix_micros(col(ts).cast("timestamp")) / 86400e6 + (UNIX_EPOCH_JD - JD_OF_MJD)


def jd_to_timestamp(jd: C) -> Column:
    return F.timestamp_micros(F.round((f64(jd) - UNIX_EPOCH_JD) * 86400e6).cast("long"))


def mjd_to_timestamp(mjd: C) -> Column:
    return F.timestamp_micros(F.round((f64(mjd) - (UNIX_EPOCH_JD - JD_OF_MJD)) * 86400e6).cast("long"))


def days_to_years(days: C) -> Column:
    return f64(days) / DAYS_PER_YEAR


def au_light_travel_days(au: C) -> Column:
    return f64(au) * METRES_PER_AU / LIGHT / 86400.0


# --- photometry -------------------------------------------------------------------------------------------------

BAD_MAG = 25.0
# fixed values: softening parameters of asinh magnitudes in u, g, r, i, z
SOFTENING = {"u": 1.4e-10, "g": 0.9e-10, "r": 1.2e-10, "i": 1.8e-10, "z": 7.4e-10}


def mag_to_flux(mag: C) -> Column:
    return F.pow(F.lit(10.0), f64(mag) * -0.4)


def flux_to_mag(flux: C) -> Column:
    """The inverse of ``mag_to_flux``; null for fluxes that are not positive."""
    return F.when(f64(flux) > 0, -2.5 * F.log10(f64(flux)))


def luptitude_to_mag(lup: C, band: str, bad: float = BAD_MAG) -> Column:
    """Asinh magnitude to magnitude; ``bad`` where the flux is not positive."""
    b = SOFTENING[band]
    flux = 2.0 * b * F.sinh(f64(lup) * (-math.log(10.0) / 2.5) - math.log(b))
    return F.when(flux > 0, -2.5 * F.log10(flux)).otherwise(F.lit(bad))


def luptitude_to_counts(lup: C, band: str, exposure: float = 53.907456, zero_point: float = 0.0) -> Column:
    b = SOFTENING[band]
    return exposure * 10.0 ** (-0.4 * zero_point) * 2.0 * b * F.sinh(f64(lup) * (-math.log(10.0) / 2.5) - math.log(b))


def mag_to_counts(mag: C, exposure: float = 53.907456, zero_point: float = 0.0) -> Column:
    return exposure * F.pow(F.lit(10.0), -0.4 * (f64(mag) + zero_point))


def counts_to_mag(counts: C, exposure: float = 53.907456, zero_point: float = 0.0, bad: float = BAD_MAG) -> Column:
    return F.when(f64(counts) > 0, -2.5 * F.log10(f64(counts) / exposure) - zero_point).otherwise(F.lit(bad))


def nanomaggies_to_mag(nmgy: C, bad: float = BAD_MAG) -> Column:
    return F.when(f64(nmgy) > 0, 22.5 - 2.5 * F.log10(f64(nmgy))).otherwise(F.lit(bad))


def average_mag(mag1: C, seen1: C, mag2: C, seen2: C) -> Column:
    """Mean of the magnitudes of the epochs that were seen; 0 when none was."""
    a, b = col(seen1), col(seen2)
    return F.when(a & b, (f64(mag1) + f64(mag2)) / 2.0).when(a, f64(mag1)).when(b, f64(mag2)).otherwise(F.lit(0.0))


# --- scale units ------------------------------------------------------------------------------------------------


def arcsec_per_pixel(value: C, unit: C, width: C) -> Column:
    """Pixel scale of a bound given in degwidth, arcminwidth, arcsecperpix or focalmm (35 mm equivalent)."""
    v, w = f64(value), f64(width)
    return (
        F.when(col(unit) == "degwidth", v * 3600.0 / w)
        .when(col(unit) == "arcminwidth", v * 60.0 / w)
        .when(col(unit).isin("arcsecperpix", "app"), v)
        .when(col(unit) == "focalmm", F.degrees(F.atan(36.0 / (2.0 * v))) * 3600.0 / w)
    )


# --- orbits -----------------------------------------------------------------------------------------------------


def eccentric_anomaly(mean: np.ndarray, e: np.ndarray, tolerance: float = 1e-15, rounds: int = 100) -> np.ndarray:
    """Newton's method on Kepler's equation, all rows at once."""
    mean, e = np.asarray(mean, float), np.asarray(e, float)
    big = mean + e * np.sin(mean)
    for _ in range(rounds):
        step = (mean + e * np.sin(big) - big) / (1.0 - e * np.cos(big))
        big = big + step
        if np.all(np.abs(step) < tolerance * np.maximum(1.0, np.abs(big))):
            break
    return big


def true_anomaly(big: np.ndarray, e: np.ndarray) -> np.ndarray:
    return np.arctan2(np.sqrt(1 - e * e) * np.sin(big), np.cos(big) - e)


def kepler(mean: C, e: C) -> Column:
    """Eccentric anomaly of a mean anomaly in radians."""

    def run(mean: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series(eccentric_anomaly(mean.to_numpy(), e.to_numpy()))

    return F.pandas_udf(run, "double")(f64(mean), f64(e))


GM_SUN = 2.9591310798672560e-04  # fixed value: AU^3 / day^2


def orbit_position(a, e, inc, node, peri, mean):
    """Heliocentric position from elements (AU, radians), rows at once: (n, 3)."""
    big = eccentric_anomaly(mean, e)
    px, py = a * (np.cos(big) - e), a * np.sqrt(1 - e * e) * np.sin(big)
    cw, sw, cn, sn, ci, si = np.cos(peri), np.sin(peri), np.cos(node), np.sin(node), np.cos(inc), np.sin(inc)
    x = px * (cw * cn - sw * ci * sn) - py * (sw * cn + cw * ci * sn)
    y = px * (cw * sn + sw * ci * cn) + py * (cw * ci * cn - sw * sn)
    return np.stack([x, y, px * sw * si + py * cw * si], axis=-1)


def elements_from_state(pos: np.ndarray, vel: np.ndarray, gm: float = GM_SUN) -> tuple[float, ...]:
    """(a, e, inc, node, peri, mean anomaly) of one position and velocity."""
    h, r = np.cross(pos, vel), np.linalg.norm(pos)
    energy = vel @ vel / 2 - gm / r
    a = -gm / (2 * energy)
    ev = np.cross(vel, h) / gm - pos / r
    e, inc = float(np.linalg.norm(ev)), float(np.arctan2(np.hypot(h[0], h[1]), h[2]))
    node = float(np.arctan2(h[0], -h[1])) if np.hypot(h[0], h[1]) > 0 else 0.0
    n = np.array([np.cos(node), np.sin(node), 0.0])
    m = np.cross(h / np.linalg.norm(h), n)
    peri = float(np.arctan2(ev @ m, ev @ n)) if e > 0 else 0.0
    nu = float(np.arctan2(pos @ m, pos @ n)) - peri
    big = 2 * np.arctan2(np.sqrt(1 - e) * np.sin(nu / 2), np.sqrt(1 + e) * np.cos(nu / 2))
    return float(a), e, inc, node % (2 * np.pi), peri % (2 * np.pi), float((big - e * np.sin(big)) % (2 * np.pi))


def elements_to_radec(a, e, inc, node, peri, mean, period_days, observer=(0.0, 0.0, 0.0), epoch_obliquity: float = 23.439281, rounds: int = 10):
    """Apparent (ra, dec) in degrees with light-time iteration, rows at once."""
    delay = np.zeros_like(np.asarray(a, float))
    eps = np.radians(epoch_obliquity)
    for _ in range(rounds):
        p = orbit_position(a, e, inc, node, peri, mean - 2 * np.pi * delay / period_days) - np.asarray(observer)
        new = np.linalg.norm(p, axis=-1) * METRES_PER_AU / LIGHT / 86400.0
        if np.allclose(new, delay, atol=1e-12, rtol=0):
            break
        delay = new
    x, y, z = p[..., 0], p[..., 1] * np.cos(eps) - p[..., 2] * np.sin(eps), p[..., 1] * np.sin(eps) + p[..., 2] * np.cos(eps)
    return np.degrees(np.arctan2(y, x)) % 360.0, np.degrees(np.arctan2(z, np.hypot(x, y)))


def orbit_radec(a: C, e: C, inc: C, node: C, peri: C, mean: C) -> Column:
    """Apparent position (ra, dec) seen from the sun's centre."""

    def run(a: pd.Series, e: pd.Series, inc: pd.Series, node: pd.Series, peri: pd.Series, mean: pd.Series) -> pd.DataFrame:
        args = [s.to_numpy(float) for s in (a, e, inc, node, peri, mean)]
        ra, dec = elements_to_radec(*args, 2 * np.pi * np.sqrt(args[0] ** 3 / GM_SUN))
        return pd.DataFrame({"ra": ra, "dec": dec})

    return F.pandas_udf(run, "ra double, dec double")(*map(f64, (a, e, inc, node, peri, mean)))


def radial_velocity(phase: np.ndarray, amplitude: float, e: float, peri: float, order: int = 0) -> np.ndarray:
    nu = true_anomaly(eccentric_anomaly(phase, np.full_like(phase, e)), e)
    return amplitude * (np.cos(nu + peri) + e * np.cos(peri))


def fourier_amplitudes(phase: np.ndarray, v: np.ndarray, k: int = 2) -> np.ndarray:
    """Amplitudes of the first ``k`` harmonics of a periodic signal sampled evenly in phase."""
    return np.array([2 * np.abs(np.mean(v * np.exp(-1j * n * phase))) for n in range(1, k + 1)])


# --- names and strings ------------------------------------------------------------------------------------------


def iau_name(ra: C, dec: C, prefix: str = "SDSS J") -> Column:
    """``JHHMMSS.ss+DDMMSS.s`` with truncated, not rounded, fractions."""
    h = F.floor(F.pmod(f64(ra), F.lit(360.0)) / 15.0 * 360000.0 + 1e-6).cast("long")
    d = F.floor(F.abs(f64(dec)) * 36000.0 + 1e-6).cast("long")
    pad = lambda v, n: F.lpad(v.cast("string"), n, "0")
    left = F.concat(pad(F.floor(h / 360000), 2), pad(F.floor(h / 6000) % 60, 2), pad(F.floor(h / 100) % 60, 2), F.lit("."), pad(h % 100, 2))
    right = F.concat(pad(F.floor(d / 36000), 2), pad(F.floor(d / 600) % 60, 2), pad(F.floor(d / 10) % 60, 2), F.lit("."), (d % 10).cast("string"))
    return F.concat(F.lit(prefix), left, F.when(f64(dec) < 0, F.lit("-")).otherwise(F.lit("+")), right)


def parse_ranges(text: C) -> Column:
    """``"3,5-8"`` as an array of whole numbers; parts that are no number or range are left out."""
    parts = F.filter(F.transform(F.split(col(text), ","), lambda p: F.trim(p)), lambda p: p.rlike(r"^\d+(-\d+)?$"))

    def expand(p: Column) -> Column:
        low, high = F.regexp_extract(p, r"^(\d+)", 1).cast("long"), F.regexp_extract(p, r"(\d+)$", 1).cast("long")
        return F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))

    return F.flatten(F.transform(parts, expand))


def shell_escape(text: C) -> Column:
    return F.concat(F.lit("'"), F.replace(col(text), F.lit("'"), F.lit("'\\''")), F.lit("'"))


def split_long(text: C, width: int) -> Column:
    """Lines of at most ``width`` characters, broken at spaces; words are not cut."""
    words = F.split(col(text), " ")
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"))

    def add(state: Column, word: Column) -> Column:
        joined = F.when(state["line"] == "", word).otherwise(F.concat(state["line"], F.lit(" "), word))
        fits = (state["line"] == "") | (F.length(joined) <= width)
        lines = F.when(fits, state["lines"]).otherwise(F.concat(state["lines"], F.array(state["line"])))
        return F.struct(lines.alias("lines"), F.when(fits, joined).otherwise(word).alias("line"))

    return F.aggregate(words, start, add, lambda s: F.concat(s["lines"], F.array(s["line"])))


# --- linear algebra on arrays -----------------------------------------------------------------------------------


def dot(a: C, b: C) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: C) -> Column:
    return F.sqrt(dot(a, a))


def distsq(a: C, b: C) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def invert_2by2(a: C, b: C, c: C, d: C) -> tuple[Column, Column, Column, Column]:
    det = f64(a) * f64(d) - f64(b) * f64(c)
    ok = lambda v: F.when(det != 0, v / det)
    return ok(f64(d)), ok(-f64(b)), ok(-f64(c)), ok(f64(a))


def invert_3by3(m: list[list[C]]) -> list[list[Column]]:
    """Inverse by cofactors; null where singular."""
    e = [[f64(v) for v in row] for row in m]
    cof = lambda i, j: e[(i + 1) % 3][(j + 1) % 3] * e[(i + 2) % 3][(j + 2) % 3] - e[(i + 1) % 3][(j + 2) % 3] * e[(i + 2) % 3][(j + 1) % 3]
    det = sum((e[0][j] * cof(0, j) for j in range(3)), F.lit(0.0))
    return [[F.when(det != 0, cof(j, i) / det) for j in range(3)] for i in range(3)]
