"""World coordinates: TAN and SIN planes, SIP and TPV distortion, as Column expressions on a fixed or per-row header."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from starloom.functions.base import C, f64
from starloom.functions.sphere import radec_to_xyz, xyz_to_dec, xyz_to_ra

Poly = dict[tuple[int, int], float]


def _poly(coefficients: Poly, u, v):
    """Sum of c[p, q] * u^p * v^q; works on Columns and on arrays."""
    total = 0.0
    for (p, q), c in sorted(coefficients.items()):
        if c:
            term = c
            for _ in range(p):
                term = term * u
            for _ in range(q):
                term = term * v
            total = total + term
    return total


@dataclass(frozen=True)
class Wcs:
    """A header; pixel centres are whole numbers from 1, offsets in degrees."""

    crval: tuple[float, float]
    crpix: tuple[float, float]
    cd: tuple[tuple[float, float], tuple[float, float]]
    width: float = 0.0
    height: float = 0.0
    sin: bool = False
    a: Poly = field(default_factory=dict)
    b: Poly = field(default_factory=dict)
    ap: Poly = field(default_factory=dict)
    bp: Poly = field(default_factory=dict)

    # --- Column expressions ---

    def radec_to_iwc(self, ra: C, dec: C) -> tuple[Column, Column]:
        """Intermediate world coordinates in degrees; null on the far hemisphere."""
        x, y, z = radec_to_xyz(ra, dec)
        r, e, n = self._basis()
        along = x * r[0] + y * r[1] + z * r[2]
        east, north = x * e[0] + y * e[1] + z * e[2], x * n[0] + y * n[1] + z * n[2]
        scale = 1.0 if self.sin else along
        return F.when(along > 0, F.degrees(east / scale)), F.when(along > 0, F.degrees(north / scale))

    def iwc_to_pixel(self, u: Column, v: Column) -> tuple[Column, Column]:
        (a, b), (c, d) = self._inverse()
        px, py = u * a + v * b, u * c + v * d
        if self.ap or self.bp:
            px, py = px + _poly(self.ap, px, py), py + _poly(self.bp, px, py)
        return px + self.crpix[0], py + self.crpix[1]

    def radec_to_pixel(self, ra: C, dec: C) -> tuple[Column, Column]:
        return self.iwc_to_pixel(*self.radec_to_iwc(ra, dec))

    def pixel_to_iwc(self, x: C, y: C) -> tuple[Column, Column]:
        u, v = f64(x) - self.crpix[0], f64(y) - self.crpix[1]
        if self.a or self.b:
            u, v = u + _poly(self.a, u, v), v + _poly(self.b, u, v)
        return u * self.cd[0][0] + v * self.cd[0][1], u * self.cd[1][0] + v * self.cd[1][1]

    def pixel_to_xyz(self, x: C, y: C) -> tuple[Column, Column, Column]:
        u, v = (F.radians(w) for w in self.pixel_to_iwc(x, y))
        r, e, n = self._basis()
        along = F.sqrt(F.greatest(F.lit(0.0), 1.0 - u * u - v * v)) if self.sin else F.lit(1.0)
        out = [u * e[i] + v * n[i] + along * r[i] for i in range(3)]
        size = F.sqrt(out[0] * out[0] + out[1] * out[1] + out[2] * out[2])
        return tuple(w / size for w in out)

    def pixel_to_radec(self, x: C, y: C) -> tuple[Column, Column]:
        p = self.pixel_to_xyz(x, y)
        return xyz_to_ra(p[0], p[1]), xyz_to_dec(*p)

    def contains(self, ra: C, dec: C) -> Column:
        """Whether a position falls on the image, pixel edges half a pixel out."""
        x, y = self.radec_to_pixel(ra, dec)
        return F.coalesce((x >= 0.5) & (x <= self.width + 0.5) & (y >= 0.5) & (y <= self.height + 0.5), F.lit(False))

    # --- arrays, for kernels ---

    def np_radec_to_pixel(self, ra, dec):
        a, d = np.radians(ra), np.radians(dec)
        s = np.stack([np.cos(d) * np.cos(a), np.cos(d) * np.sin(a), np.sin(d)], axis=-1)
        r, e, n = (np.array(w) for w in self._basis())
        along = s @ r
        with np.errstate(invalid="ignore", divide="ignore"):
            scale = 1.0 if self.sin else along
            u, v = np.degrees(s @ e / scale), np.degrees(s @ n / scale)
        (ia, ib), (ic, id_) = self._inverse()
        px, py = u * ia + v * ib, u * ic + v * id_
        if self.ap or self.bp:
            px, py = px + _poly(self.ap, px, py), py + _poly(self.bp, px, py)
        far = along <= 0
        return np.where(far, np.nan, px + self.crpix[0]), np.where(far, np.nan, py + self.crpix[1])

    def np_pixel_to_radec(self, x, y):
        u, v = np.asarray(x, float) - self.crpix[0], np.asarray(y, float) - self.crpix[1]
        if self.a or self.b:
            u, v = u + _poly(self.a, u, v), v + _poly(self.b, u, v)
        u, v = np.radians(u * self.cd[0][0] + v * self.cd[0][1]), np.radians(u * self.cd[1][0] + v * self.cd[1][1])
        r, e, n = (np.array(w) for w in self._basis())
        along = np.sqrt(np.maximum(0.0, 1 - u * u - v * v)) if self.sin else np.ones_like(u)
        p = u[..., None] * e + v[..., None] * n + along[..., None] * r
        return np.degrees(np.arctan2(p[..., 1], p[..., 0])) % 360.0, np.degrees(np.arctan2(p[..., 2], np.hypot(p[..., 0], p[..., 1])))

    # --- properties ---

    def _basis(self):
        """Direction of the tangent point, and the unit tangents to the east and the north there."""
        a, d = math.radians(self.crval[0]), math.radians(self.crval[1])
        r = (math.cos(d) * math.cos(a), math.cos(d) * math.sin(a), math.sin(d))
        return r, (-math.sin(a), math.cos(a), 0.0), (-math.sin(d) * math.cos(a), -math.sin(d) * math.sin(a), math.cos(d))

    def _inverse(self):
        (a, b), (c, d) = self.cd
        det = a * d - b * c
        return (d / det, -b / det), (-c / det, a / det)

    @property
    def det(self) -> float:
        return self.cd[0][0] * self.cd[1][1] - self.cd[0][1] * self.cd[1][0]

    @property
    def parity(self) -> int:
        """1 where the image is mirrored (positive determinant), else -1."""
        return 1 if self.det >= 0 else -1

    @property
    def pixel_scale(self) -> float:
        """Arcseconds a pixel."""
        return 3600.0 * math.sqrt(abs(self.det))

    @property
    def orientation(self) -> float:
        par = 1.0 if self.det >= 0 else -1.0
        t, a = par * self.cd[0][0] + self.cd[1][1], par * self.cd[1][0] - self.cd[0][1]
        return -math.degrees(math.atan2(a, t))

    @property
    def centre_pixel(self) -> tuple[float, float]:
        return 0.5 + self.width / 2.0, 0.5 + self.height / 2.0

    @property
    def centre(self) -> tuple[float, float]:
        ra, dec = self.np_pixel_to_radec(*(np.array([c]) for c in self.centre_pixel))
        return float(ra[0]), float(dec[0])

    @property
    def radius(self) -> float:
        """Half the diagonal in degrees, by the pixel scale."""
        return self.pixel_scale / 3600.0 * math.hypot(self.width, self.height) / 2.0

    def boundary(self, step: float = 50.0) -> tuple[np.ndarray, np.ndarray]:
        """RA and dec along the image edge."""
        w, h = self.width + 0.5, self.height + 0.5
        xs, ys = np.linspace(0.5, w, max(2, int(self.width / step) + 1)), np.linspace(0.5, h, max(2, int(self.height / step) + 1))
        x = np.concatenate([xs, np.full(len(ys), w), xs[::-1], np.full(len(ys), 0.5)])
        y = np.concatenate([np.full(len(xs), 0.5), ys, np.full(len(xs), h), ys[::-1]])
        return self.np_pixel_to_radec(x, y)

    def radec_bounds(self, step: float = 50.0) -> tuple[float, float, float, float]:
        """(ramin, ramax, decmin, decmax) of the edge; RA relative to the centre, so ramin may be negative."""
        ra, dec = self.boundary(step)
        c = self.centre[0]
        rel = (ra - c + 180.0) % 360.0 - 180.0
        return c + rel.min(), c + rel.max(), float(dec.min()), float(dec.max())

    def overlaps(self, other: Wcs, step: float = 50.0) -> bool:
        """Whether two footprints share a point: an edge point of one lies in the other, or one holds the other's centre."""
        for p, q in ((self, other), (other, self)):
            ra, dec = p.boundary(step)
            x, y = q.np_radec_to_pixel(np.append(ra, p.centre[0]), np.append(dec, p.centre[1]))
            with np.errstate(invalid="ignore"):
                if ((x >= 0.5) & (x <= q.width + 0.5) & (y >= 0.5) & (y <= q.height + 0.5)).any():
                    return True
        return False

    def shifted(self, dx: float, dy: float) -> Wcs:
        return replace(self, crpix=(self.crpix[0] + dx, self.crpix[1] + dy))

    def sub_image(self, x0: float, y0: float, width: float, height: float) -> Wcs:
        return replace(self, crpix=(self.crpix[0] - x0, self.crpix[1] - y0), width=width, height=height)

    def scaled(self, factor: float) -> Wcs:
        """For an image that has ``factor`` times as many pixels along each side."""
        cd = tuple(tuple(c / factor for c in row) for row in self.cd)
        return replace(self, cd=cd, crpix=tuple((p - 0.5) * factor + 0.5 for p in self.crpix), width=self.width * factor, height=self.height * factor)

    def rotated(self, degrees: float) -> Wcs:
        s, c = math.sin(math.radians(degrees)), math.cos(math.radians(degrees))
        (a, b), (d, e) = self.cd
        return replace(self, cd=((a * c + b * s, -a * s + b * c), (d * c + e * s, -d * s + e * c)))


def box(ra: float, dec: float, width_deg: float, pixels: int) -> Wcs:
    """A square, north up and east to the left."""
    s = width_deg / pixels
    return Wcs((ra, dec), (0.5 + pixels / 2.0, 0.5 + pixels / 2.0), ((-s, 0.0), (0.0, s)), pixels, pixels)


def np_boxes_overlap(p: tuple[np.ndarray, np.ndarray], q: tuple[np.ndarray, np.ndarray], width_deg: float, pixels: int, step: float = 50.0) -> np.ndarray:
    """``overlaps`` of the squares ``box(ra, dec, width_deg, pixels)`` about positions p and q, pair by pair."""
    scale, edge = math.radians(width_deg / pixels), pixels / 2.0
    line = np.linspace(-edge, edge, max(2, int(pixels / step) + 1))
    near, far = np.full(len(line), -edge), np.full(len(line), edge)
    # east and north of the outline and of the centre, which is the origin of its plane
    u = -scale * np.concatenate([line, far, line[::-1], near, [0.0]])
    w = scale * np.concatenate([near, line, far, line[::-1], [0.0]])

    def basis(ra, dec):
        a, d = np.radians(ra), np.radians(dec)
        up = np.stack([np.cos(d) * np.cos(a), np.cos(d) * np.sin(a), np.sin(d)], axis=1)
        return up, np.stack([-np.sin(a), np.cos(a), 0.0 * a], axis=1), np.stack([-np.sin(d) * np.cos(a), -np.sin(d) * np.sin(a), np.cos(d)], axis=1)

    out, bases = np.zeros(len(p[0]), bool), (basis(*p), basis(*q))
    reach = scale * edge
    # most pairs that overlap hold each other's centre, so the outlines are for what that leaves open
    for points in (slice(-1, None), slice(None, -1)):
        for own, other in ((0, 1), (1, 0)):
            left = np.flatnonzero(~out)
            up, east, north = (b[left] for b in bases[own])
            on = (b[left] for b in bases[other])
            along, x, y = (np.einsum("ni,ni->n", o, up)[:, None] + u[points] * np.einsum("ni,ni->n", o, east)[:, None] + w[points] * np.einsum("ni,ni->n", o, north)[:, None] for o in on)
            out[left] = ((along > 0) & (np.abs(x) <= along * reach) & (np.abs(y) <= along * reach)).any(axis=1)
    return out


def tpv_distort(u, v, pv1: list[float], pv2: list[float]):
    """TPV polynomial of intermediate coordinates; r = hypot(u, v); terms in the order of the convention."""
    r = (u * u + v * v) ** 0.5

    def one(pv, x, y):
        terms = [1.0, x, y, r, x * x, x * y, y * y, x * x * x, x * x * y, x * y * y, y * y * y, r * r * r]
        return sum((c * t for c, t in zip(pv, terms, strict=False) if c), 0.0 * x)

    return one(pv1, u, v), one(pv2, v, u)


def fit_tan(x: np.ndarray, y: np.ndarray, ra: np.ndarray, dec: np.ndarray, weights: np.ndarray | None = None, crpix: tuple[float, float] | None = None) -> Wcs:
    """Similarity fit (rotation, scale, parity, shift) of a tangent plane to correspondences.

    The field is projected about the weighted centre of the star directions; the rotation comes from the singular
    vectors of the weighted 2 x 2 covariance of field and plane coordinates, the scale from their spreads.
    """
    w = np.ones(len(x)) if weights is None else np.asarray(weights, float)
    a, d = np.radians(ra), np.radians(dec)
    s = np.stack([np.cos(d) * np.cos(a), np.cos(d) * np.sin(a), np.sin(d)], axis=1)
    c = (s * w[:, None]).sum(axis=0)
    ra0, dec0 = math.degrees(math.atan2(c[1], c[0])) % 360.0, math.degrees(math.atan2(c[2], math.hypot(c[0], c[1])))
    r, e, n = (np.array(v) for v in Wcs((ra0, dec0), (0, 0), ((1, 0), (0, 1)))._basis())
    plane = np.degrees(np.stack([s @ e, s @ n], axis=1) / (s @ r)[:, None])
    pix = np.stack([x, y], axis=1)
    mean = lambda v: (v * w[:, None]).sum(axis=0) / w.sum()
    p0, q0 = mean(pix), mean(plane)
    cov = ((plane - q0) * w[:, None]).T @ (pix - p0)
    left, _, right = np.linalg.svd(cov)
    rot = left @ right
    scale = math.sqrt((w * ((plane - q0) ** 2).sum(axis=1)).sum() / (w * ((pix - p0) ** 2).sum(axis=1)).sum())
    cd = rot * scale
    at = p0 - np.linalg.solve(cd, q0) if crpix is None else np.array(crpix)
    fitted = Wcs((ra0, dec0), (float(at[0]), float(at[1])), tuple(map(tuple, cd.tolist())))
    if crpix is not None:  # move the tangent point to where the asked pixel falls
        base = replace(fitted, crpix=tuple((p0 - np.linalg.solve(cd, q0)).tolist()))
        ra1, dec1 = base.np_pixel_to_radec(np.array([crpix[0]]), np.array([crpix[1]]))
        fitted = replace(fitted, crval=(float(ra1[0]), float(dec1[0])))
    return fitted


def fit_sip(x, y, ra, dec, start: Wcs, order: int = 2, inverse_order: int | None = None, weights: np.ndarray | None = None, grid: int = 20) -> Wcs:
    """Linear least squares of the tangent plane's CD matrix, shift and SIP terms about ``start``'s reference pixel."""
    a, d = np.radians(ra), np.radians(dec)
    s = np.stack([np.cos(d) * np.cos(a), np.cos(d) * np.sin(a), np.sin(d)], axis=1)
    r, e, n = (np.array(v) for v in start._basis())
    plane = np.degrees(np.stack([s @ e, s @ n], axis=1) / (s @ r)[:, None])
    u, v = np.asarray(x, float) - start.crpix[0], np.asarray(y, float) - start.crpix[1]
    powers = [(p, q) for t in range(order + 1) for p in range(t, -1, -1) for q in [t - p]]
    w = np.sqrt(np.ones(len(u)) if weights is None else np.asarray(weights, float))
    design = np.stack([u**p * v**q for p, q in powers], axis=1)
    solved, *_ = np.linalg.lstsq(design * w[:, None], plane * w[:, None], rcond=None)
    at = {pq: solved[i] for i, pq in enumerate(powers)}
    cd = np.stack([at[(1, 0)], at[(0, 1)]], axis=1)
    inv = np.linalg.inv(cd)
    shift = inv @ at[(0, 0)]
    terms = {pq: inv @ c for pq, c in at.items() if sum(pq) >= 2}
    moved = replace(start, cd=tuple(map(tuple, cd.tolist())), a={k: float(c[0]) for k, c in terms.items()} | {(0, 0): float(shift[0])}, b={k: float(c[1]) for k, c in terms.items()} | {(0, 0): float(shift[1])})
    return with_inverse(moved, inverse_order or order + 1, grid)


def with_inverse(wcs: Wcs, order: int, grid: int = 20) -> Wcs:
    """``wcs`` with AP and BP fitted to undo A and B on a grid over the image."""
    gx, gy = np.meshgrid(np.linspace(1, max(2.0, wcs.width), grid), np.linspace(1, max(2.0, wcs.height), grid))
    u, v = gx.ravel() - wcs.crpix[0], gy.ravel() - wcs.crpix[1]
    du, dv = u + _poly(wcs.a, u, v), v + _poly(wcs.b, u, v)
    powers = [(p, q) for p in range(order + 1) for q in range(order + 1 - p)]
    scale = max(1.0, np.abs(du).max(), np.abs(dv).max())
    design = np.stack([(du / scale) ** p * (dv / scale) ** q for p, q in powers], axis=1)
    cu, cv = (np.linalg.lstsq(design, t, rcond=None)[0] for t in (u - du, v - dv))
    return replace(wcs, ap={k: float(c) / scale ** sum(k) for k, c in zip(powers, cu, strict=True)}, bp={k: float(c) / scale ** sum(k) for k, c in zip(powers, cv, strict=True)})
