"""Polygons as arrays of vertices."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from starloom.functions.base import C, col, f64


def point_in_polygon(x: C, y: C, xs: C, ys: C) -> Column:
    """Even-odd rule over vertex arrays."""
    xs, ys, px, py = col(xs), col(ys), f64(x), f64(y)
    ends = F.arrays_zip(xs.alias("x1"), ys.alias("y1"), _turned(xs).alias("x2"), _turned(ys).alias("y2"))

    def crossing(e: Column) -> Column:
        x1, y1, x2, y2 = (e[str(i)] for i in range(4))
        return F.when(((y1 > py) != (y2 > py)) & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1), 1).otherwise(0)

    names = F.transform(ends, lambda e: F.struct(e["x1"].alias("0"), e["y1"].alias("1"), e["x2"].alias("2"), e["y2"].alias("3")))
    return F.aggregate(names, F.lit(0), lambda s, e: s + crossing(e)) % 2 == 1


def _turned(a: Column) -> Column:
    """Each element's successor, the first after the last."""
    return F.concat(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, 1, 1))


def polygon_area(xs: C, ys: C) -> Column:
    """Signed area, positive counter-clockwise."""
    xs, ys = col(xs), col(ys)
    left = F.zip_with(xs, _turned(ys), lambda a, b: a * b)
    right = F.zip_with(_turned(xs), ys, lambda a, b: a * b)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    return (total(left) - total(right)) / 2.0


def np_clip(subject: np.ndarray, clipper: np.ndarray) -> np.ndarray:
    """Part of a polygon inside a convex counter-clockwise one, edge by edge."""
    out = [tuple(p) for p in subject]
    for a, b in zip(clipper, np.roll(clipper, -1, axis=0), strict=True):
        side = lambda p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])  # noqa: B023, E731
        points, out = out, []
        for p, q in zip(points, points[1:] + points[:1], strict=True):
            sp, sq = side(p), side(q)
            if sp >= 0:
                out.append(p)
            if (sp >= 0) != (sq >= 0):
                t = sp / (sp - sq)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        if not out:
            break
    return np.array(out).reshape(-1, 2)


def np_intersect(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two convex polygons share area: no edge of either separates them."""
    for poly in (a, b):
        for p, q in zip(poly, np.roll(poly, -1, axis=0), strict=True):
            n = np.array([q[1] - p[1], p[0] - q[0]])
            if (a @ n).max() <= (b @ n).min() or (b @ n).max() <= (a @ n).min():
                return False
    return True


def line_intersection(p: tuple[C, C], q: tuple[C, C], r: tuple[C, C], s: tuple[C, C]) -> tuple[Column, Column]:
    """Crossing of the lines through p, q and r, s; null where parallel."""
    (x1, y1), (x2, y2), (x3, y3), (x4, y4) = (tuple(map(f64, v)) for v in (p, q, r, s))
    det = (x1 - x2) * (y3 - y4) - (y1 - y2) * (x3 - x4)
    a, b = x1 * y2 - y1 * x2, x3 * y4 - y3 * x4
    return F.when(det != 0, (a * (x3 - x4) - (x1 - x2) * b) / det), F.when(det != 0, (a * (y3 - y4) - (y1 - y2) * b) / det)


def containing(points, polygons: list[tuple[str, np.ndarray]], curved: Callable[[str, np.ndarray], np.ndarray] | None = None):
    """(id, name): for every position (id, ra, dec) the sky polygons, rows of (ra, dec) vertices, that hold it.

    Polygons are projected about the position; those that reach the far hemisphere are skipped. Their list is a
    parameter of bounded size, not data. Where the sides of polygons stand for curves, ``curved`` tells for a polygon's
    name and unit vectors no farther from a vertex than the longest side whether the true outline holds them.
    """
    import pandas as pd

    from starloom.functions.healpix import np_radec_to_xyz

    if len(polygons) > 10_000:
        raise ValueError("more than 10,000 polygons: join by cells first")
    vertices = [(name, np_radec_to_xyz(p[:, 0], p[:, 1])) for name, p in polygons]
    sides = [float(np.linalg.norm(p - np.roll(p, -1, axis=0), axis=1).max()) for _, p in vertices]

    def run(batches):
        for pdf in batches:
            v = np_radec_to_xyz(pdf["ra"].to_numpy(), pdf["dec"].to_numpy())
            east = np.stack([-v[:, 1], v[:, 0], np.zeros(len(v))], axis=1)
            size = np.linalg.norm(east, axis=1)
            east = np.where(size[:, None] > 1e-12, east / np.maximum(size, 1e-12)[:, None], np.array([1.0, 0.0, 0.0]))
            north = np.cross(v, east)
            rows = []
            for (name, p), side in zip(vertices, sides, strict=True):
                along, x, y = v @ p.T, east @ p.T, north @ p.T
                near = (along > 0).all(axis=1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    x, y = x / along, y / along
                    x2, y2 = np.roll(x, -1, axis=1), np.roll(y, -1, axis=1)
                    cross = ((y > 0) != (y2 > 0)) & (0 < (x2 - x) * (0 - y) / (y2 - y) + x)
                hit = near & (cross.sum(axis=1) % 2 == 1)
                if curved is not None and (edge := along.max(axis=1, initial=-1.0) >= 1.0 - side * side / 2).any():
                    hit[edge] = curved(name, v[edge])
                rows += [(i, name) for i in pdf["id"].to_numpy()[hit]]
            yield pd.DataFrame(rows, columns=["id", "name"])

    return points.select("id", "ra", "dec").mapInPandas(run, "id long, name string")
