"""Headers that are nearly right: shifts found by vote, and polynomial planes turned into distortion by pixels."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.functions.wcs import Wcs, with_inverse
from starloom.operators.checkpoints import spread
from starloom.operators.spatial import range_join


def voted_shifts(sources: DataFrame, refs: DataFrame, largest: float, bin_px: float) -> DataFrame:
    """(field_id, dx, dy, votes): by how much the sources of a field are off from where its header puts the stars.

    ``sources`` and ``refs`` have field_id, x and y. Every pair within ``largest`` pixels votes for its offset, in bins of
    ``bin_px`` on four grids that are moved by half a bin against each other, so that no peak is cut by an edge; the
    mean offset in the fullest bin is the shift. True pairs agree, chance pairs scatter over all bins. A field without
    any pair is left out; of equally full bins the first grid and the lowest bin win.
    """
    s = sources.select("field_id", F.col("x").alias("sx"), F.col("y").alias("sy"))
    r = refs.select(F.col("field_id").alias("_field"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    pairs = range_join(s, r, largest, ["sx", "sy"], ["rx", "ry"], by=("field_id", "_field")).select("field_id", (F.col("sx") - F.col("rx")).alias("dx"), (F.col("sy") - F.col("ry")).alias("dy"))
    half = bin_px / 2.0
    cells = [F.struct(F.lit(2 * i + j).alias("grid"), F.floor((F.col("dx") + i * half) / bin_px).alias("bx"), F.floor((F.col("dy") + j * half) / bin_px).alias("by")) for i in (0, 1) for j in (0, 1)]
    votes = pairs.select("field_id", "dx", "dy", F.explode(F.array(*cells)).alias("c")).groupBy("field_id", "c").agg(F.count("*").alias("votes"), F.avg("dx").alias("dx"), F.avg("dy").alias("dy"))
    best = votes.groupBy("field_id").agg(F.max(F.struct(F.col("votes"), (-F.col("c.grid")).alias("g"), (-F.col("c.bx")).alias("x"), (-F.col("c.by")).alias("y"), F.col("dx"), F.col("dy"))).alias("b"))
    return best.select("field_id", "b.dx", "b.dy", "b.votes")


# --- polynomials of the plane -----------------------------------------------------------------------------------


def plane_terms(n: int) -> list[tuple[int, int] | int]:
    """The first ``n`` terms of the convention in order: powers of the own and the other coordinate, or an odd power of the radius."""
    terms: list[tuple[int, int] | int] = []
    degree = 0
    while len(terms) < n:
        terms += [(degree - i, i) for i in range(degree + 1)]
        if degree % 2:
            terms.append(degree)
        degree += 1
    return terms[:n]


def plane_polynomial(u: np.ndarray, v: np.ndarray, first: Mapping[int, float], second: Mapping[int, float]) -> tuple[np.ndarray, np.ndarray]:
    """Distorted plane coordinates; coefficients by number, of which only number 1 is one if it is not given."""
    radius = np.hypot(u, v)

    def one(given: Mapping[int, float], own: np.ndarray, other: np.ndarray) -> np.ndarray:
        coefficients = {1: 1.0} | dict(given)
        out = np.zeros_like(own)
        for k, term in enumerate(plane_terms(max(coefficients) + 1)):
            if c := coefficients.get(k, 0.0):
                out = out + c * (radius**term if isinstance(term, int) else own ** term[0] * other ** term[1])
        return out

    return one(first, u, v), one(second, v, u)


def pixel_distortion(wcs: Wcs, first: Mapping[int, float], second: Mapping[int, float], order: int = 4, grid: int = 25) -> tuple[Wcs, float]:
    """The header with its plane polynomial as distortion by pixels and its inverse, and the largest error in pixels.

    Polynomials of the pixels are fitted on a grid over the image. Their linear part becomes the CD matrix, a constant
    the reference pixel's shift, and the rest, taken back through that matrix, the distortion.
    """
    xs, ys = (np.linspace(0.5, n + 0.5, grid) for n in (wcs.width, wcs.height))
    x, y = (g.ravel() for g in np.meshgrid(xs, ys))
    u, v = x - wcs.crpix[0], y - wcs.crpix[1]
    cd = np.array(wcs.cd)
    plane = np.stack(plane_polynomial(*(cd @ np.stack([u, v])), first, second), axis=1)
    size = max(np.abs(u).max(), np.abs(v).max())
    powers = [(p, t - p) for t in range(order + 1) for p in range(t, -1, -1)]
    design = np.stack([(u / size) ** p * (v / size) ** q for p, q in powers], axis=1)
    found = np.linalg.lstsq(design, plane, rcond=None)[0]
    at = {pq: c / size ** sum(pq) for pq, c in zip(powers, found, strict=True)}
    linear = np.stack([at[(1, 0)], at[(0, 1)]], axis=1)
    back = np.linalg.inv(linear)
    rest = {pq: back @ c for pq, c in at.items() if sum(pq) != 1}
    out = replace(wcs, cd=tuple(map(tuple, linear.tolist())), a={pq: float(c[0]) for pq, c in rest.items()}, b={pq: float(c[1]) for pq, c in rest.items()})
    error = np.hypot(*(back @ (plane - design @ found).T)).max()
    return with_inverse(out, order + 1, grid), float(error)


def _plane_polynomials(u: np.ndarray, v: np.ndarray, first: list[dict], second: list[dict]) -> np.ndarray:
    """``plane_polynomial`` of many headers, a row of points and two sets of coefficients each; (headers, points, 2)."""
    radius = np.hypot(u, v)
    out = np.zeros((*u.shape, 2))
    for side, (given, own, other) in enumerate(((first, u, v), (second, v, u))):
        given = [{1: 1.0} | g for g in given]
        for k, term in enumerate(plane_terms(max(max(g) for g in given) + 1)):
            c = np.array([g.get(k, 0.0) for g in given])
            some = np.flatnonzero(c)
            if len(some):
                value = radius[some] ** term if isinstance(term, int) else own[some] ** term[0] * other[some] ** term[1]
                out[some, :, side] += c[some, None] * value
    return out


#: headers that are fitted at once
AT_ONCE = 256


def _distortions(heads: pd.DataFrame, key: str, size_of: Wcs, order: int, grid: int = 25) -> pd.DataFrame:
    """``pixel_distortion`` without the inverse of headers that differ in CD and coefficients only: one factored grid for all."""
    xs, ys = (np.linspace(0.5, n + 0.5, grid) for n in (size_of.width, size_of.height))
    x, y = (g.ravel() for g in np.meshgrid(xs, ys))
    u, v = x - size_of.crpix[0], y - size_of.crpix[1]
    cd = heads[["cd00", "cd01", "cd10", "cd11"]].to_numpy().reshape(-1, 2, 2)
    at = cd @ np.stack([u, v])
    plane = _plane_polynomials(at[:, 0], at[:, 1], *([dict(m) if m is not None else {} for m in heads[c]] for c in ("first", "second")))
    size = max(np.abs(u).max(), np.abs(v).max())
    powers = [(p, t - p) for t in range(order + 1) for p in range(t, -1, -1)]
    design = np.stack([(u / size) ** p * (v / size) ** q for p, q in powers], axis=1)
    q, r = np.linalg.qr(design)
    found = np.linalg.solve(r, q.T @ plane)
    scaled = found / np.array([size ** sum(pq) for pq in powers])[:, None]
    linear = np.stack([scaled[:, powers.index((1, 0))], scaled[:, powers.index((0, 1))]], axis=2)
    back = np.linalg.inv(linear)
    rest = np.einsum("hij,hkj->hki", back, scaled)
    off = np.einsum("hij,hkj->hki", back, plane - design @ found)
    error = np.hypot(off[..., 0], off[..., 1]).max(axis=1)
    kept = sorted((pq, k) for k, pq in enumerate(powers) if sum(pq) != 1)
    listed = [[[{"p": p, "q": q_, "c": float(row[k, side])} for (p, q_), k in kept] for row in rest] for side in (0, 1)]
    return pd.DataFrame({key: heads[key].to_numpy(), "a": listed[0], "b": listed[1], "cd": linear.reshape(-1, 4).tolist(), "error": error})


def pixel_distortions(headers: DataFrame, key: str, order: int = 4) -> DataFrame:
    """(key, a, b, cd, error) from a table of headers: crpix0, crpix1, cd00 to cd11, width, height, and maps ``first`` and ``second`` of plane coefficients.

    a and b hold the distortion's coefficients with the powers p and q they belong to.
    """
    kind = headers.schema[key].dataType.simpleString()
    term = "array<struct<p:int,q:int,c:double>>"

    def run(batches):
        for pdf in batches:
            parts = []
            # headers of one image size share the grid and its fit
            for (x0, y0, width, height), own in pdf.groupby(["crpix0", "crpix1", "width", "height"], dropna=False):
                for k in range(0, len(own), AT_ONCE):
                    parts.append(_distortions(own.iloc[k : k + AT_ONCE], key, Wcs((0.0, 0.0), (x0, y0), ((1.0, 0.0), (0.0, 1.0)), width, height), order))
            yield pd.concat(parts) if parts else pd.DataFrame(columns=[key, "a", "b", "cd", "error"])

    names = ["crpix0", "crpix1", "cd00", "cd01", "cd10", "cd11", "width", "height"]
    return spread(headers.select(key, *[F.col(n).cast("double").alias(n) for n in names], "first", "second")).mapInPandas(run, f"{key} {kind}, a {term}, b {term}, cd array<double>, error double")
