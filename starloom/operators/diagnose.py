"""Why a field is not solved: every index quad on it with the first stage of a solution at which it falls out.

The stages are those of a blind solution, but the true header is known, so none of them filters: each adds its finding
by a left join, and the reason is read off at the end. A quad that passes all stages would have solved the field.

``outside``: a star of the quad is not on the field; ``no_source``: a star has no source near its pixel;
``shared_source``: two stars have the same nearest source; ``scale``: AB is too short or too long in pixels;
``depth``: a source is fainter than the search goes; ``code``: the code of the sources differs from the quad's by more
than the tolerance; ``pruned``: the search leaves the quad out, as its code breaks the invariants or an inner source
lies outside the circle; ``verify``: the plane through the four pairs is not confirmed by the other sources;
``solves``: none of these.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions.base import C, f64, let
from starloom.functions.sphere import radec_to_xyz
from starloom.functions.wcs import fit_tan
from starloom.operators.checkpoints import reliable, spread
from starloom.operators.spatial import range_join, sky_join
from starloom.operators.verify import WCS_FIELDS, Rules, decide

HEADER = [f.split()[0] for f in WCS_FIELDS.split(", ")]
REASONS = ("outside", "no_source", "shared_source", "scale", "depth", "code", "pruned", "verify", "solves")


def header_pixels(ra: C, dec: C) -> tuple[Column, Column]:
    """Pixels of a position on the tangent plane of the row's own header columns; null on the far hemisphere."""
    a, d = F.radians("crval0"), F.radians("crval1")
    x, y, z = radec_to_xyz(ra, dec)
    along = x * F.cos(d) * F.cos(a) + y * F.cos(d) * F.sin(a) + z * F.sin(d)
    u = F.degrees((y * F.cos(a) - x * F.sin(a)) / along)
    v = F.degrees((z * F.cos(d) - F.sin(d) * (x * F.cos(a) + y * F.sin(a))) / along)
    det = F.col("cd00") * F.col("cd11") - F.col("cd01") * F.col("cd10")
    px = (F.col("cd11") * u - F.col("cd01") * v) / det + F.col("crpix0")
    py = (F.col("cd00") * v - F.col("cd10") * u) / det + F.col("crpix1")
    return F.when(along > 0, px), F.when(along > 0, py)


def stars_on_fields(stars: DataFrame, headers: DataFrame, width: float, height: float, largest_scale: float, by: str | None = None) -> DataFrame:
    """(field_id, star, ra, dec, x, y) of the stars on each field, from (field_id, header columns); checkpointed.

    Stars meet fields by the distance from the field's centre, with ``largest_scale`` in arcsec a pixel as its bound;
    ``by`` is a column of both sides that has to be equal as well.
    """
    radius = largest_scale / 3600 * np.hypot(width, height) * 0.525
    # the corner that is farthest from the reference pixel bounds the field whatever that pixel is
    more = F.greatest(*[F.hypot(F.col("crpix0") - x, F.col("crpix1") - y) for x in (0.5, width + 0.5) for y in (0.5, height + 0.5)])
    reach = headers.agg(F.max(more)).first()[0] or 0.0
    radius = max(radius, largest_scale / 3600 * reach * 1.05)
    centres = headers.withColumn("ra", F.col("crval0")).withColumn("dec", F.col("crval1"))
    pairs = sky_join(stars, centres, min(radius, 89.0), by=by)
    own = pairs.select(F.col("l_id").alias("star"), F.col("l_ra").alias("ra"), F.col("l_dec").alias("dec"), F.col("r_field_id").alias("field_id"), *[F.col(f"r_{h}").alias(h) for h in HEADER])
    x, y = header_pixels("ra", "dec")
    placed = own.select("field_id", "star", "ra", "dec", x.alias("x"), y.alias("y"))
    return reliable(placed.where(F.col("x").between(0.5, width + 0.5) & F.col("y").between(0.5, height + 0.5)))


def _code(p: Column, first: str, second: str) -> Column:
    """Code of four points of a plane from a struct of their coordinates ``first``0 to 3 and ``second``0 to 3."""
    x, y = ([p[f"{c}{i}"] for i in range(4)] for c in (first, second))
    fx, fy = x[1] - x[0], y[1] - y[0]
    size = fx * fx + fy * fy
    turn = F.struct(((fy + fx) / size).alias("cos"), ((fy - fx) / size).alias("sin"))
    return let(turn, lambda t: F.array(*[c for i in (2, 3) for dx, dy in ((x[i] - x[0], y[i] - y[0]),) for c in (dx * t["cos"] + dy * t["sin"], dy * t["cos"] - dx * t["sin"])]))


def _best_code(code: Column, xy: Column) -> Column:
    """(own, code_err, flipped): the code of the points, as they are or mirrored, whichever is nearer to ``code``."""
    gap = lambda c: F.sqrt(sum(((c[i] - code[i]) * (c[i] - code[i]) for i in range(4)), F.lit(0.0)))

    def chosen(c: Column) -> Column:
        return let(F.struct(gap(c["plain"]).alias("p"), gap(c["swapped"]).alias("s")), lambda g: F.struct(F.when(g["s"] < g["p"], c["swapped"]).otherwise(c["plain"]).alias("own"), F.least(g["p"], g["s"]).alias("code_err"), (g["s"] < g["p"]).alias("flipped")))

    return let(F.struct(_code(xy, "sx", "sy").alias("plain"), _code(xy, "sy", "sx").alias("swapped")), chosen)


def geometric_stages(
    on_field: DataFrame, sources: DataFrame, quads: DataFrame, radius_px: float, ab_px: tuple[float, float], depth: int, tolerance: float = 0.01
) -> DataFrame:
    """(field_id, quad_id, n_inside, n_found, n_sources, faintest, ab_px, code_err, flipped, ranks, reason) of every quad with a star on the field.

    ``on_field`` has field_id, star, x, y; ``sources`` field_id, rank, x, y; ``quads`` quad_id, stars, code. The nearest
    source within ``radius_px`` stands for a star, the brighter one in a tie. ``reason`` is null for quads that pass.
    """
    src = sources.select("field_id", F.col("rank").alias("rank"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    ref = on_field.select(F.col("field_id").alias("_field"), "star", F.col("x").alias("tx"), F.col("y").alias("ty"))
    near = range_join(ref, src, radius_px, ["tx", "ty"], ["sx", "sy"], by=("_field", "field_id"))
    nearest = near.groupBy("field_id", "star").agg(F.min(F.struct("dist", "rank", "sx", "sy")).alias("s"))
    corners = quads.select("quad_id", "code", F.posexplode("stars").alias("k", "star"))
    here = on_field.select("field_id", "star").join(nearest, ["field_id", "star"], "left").join(corners, "star")
    at = lambda c, i: F.max(F.when(F.col("k") == i, F.col(f"s.{c}"))).alias(f"{c}{i}")
    per_quad = here.groupBy("field_id", "quad_id", "code").agg(
        F.count("*").alias("n_inside"), F.count("s").alias("n_found"), F.count_distinct("s.rank").alias("n_sources"), F.max("s.rank").alias("faintest"), *[at(c, i) for i in range(4) for c in ("sx", "sy", "rank")]
    )
    whole = F.col("n_sources") == 4
    xy = F.struct(*[F.col(f"{c}{i}") for i in range(4) for c in ("sx", "sy")])
    got = per_quad.withColumn("ab_px", F.when(whole, F.hypot(F.col("sx1") - F.col("sx0"), F.col("sy1") - F.col("sy0")))).withColumn("best", F.when(whole, _best_code(F.col("code"), xy)))
    margin = 1.5 * tolerance
    circle = lambda c, i: c[i] * c[i] - c[i] + c[i + 1] * c[i + 1] - c[i + 1] > 0.02
    broken = let(F.col("best.own"), lambda c: (c[0] + c[2] > 1.0 + 2 * margin) | (c[0] > c[2] + margin) | circle(c, 0) | circle(c, 2))
    reason = (
        F.when(F.col("n_inside") < 4, "outside").when(F.col("n_found") < 4, "no_source").when(F.col("n_sources") < 4, "shared_source").when(~F.col("ab_px").between(*ab_px), "scale")
        .when(F.col("faintest") >= depth, "depth").when(F.col("best.code_err") > tolerance, "code").when(broken, "pruned")
    )
    ranks = F.array(*[F.col(f"rank{i}") for i in range(4)])
    return got.select("field_id", "quad_id", "n_inside", "n_found", "n_sources", "faintest", "ab_px", F.col("best.code_err").alias("code_err"), F.col("best.flipped").alias("flipped"), ranks.alias("ranks"), reason.alias("reason"))


def why_not(
    headers: DataFrame, sources: DataFrame, stars: DataFrame, quads: DataFrame, width: float, height: float, scale: tuple[float, float], quad_deg: tuple[float, float],
    depth: int = 25, tolerance: float = 0.01, nsigma: float = 3.0, rules: Rules | None = None, by: str | None = None,
) -> DataFrame:
    """``geometric_stages`` with the verification of the quads that pass them: adds scale and logodds, and no reason is null.

    ``headers`` are the true ones (field_id and header columns), ``scale`` the bounds of the search in arcsec a pixel.
    The kernel gets the quads that are left of one field, its sources and the stars on it.
    """
    rules = rules or Rules()
    on_field = stars_on_fields(stars, headers, width, height, scale[1], by)
    ab = (quad_deg[0] * 3600 / scale[1] * 0.9, quad_deg[1] * 3600 / scale[0] * 1.1)
    found = reliable(geometric_stages(on_field, sources, quads, nsigma * rules.pix_err, ab, depth, tolerance))
    kind = sources.schema["field_id"].dataType.simpleString()
    pairs = found.where("reason IS NULL").select("field_id", "quad_id", F.posexplode("ranks").alias("k", "rank")).join(quads.select("quad_id", F.posexplode("stars").alias("k", "star")), ["quad_id", "k"])
    pairs = pairs.join(on_field.select("field_id", "star", "ra", "dec"), ["field_id", "star"]).select("field_id", "quad_id", "k", "rank", "ra", "dec")
    world = sources.select("field_id", F.lit(None).cast("long").alias("star"), "rank", "x", "y", F.lit(None).cast("double").alias("ra"), F.lit(None).cast("double").alias("dec"))
    world = world.unionByName(on_field.select("field_id", "star", F.lit(None).cast("long").alias("rank"), "x", "y", "ra", "dec"))

    def check(quad_stars: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        rows = []
        tests = near[near["star"].isna()].sort_values("rank")
        refs = near[near["star"].notna()].sort_values("star")
        xy, ra, dec = tests[["x", "y"]].to_numpy(), refs["ra"].to_numpy(), refs["dec"].to_numpy()
        place = {int(r): i for i, r in enumerate(tests["rank"])}
        for quad_id, own in quad_stars.groupby("quad_id", sort=True):
            own = own.sort_values("k")
            at = [place[int(r)] for r in own["rank"]]
            w = fit_tan(*xy[at].T, own["ra"].to_numpy(), own["dec"].to_numpy(), crpix=(0.5 + width / 2, 0.5 + height / 2))
            w = type(w)(w.crval, w.crpix, w.cd, width, height)
            got = decide(w, xy, ra, dec, rules, at) if scale[0] <= w.pixel_scale <= scale[1] else None
            rows.append((own["field_id"].iloc[0], int(quad_id), w.pixel_scale, got[0].logodds if got else float("nan"), bool(got and got[0].logodds >= rules.solve)))
        return pd.DataFrame(rows, columns=["field_id", "quad_id", "scale", "logodds", "good"])

    verified = spread(pairs, "field_id").groupBy("field_id").cogroup(spread(world, "field_id").groupBy("field_id")).applyInPandas(check, f"field_id {kind}, quad_id long, scale double, logodds double, good boolean")
    out = found.join(verified, ["field_id", "quad_id"], "left")
    reason = F.coalesce("reason", F.when(~f64("scale").between(*scale), "scale").when(F.col("good"), "solves").otherwise("verify"))
    return out.select("field_id", "quad_id", "n_inside", "n_found", "n_sources", "faintest", "ab_px", "code_err", "flipped", "scale", F.nanvl("logodds", F.lit(None).cast("double")).alias("logodds"), reason.alias("reason"))


# --- pixels that two headers agree on ---------------------------------------------------------------------------


def _to_sky(h: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Unit vectors (n, 3) of pixels under the headers of the rows of h (n, 8)."""
    u = np.radians(h[:, 4] * (x - h[:, 2]) + h[:, 5] * (y - h[:, 3]))
    v = np.radians(h[:, 6] * (x - h[:, 2]) + h[:, 7] * (y - h[:, 3]))
    r, e, n = _axes(h)
    p = r + u[:, None] * e + v[:, None] * n
    return p / np.linalg.norm(p, axis=1)[:, None]


def _axes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, d = np.radians(h[:, 0]), np.radians(h[:, 1])
    zero = np.zeros(len(h))
    r = np.stack([np.cos(d) * np.cos(a), np.cos(d) * np.sin(a), np.sin(d)], axis=1)
    return r, np.stack([-np.sin(a), np.cos(a), zero], axis=1), np.stack([-np.sin(d) * np.cos(a), -np.sin(d) * np.sin(a), np.cos(d)], axis=1)


def _to_pixel(h: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    r, e, n = _axes(h)
    along = (p * r).sum(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        u, v = (np.degrees(np.where(along > 0, (p * k).sum(axis=1) / along, np.nan)) for k in (e, n))
        det = h[:, 4] * h[:, 7] - h[:, 5] * h[:, 6]
        return (h[:, 7] * u - h[:, 5] * v) / det + h[:, 2], (h[:, 4] * v - h[:, 6] * u) / det + h[:, 3]


def agreeing_pixels(pairs: DataFrame, key: str, width: float, height: float, rounds: int = 50, residual: float = 1e-7) -> DataFrame:
    """(key, x, y, residual, converged): the pixel with the same sky position under two headers, the centre of their rotation.

    ``pairs`` has the header columns with the prefixes a_ and b_. Newton steps from the middle of the image with a
    difference quotient, for all rows of a batch at once; rows that do not get below ``residual`` pixels have nulls.
    """
    kind = pairs.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            a, b = (pdf[[f"{p}_{h}" for h in HEADER]].to_numpy(float) for p in ("a", "b"))
            off = lambda x, y, a=a, b=b: (lambda q: (q[0] - x, q[1] - y))(_to_pixel(b, _to_sky(a, x, y)))
            x, y = np.full(len(pdf), width / 2), np.full(len(pdf), height / 2)
            for _ in range(rounds):
                fx, fy = off(x, y)
                if not (np.hypot(fx, fy) >= residual / 100).any():
                    break
                step = 1e-2
                (gx, gy), (hx, hy) = off(x + step, y), off(x, y + step)
                j = [(gx - fx) / step, (hx - fx) / step, (gy - fy) / step, (hy - fy) / step]
                with np.errstate(invalid="ignore", divide="ignore"):
                    det = j[0] * j[3] - j[1] * j[2]
                    dx, dy = (j[3] * fx - j[1] * fy) / det, (j[0] * fy - j[2] * fx) / det
                good = np.isfinite(dx) & np.isfinite(dy)
                x, y = np.where(good, x - dx, x), np.where(good, y - dy, y)
            left = np.hypot(*off(x, y))
            done = left < residual
            yield pd.DataFrame({key: pdf[key], "x": np.where(done, x, np.nan), "y": np.where(done, y, np.nan), "residual": left, "converged": done})

    out = pairs.select(key, *[f"{p}_{h}" for p in ("a", "b") for h in HEADER]).mapInPandas(run, f"{key} {kind}, x double, y double, residual double, converged boolean")
    real = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return out.select(key, real("x"), real("y"), real("residual"), "converged")
