"""Index build, search and fit queries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from starloom.functions.wcs import Wcs, fit_sip, fit_tan
from starloom.operators import geohash as gh
from starloom.operators import verify as vf
from starloom.operators.checkpoints import reliable, spread
from starloom.operators.spatial import range_join
from starloom.plans.registry import query, table, xyz_sql

#: suppliers in lists of 25, the stars of each scattered over 24 by 24 degrees; quads have AB of 8 to 13 degrees
LIST, LOW, HIGH_AB, PRIME = 25, 8.0, 13.0, 1_000_003


def _scatter(key, square: int, plain: int):
    """An even scatter of keys over 24 degrees, as text for SQL and Spark alike."""
    m = f"({key} % {PRIME})"
    return f"(({m} * {m} * {square} + {m} * {plain}) % {PRIME}) * 24.0e0 / {PRIME}.0e0"


RA, DEC = f"168.0e0 + {_scatter('s_suppkey', 31, 7919)}", f"{_scatter('s_suppkey', 57, 104729)} - 12.0e0"
S = xyz_sql(f"(SELECT s_suppkey AS id, CAST(floor((s_suppkey - 1) / {LIST}) AS BIGINT) AS list, {RA} AS ra, {DEC} AS dec FROM supplier)")
SEP = "degrees(2 * asin(least(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) / 2, 1)))"


def _plane_sql(x: str, y: str, z: str) -> tuple[str, str]:
    along = f"({x} * rx + {y} * ry + {z} * rz)"
    return f"(({x} * ex + {y} * ey) / {along})", f"(({x} * nx + {y} * ny + {z} * nz) / {along})"


(PA, QA), (PB, QB), (PS, QS) = _plane_sql("ax", "ay", "az"), _plane_sql("bx", "by_", "bz"), _plane_sql("s.x", "s.y", "s.z")
INNER = f"""WITH s AS (SELECT * FROM {S}), ab AS (SELECT a.list AS list, a.id AS a, b.id AS b, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, a.x + b.x AS mx, a.y + b.y AS my, a.z + b.z AS mz FROM s a JOIN s b ON a.list = b.list AND a.id < b.id AND {SEP} BETWEEN {LOW} AND {HIGH_AB}),
r AS (SELECT *, mx / sqrt(mx*mx + my*my + mz*mz) AS rx, my / sqrt(mx*mx + my*my + mz*mz) AS ry, mz / sqrt(mx*mx + my*my + mz*mz) AS rz FROM ab),
e AS (SELECT *, -ry / sqrt(rx*rx + ry*ry) AS ex, rx / sqrt(rx*rx + ry*ry) AS ey FROM r), n AS (SELECT *, -rz * ey AS nx, rz * ex AS ny, rx * ey - ry * ex AS nz FROM e),
p AS (SELECT a, b, s.id AS s, {QB} - {QA} AS fx, {PB} - {PA} AS fy, {QS} - {QA} AS sx, {PS} - {PA} AS sy FROM n JOIN s ON s.list = n.list AND s.id <> a AND s.id <> b AND s.x * rx + s.y * ry + s.z * rz > 0.9),
c AS (SELECT a, b, s, (sx * (fy + fx) + sy * (fy - fx)) / (fx*fx + fy*fy) AS x, (sy * (fy + fx) - sx * (fy - fx)) / (fx*fx + fy*fy) AS y FROM p),
i AS (SELECT * FROM c WHERE x*x - x + y*y - y <= 0)"""
QUADS = f"""{INNER}, q AS (SELECT i.a, i.b, i.s, i.x, i.y, j.s AS s2, j.x AS x2, j.y AS y2 FROM i JOIN i j ON i.a = j.a AND i.b = j.b AND (i.x < j.x OR (i.x = j.x AND i.s < j.s))),
f AS (SELECT CASE WHEN x + x2 > 1 THEN b ELSE a END AS a, CASE WHEN x + x2 > 1 THEN a ELSE b END AS b, CASE WHEN x + x2 > 1 THEN s2 ELSE s END AS c, CASE WHEN x + x2 > 1 THEN s ELSE s2 END AS d,
 CASE WHEN x + x2 > 1 THEN [1 - x2, 1 - y2, 1 - x, 1 - y] ELSE [x, y, x2, y2] END AS code FROM q)"""


def star_lists(spark, d):
    """Every supplier as a star of its list."""
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("id"), F.floor((k - 1) / LIST).alias("list"), F.expr(RA).alias("ra"), F.expr(DEC).alias("dec"))


def _all(spark, d):
    return gh.all_quads(star_lists(spark, d), LOW, HIGH_AB, "list")


@query(f"{QUADS} SELECT a, b, c, d, list_transform(code, lambda v: round(v, 5) + 0) AS code FROM f")
def quad_codes(spark, d):
    return _all(spark, d).select("a", "b", "c", "d", F.transform("code", lambda v: F.round(v, 5) + 0.0).alias("code"))


@query(f"{QUADS} SELECT count(*) AS n, count(*) FILTER ((code[1] + code[3]) / 2 <= 0.5) AS mean_ok, count(*) FILTER (code[1] <= code[3]) AS order_ok, min(least(code[1], code[3])) >= -0.21 AS inside FROM f")
def code_invariants(spark, d):
    q = _all(spark, d)
    c = lambda i: F.col("code")[i]
    return q.agg(F.count("*").alias("n"), F.count_if((c(0) + c(2)) / 2 <= 0.5).alias("mean_ok"), F.count_if(c(0) <= c(2)).alias("order_ok"), (F.min(F.least(c(0), c(2))) >= -0.21).alias("inside"))


@query(f"{QUADS} SELECT g.a AS ga, g.b AS gb, g.c AS gc, g.d AS gd, count(*) AS n FROM f g JOIN f ON list_distance(g.code, f.code) <= 0.02 GROUP BY 1, 2, 3, 4")
def code_range_match(spark, d):
    """Similarity join of all codes with all codes within a tolerance."""
    q = _all(spark, d)
    some = q.select(F.col("a").alias("ga"), F.col("b").alias("gb"), F.col("c").alias("gc"), F.col("d").alias("gd"), F.col("code").alias("gcode"))
    return gh.range_join(some, q.select("code"), 0.02, "gcode", "code", dims=4).groupBy("ga", "gb", "gc", "gd").agg(F.count("*").alias("n"))


@query(f"{QUADS}, u AS (SELECT unnest([a, b, c, d]) AS star FROM f) SELECT star, count(*) AS n FROM u GROUP BY star")
def quads_per_star(spark, d):
    return _all(spark, d).select(F.explode(F.array("a", "b", "c", "d")).alias("star")).groupBy("star").agg(F.count("*").alias("n"))


@query(f"{QUADS}, u AS (SELECT unnest(generate_series(0, 3)) AS dim, code FROM f) SELECT CAST(dim AS INT) AS dim, least(greatest(CAST(floor((code[dim + 1] + 0.5e0) / (2.0e0 / 20)) AS INT), 0), 19) AS bin, count(*) AS n FROM u GROUP BY 1, 2")
def code_histograms(spark, d):
    p = _all(spark, d).select(F.posexplode("code").alias("dim", "v"))
    return p.groupBy("dim", F.least(F.greatest(F.floor((F.col("v") + 0.5) / (2.0 / 20)).cast("int"), F.lit(0)), F.lit(19)).alias("bin")).agg(F.count("*").alias("n"))


#: stars of a patch at most, and its sides in degrees of the equator and of declination
PATCH, WIDE, HIGH = 700, 14.0 * np.cos(np.radians(25.0)), 12.0
CENTRE = (210.0, 25.0)


def _rows(zoom: int) -> tuple[np.ndarray, np.ndarray]:
    """Declinations of the rows of patches, that of the first patch first, and how many patches each holds."""
    step = HIGH / zoom
    dec = CENTRE[1] + step * np.arange(-200 * zoom, 200 * zoom)
    dec = dec[np.abs(dec) <= 75.0]
    dec = dec[np.argsort(np.abs(dec - CENTRE[1]), kind="stable")]
    return dec, np.floor(360.0 * np.cos(np.radians(dec)) * zoom / WIDE).astype(int)


def patch_centres(patch: np.ndarray, zoom: int) -> tuple[np.ndarray, np.ndarray]:
    dec, n = _rows(zoom)
    row = np.searchsorted(np.cumsum(n), patch, side="right")
    place = patch - (np.cumsum(n) - n)[row]
    return (CENTRE[0] + place * 360.0 / n[row]) % 360.0, dec[row]


def patches(spark, d) -> tuple[int, int, int]:
    """Largest key, number of patches, and the zoom: how many times smaller all angles are, so that the patches fit on the sphere."""
    last = table(spark, d, "customer").agg(F.max("c_custkey")).first()[0] or 0
    n, zoom = last // PATCH + 1, 1
    while _rows(zoom)[1].sum() < n:
        zoom *= 2
    return last, n, zoom


def local_sky(spark, d, size=None):
    """All customers, dealt by key to patches of 14 by 12 degrees or less that lie side by side on the sky; ``size`` is what ``patches`` gives."""
    last, n, zoom = size or patches(spark, d)
    k = F.col("c_custkey")
    spread = lambda seed, high: F.pmod(F.xxhash64(k, F.lit(seed)), F.lit(high * 100_000)) / 100_000.0
    t = table(spark, d, "customer").where(k.isNotNull()).select(k.cast("long").alias("id"), F.floor(k * n / (last + 1)).alias("patch"), spread(1, 14).alias("u"), spread(2, 12).alias("v"), (k * 37 % 701).cast("double").alias("mag"))

    def run(batches):
        for pdf in batches:
            ra, dec = patch_centres(pdf["patch"].to_numpy(), zoom)
            ra = (ra + (pdf["u"] - 7.0) / 14.0 * WIDE / np.cos(np.radians(dec)) / zoom) % 360.0
            yield pd.DataFrame({"id": pdf["id"], "ra": ra, "dec": dec + (pdf["v"] - 6.0) / zoom, "mag": pdf["mag"], "patch": pdf["patch"]})

    return t.mapInPandas(run, "id long, ra double, dec double, mag double, patch long")


HEADERS = {1: Wcs((210.0, 25.0), (500.5, 500.5), ((-0.004, 0.0008), (0.0008, 0.004)), 1000, 1000), 2: Wcs((207.5, 22.5), (500.5, 500.5), ((0.0036, 0.001), (-0.001, 0.0036)), 1000, 1000)}


def patch_header(patch: int, h: int, zoom: int) -> Wcs:
    """Header h moved from the first patch to another."""
    w = HEADERS[h]
    ra, dec = (float(c[0]) for c in patch_centres(np.array([patch]), zoom))
    east = (w.crval[0] - CENTRE[0]) * np.cos(np.radians(CENTRE[1])) / np.cos(np.radians(dec))
    cd = tuple(tuple(c / zoom for c in row) for row in w.cd)
    return Wcs(((ra + east / zoom) % 360.0, dec + (w.crval[1] - CENTRE[1]) / zoom), w.crpix, cd, w.width, w.height)


def stars_in_fields(spark, d, size=None, stars=None):
    """Stars on the two fields of every patch, at their pixels: field 2 p + h has header h of patch p."""
    size = size or patches(spark, d)
    zoom = size[2]

    def run(batches):
        for pdf in batches:
            for p, own in pdf.groupby("patch"):
                for h in HEADERS:
                    w = patch_header(int(p), h, zoom)
                    x, y = w.np_radec_to_pixel(own["ra"].to_numpy(), own["dec"].to_numpy())
                    ok = (x >= 0.5) & (x <= w.width + 0.5) & (y >= 0.5) & (y <= w.height + 0.5)
                    yield own.assign(x=x, y=y, header=h, field_id=2 * int(p) + h)[ok]

    return (stars or local_sky(spark, d, size)).mapInPandas(run, "id long, ra double, dec double, mag double, patch long, x double, y double, header int, field_id long")


def made_up_fields(spark, d, size=None, stars=None):
    """Sources of two fields a patch: its stars with a little noise, brightest first, and a few false sources."""
    size = size or patches(spark, d)
    n = size[1]
    seen = stars_in_fields(spark, d, size, stars).select("field_id", (F.col("x") + (F.col("id") * 31 % 7 - 3) / 10).alias("x"), (F.col("y") + (F.col("id") * 17 % 5 - 2) / 10).alias("y"), "mag")
    i = F.col("id") % 3
    false = spark.range(6 * n).select((F.floor(F.col("id") / 3) + 1).alias("field_id"), (i * 311 % 1000 + 50.5).alias("x"), (i * 173 % 1000 + 77.5).alias("y"), (i * 3 + 2.5).alias("mag"))
    from pyspark.sql import Window

    return seen.unionByName(false).withColumn("rank", (F.row_number().over(Window.partitionBy("field_id").orderBy("mag", "x")) - 1).cast("long")).select("field_id", "rank", "x", "y")


def all_correspondences(spark, d, radius_px: float):
    """Sources and stars of the same field within a radius."""
    src = made_up_fields(spark, d).select(F.col("field_id").alias("field"), F.col("rank").alias("field_id"), F.col("x").alias("field_x"), F.col("y").alias("field_y"))
    ref = stars_in_fields(spark, d).select(F.col("field_id").alias("index_field"), F.col("id").alias("index_id"), F.col("x").alias("index_x"), F.col("y").alias("index_y"))
    return range_join(src, ref, radius_px, ["field_x", "field_y"], ["index_x", "index_y"], by=("field", "index_field"))


@query()
def index_quads(spark, d):
    size = patches(spark, d)
    zoom = size[2]
    return gh.build_quads(local_sky(spark, d, size), 30 * zoom, 0.8 / zoom, 1.8 / zoom).select(F.array_sort("stars").alias("stars"), "cell", "turn")


def field_rules(zoom: int) -> vf.Rules:
    return vf.Rules(bin_arcmin=75.0 / zoom)


@query()
def solved_fields(spark, d):
    """Blind solution of all made-up fields against the index of all patches.

    Stars and sources are read by every step of every stage, so they are written once: plans stay short in the driver.
    """
    size = patches(spark, d)
    zoom, stars = size[2], reliable(spread(local_sky(spark, d, size), "id"))
    sources = reliable(made_up_fields(spark, d, size, stars))
    quads = gh.build_quads(stars, 30 * zoom, 0.8 / zoom, 1.8 / zoom, passes=6)
    got = vf.solve(sources, stars, quads, 1000, 1000, (12.0 / zoom, 18.0 / zoom), (0.8 / zoom, 1.8 / zoom), depths=(12, 24), rules=field_rules(zoom))
    return got.select("field_id", "depth", F.round("scale", 2).alias("scale"), F.round("crval0", 2).alias("ra"), F.round("crval1", 2).alias("dec"), F.round("logodds", 3).alias("logodds"), "n_match", "n_distract", "n_conflict", F.round("rms", 2).alias("rms"), "tuned")


@query()
def plane_fits(spark, d):
    """TAN and SIP fits of every field from correspondences with known stars, as residuals."""
    parts = stars_in_fields(spark, d).select(F.col("field_id").cast("int").alias("field_id"), "x", "y", "ra", "dec")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        v = [pdf[c].to_numpy() for c in ("x", "y", "ra", "dec")]
        tan = fit_tan(*v, crpix=(500.5, 500.5))
        sip = fit_sip(*v, tan, 2)
        res = lambda w: float(np.hypot(*(p - q for p, q in zip(w.np_radec_to_pixel(v[2], v[3]), v[:2], strict=True))).max())
        return pd.DataFrame([{"field_id": pdf["field_id"].iloc[0], "n": len(pdf), "scale": round(tan.pixel_scale, 2), "tan_ok": res(tan) < 0.5, "sip_ok": res(sip) < 0.05}])

    return parts.groupBy("field_id").applyInPandas(fit, "field_id int, n long, scale double, tan_ok boolean, sip_ok boolean")


@query()
def field_index_correspondences(spark, d):
    """Sources of every field (``field``) within three pixels of a star; ``field_id`` is the rank of the source."""
    return all_correspondences(spark, d, 3.0).select("field", "field_id", "index_id", F.round("dist", 4).alias("dist"))


@query()
def verified_headers(spark, d):
    """Log-odds and counts of the true header of each field, and of that of the other field of its patch."""
    refs = stars_in_fields(spark, d).groupBy("patch", F.col("field_id").cast("int").alias("header")).agg(F.sort_array(F.collect_list(F.array("x", "y"))).alias("refs"))
    tests = made_up_fields(spark, d).groupBy(F.floor((F.col("field_id") - 1) / 2).alias("patch"), F.col("field_id").cast("int").alias("field_id")).agg(F.sort_array(F.collect_list(F.struct("rank", "x", "y"))).alias("tests"))
    rows = refs.join(tests, "patch").select("field_id", "header", "refs", "tests")

    def check(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                xy = np.array([(t["x"], t["y"]) for t in r.tests])
                fold = vf.verify(xy, np.array([list(v) for v in r.refs]), 1e6, np.ones(len(xy)))
                out.append((r.field_id, r.header, round(fold.logodds, 4), *fold.counts))
            yield pd.DataFrame(out, columns=["field_id", "header", "logodds", "n_match", "n_distract", "n_conflict"])

    return rows.mapInPandas(check, "field_id int, header int, logodds double, n_match int, n_distract int, n_conflict int")
