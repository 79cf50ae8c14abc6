"""Scalar library queries: angles, text, frames, photometry, dates, projections, cells, arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.functions import healpix as hp
from starloom.functions import physics as ph
from starloom.functions import sphere as sp
from starloom.functions.wcs import Wcs
from starloom.operators.checkpoints import spread
from starloom.operators.growth import split_with_margin
from starloom.plans.registry import query, r6, sky, sky_sql, table, xyz_sql

SKY = sky_sql("customer")
SKYX = xyz_sql(SKY)


@query(f"SELECT id, round(x, 6) + 0 AS x, round(y, 6) + 0 AS y, round(z, 6) + 0 AS z, round(ra, 6) + 0 AS ra_back, round(dec, 6) + 0 AS dec_back FROM {SKYX}")
def sphere_xyz_roundtrip(spark, d):
    x, y, z = sp.radec_to_xyz("ra", "dec")
    s = sky(spark, d, "customer").select("id", x.alias("x"), y.alias("y"), z.alias("z"))
    return s.select("id", r6("x", "x"), r6("y", "y"), r6("z", "z"), r6(sp.xyz_to_ra("x", "y"), "ra_back"), r6(sp.xyz_to_dec("x", "y", "z"), "dec_back"))


@query(
    f"""WITH m AS (SELECT id, ra, dec, CAST(floor(ra / 15.0e0 * 3600000.0e0 + 0.5e0) AS BIGINT) % 86400000 AS a, CAST(floor(abs(dec) * 3600000.0e0 + 0.5e0) AS BIGINT) AS b FROM {SKY})
SELECT id, format('{{:02d}}:{{:02d}}:{{:02d}}.{{:03d}}', a // 3600000, a // 60000 % 60, a // 1000 % 60, a % 1000) AS hms,
 CASE WHEN dec < 0 THEN '-' ELSE '+' END || format('{{:02d}}:{{:02d}}:{{:02d}}.{{:03d}}', b // 3600000, b // 60000 % 60, b // 1000 % 60, b % 1000) AS dms,
 round(15.0e0 * a / 3600000.0e0, 9) AS ra_back, round(CASE WHEN dec < 0 THEN -1 ELSE 1 END * b / 3600000.0e0, 9) AS dec_back FROM m"""
)
def sexagesimal_roundtrip(spark, d):
    t = sky(spark, d, "customer").select("id", sp.ra_to_hms("ra").alias("hms"), sp.dec_to_dms("dec").alias("dms"))
    return t.select("id", "hms", "dms", F.round(sp.parse_ra("hms"), 9).alias("ra_back"), (F.round(sp.parse_dec("dms"), 9) + 0.0).alias("dec_back"))


@query(
    f"""SELECT a.id AS id, b.id AS other, round(degrees(2 * asin(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) / 2)), 6) AS deg,
 round((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z), 6) AS d2,
 round(2 * sin(radians(degrees(2 * asin(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) / 2))) / 2), 6) AS chord
 FROM {SKYX} a JOIN {SKYX} b ON b.id = a.id + 1"""
)
def angular_distances(spark, d):
    a = sky(spark, d, "customer")
    b = a.select(F.col("id").alias("other"), F.col("ra").alias("ra2"), F.col("dec").alias("dec2"))
    t = a.join(b, F.col("other") == F.col("id") + 1).select("id", "other", sp.degrees_between("ra", "dec", "ra2", "dec2").alias("deg"), sp.distsq_between("ra", "dec", "ra2", "dec2").alias("d2"))
    return t.select("id", "other", r6("deg", "deg"), r6("d2", "d2"), r6(sp.deg_to_dist("deg"), "chord"))


def _frame_sql(pole_ra, pole_dec, node):
    return f"""SELECT id, round(CASE WHEN l < 0 THEN l + 360 WHEN l >= 360 THEN l - 360 ELSE l END, 5) AS lon, round(b, 5) + 0 AS lat FROM (SELECT id,
 {node}e0 - degrees(atan2(cos(radians(dec)) * sin(radians(ra - {pole_ra}e0)), sin(radians(dec)) * cos(radians({pole_dec}e0)) - cos(radians(dec)) * sin(radians({pole_dec}e0)) * cos(radians(ra - {pole_ra}e0)))) AS l,
 degrees(asin(greatest(-1, least(1, sin(radians(dec)) * sin(radians({pole_dec}e0)) + cos(radians(dec)) * cos(radians({pole_dec}e0)) * cos(radians(ra - {pole_ra}e0)))))) AS b FROM {SKY})"""


@query(_frame_sql(192.8595, 27.12825, 122.932))
def galactic(spark, d):
    lon, lat = sp.radec_to_galactic("ra", "dec")
    return sky(spark, d, "customer").select("id", (F.round(lon, 5) + 0.0).alias("lon"), (F.round(lat, 5) + 0.0).alias("lat"))


@query(f"SELECT id, round(ra, 5) AS ra_back, round(dec, 5) + 0 AS dec_back FROM {SKY} WHERE id > 0")
def galactic_roundtrip(spark, d):
    lon, lat = sp.radec_to_galactic("ra", "dec")
    t = sky(spark, d, "customer").where("id > 0").select("id", lon.alias("l"), lat.alias("b"))
    ra, dec = sp.galactic_to_radec("l", "b")
    return t.select("id", F.round(ra, 5).alias("ra_back"), (F.round(dec, 5) + 0.0).alias("dec_back"))


@query(
    f"""WITH e AS (SELECT id, x, cos(radians(23.439291111111111e0)) * y + sin(radians(23.439291111111111e0)) * z AS y, cos(radians(23.439291111111111e0)) * z - sin(radians(23.439291111111111e0)) * y AS z FROM {SKYX})
SELECT id, round(CASE WHEN atan2(y, x) < 0 THEN degrees(atan2(y, x)) + 360 ELSE degrees(atan2(y, x)) END, 5) AS lon, round(degrees(atan2(z, sqrt(x * x + y * y))), 5) + 0 AS lat FROM e"""
)
def ecliptic(spark, d):
    lon, lat = sp.radec_to_ecliptic("ra", "dec")
    return sky(spark, d, "customer").select("id", F.round(lon, 5).alias("lon"), (F.round(lat, 5) + 0.0).alias("lat"))


@query("SELECT p_partkey AS id, round(power(10.0e0, -0.4e0 * (p_size % 25)), 8) AS flux, round(-2.5e0 * log10(power(10.0e0, -0.4e0 * (p_size % 25))), 6) + 0 AS mag, CASE WHEN p_size % 3 = 0 THEN 25.0e0 ELSE round(22.5e0 - 2.5e0 * log10(p_retailprice), 6) END AS nmgy_mag FROM part")
def mag_flux(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size", "p_retailprice", ph.mag_to_flux(F.col("p_size") % 25).alias("f"))
    nmgy = ph.nanomaggies_to_mag(F.when(F.col("p_size") % 3 == 0, F.lit(0.0)).otherwise(F.col("p_retailprice")))
    return t.select("id", F.round("f", 8).alias("flux"), r6(ph.flux_to_mag("f"), "mag"), F.round(nmgy, 6).alias("nmgy_mag"))


@query(f"SELECT id, round(ra / 360.0e0, 6) AS mx, round(0.5e0 + asinh(tan(radians(dec))) / (2 * pi()), 6) AS my FROM {SKY} WHERE id > 0")
def mercator(spark, d):
    return sky(spark, d, "customer").where("id > 0").select("id", F.round(sp.mercator_x("ra"), 6).alias("mx"), F.round(sp.mercator_y("dec"), 6).alias("my"))


@query(
    f"""WITH h AS (SELECT id, sqrt(x*x + z*z) * sin(atan2(x, z) / 2) AS x, y, sqrt(x*x + z*z) * cos(atan2(x, z) / 2) AS z FROM {SKYX})
SELECT id, round(0.5e0 * (1 + x * sqrt(1 / (1 + z))), 6) AS px, round(0.5e0 * (1 + y * sqrt(1 / (1 + z))), 6) AS py FROM h"""
)
def hammer_projection(spark, d):
    x, y, z = sp.radec_to_xyz("ra", "dec")
    px, py = sp.hammer_aitoff("x", "y", "z")
    return sky(spark, d, "customer").select("id", x.alias("x"), y.alias("y"), z.alias("z")).select("id", F.round(px, 6).alias("px"), F.round(py, 6).alias("py"))


@query("SELECT event_id, round(epoch_us(ts) / 86400e6 + 40587.0e0, 8) AS mjd, round(epoch_us(ts) / 86400e6 + 2440587.5e0, 8) AS jd, round((epoch_us(ts) / 86400e6 + 40587.0e0 - 51544.5e0) / 365.25e0, 8) AS years FROM events")
def julian_dates(spark, d):
    t = table(spark, d, "events")
    return t.select("event_id", F.round(ph.timestamp_to_mjd("ts"), 8).alias("mjd"), F.round(ph.timestamp_to_jd("ts"), 8).alias("jd"), F.round(ph.days_to_years(ph.timestamp_to_mjd("ts") - 51544.5), 8).alias("years"))


HEADER = Wcs((120.0, 20.0), (512.5, 512.5), ((-0.02, 0.003), (0.003, 0.02)), 1024, 1024)


def tan_sql(sin: bool = False) -> str:
    """id, px, py of the sky in HEADER's plane; null beyond the hemisphere."""
    (a, b), (c, e) = HEADER._inverse()
    r, east, north = HEADER._basis()
    vec = lambda v: f"(x * {v[0]!r}::DOUBLE + y * {v[1]!r}::DOUBLE + z * {v[2]!r}::DOUBLE)"
    return f"""(SELECT id, ra, dec, u * {a!r}::DOUBLE + v * {b!r}::DOUBLE + 512.5e0 AS px, u * {c!r}::DOUBLE + v * {e!r}::DOUBLE + 512.5e0 AS py FROM (
 SELECT id, ra, dec, CASE WHEN {vec(r)} > 0 THEN degrees({vec(east)} / {"1" if sin else vec(r)}) END AS u, CASE WHEN {vec(r)} > 0 THEN degrees({vec(north)} / {"1" if sin else vec(r)}) END AS v FROM {SKYX}))"""


@query(f"SELECT t.id, round(t.px, 4) + 0 AS px, round(t.py, 4) + 0 AS py, round(s.px, 4) + 0 AS sx, round(s.py, 4) + 0 AS sy FROM {tan_sql()} t JOIN {tan_sql(True)} s USING (id)")
def tan_sin_project(spark, d):
    from dataclasses import replace

    (px, py), (sx, sy) = HEADER.radec_to_pixel("ra", "dec"), replace(HEADER, sin=True).radec_to_pixel("ra", "dec")
    r4 = lambda c, n: (F.round(c, 4) + 0.0).alias(n)
    return sky(spark, d, "customer").select("id", r4(px, "px"), r4(py, "py"), r4(sx, "sx"), r4(sy, "sy"))


@query(f"SELECT id, round(ra, 5) AS ra, round(dec, 5) + 0 AS dec FROM {tan_sql()} WHERE px BETWEEN 0.5 AND 1024.5 AND py BETWEEN 0.5 AND 1024.5")
def wcs_xy_roundtrip(spark, d):
    px, py = HEADER.radec_to_pixel("ra", "dec")
    t = sky(spark, d, "customer").where(HEADER.contains("ra", "dec")).select("id", px.alias("px"), py.alias("py"))
    ra, dec = HEADER.pixel_to_radec("px", "py")
    return t.select("id", F.round(ra, 5).alias("ra"), (F.round(dec, 5) + 0.0).alias("dec"))


@query(f"SELECT id, round(px, 4) + 0 AS px, round(py, 4) + 0 AS py FROM {tan_sql()} WHERE px BETWEEN 0.5 AND 1024.5 AND py BETWEEN 0.5 AND 1024.5")
def footprint_filter(spark, d):
    px, py = HEADER.radec_to_pixel("ra", "dec")
    return sky(spark, d, "customer").where(HEADER.contains("ra", "dec")).select("id", (F.round(px, 4) + 0.0).alias("px"), (F.round(py, 4) + 0.0).alias("py"))


@query(
    f"""WITH t AS (SELECT id, px, py, px - 512.5e0 AS u, py - 512.5e0 AS v FROM {tan_sql()} WHERE px BETWEEN 0.5 AND 1024.5 AND py BETWEEN 0.5 AND 1024.5)
SELECT id, round(px + 1.5e-5 * u * u - 2.0e-6 * u * v + 3.0e-9 * u * v * v, 4) + 0 AS qx, round(py - 1.0e-5 * v * v + 4.0e-6 * u * u, 4) + 0 AS qy FROM t"""
)
def sip_distortion(spark, d):
    from dataclasses import replace

    sip = replace(HEADER, ap={(2, 0): 1.5e-5, (1, 1): -2.0e-6, (1, 2): 3.0e-9}, bp={(0, 2): -1.0e-5, (2, 0): 4.0e-6})
    px, py = sip.radec_to_pixel("ra", "dec")
    return sky(spark, d, "customer").where(HEADER.contains("ra", "dec")).select("id", (F.round(px, 4) + 0.0).alias("qx"), (F.round(py, 4) + 0.0).alias("qy"))


def cell_sql(source: str, n: int) -> str:
    """``source`` (with x, y, z) and its cell."""
    return f"""(SELECT *, base * {n * n} + greatest(0, least({n - 1}, CAST(floor(fx) AS BIGINT))) * {n} + greatest(0, least({n - 1}, CAST(floor(fy) AS BIGINT))) AS cell FROM (SELECT *,
 CASE WHEN polar THEN CASE WHEN z > 0 THEN t ELSE 8 + t END WHEN ex >= {n} AND ey >= {n} THEN t WHEN ex >= {n} THEN (t + 1) % 4 + 4 WHEN ey >= {n} THEN t + 4 ELSE t + 8 END AS base,
 CASE WHEN polar THEN CASE WHEN z > 0 THEN {n} - root * (1 - q) ELSE root * q END WHEN ex >= {n} THEN ex - {n} ELSE ex END AS fx,
 CASE WHEN polar THEN CASE WHEN z > 0 THEN {n} - root * q ELSE root * (1 - q) END WHEN ey >= {n} THEN ey - {n} ELSE ey END AS fy FROM (SELECT *,
 abs(z) >= 2.0e0 / 3.0e0 AS polar, sqrt(greatest(0, 3 * (1 - abs(z)))) * {n} AS root, ((z + 2.0e0 / 3.0e0) / (4.0e0 / 3.0e0) + q) * {n} AS ex, ((z + 2.0e0 / 3.0e0) / (4.0e0 / 3.0e0) - q + 1) * {n} AS ey FROM (SELECT *,
 CAST(floor(phi / (pi() / 2)) AS BIGINT) % 4 AS t, (phi - floor(phi / (pi() / 2)) * (pi() / 2)) / (pi() / 2) AS q FROM (SELECT *, CASE WHEN atan2(y, x) < 0 THEN atan2(y, x) + 2 * pi() ELSE atan2(y, x) END AS phi FROM {source})))))"""


@query(f"SELECT cell, count(*) AS n, min(id) AS first_id FROM {cell_sql(SKYX, 6)} GROUP BY cell")
def healpix_cell_counts(spark, d):
    return sky(spark, d, "customer").groupBy(hp.radec_to_cell("ra", "dec", 6).alias("cell")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(f"SELECT id, cell, cell // 256 * 4 + (cell % 256 // 16 // 8) * 2 + (cell % 16) // 8 AS coarse FROM {cell_sql(SKYX, 16)}")
def healpix_change_nside(spark, d):
    t = sky(spark, d, "customer").select("id", hp.radec_to_cell("ra", "dec", 16).alias("cell"))
    return t.select("id", "cell", hp.convert_nside("cell", 16, 2).alias("coarse"))


@query(
    """WITH p AS (SELECT i AS cell, i // 64 AS b, i % 64 // 8 AS x, i % 8 AS y FROM range(768) t(i)), r AS (SELECT *, (b // 4 + 2) * 8 - x - y - 1 AS row, [1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7][b + 1] AS turn FROM p),
l AS (SELECT *, least(row, 8, 32 - row) AS len FROM r), s AS (SELECT *, (turn * len + x - y + 1 + CASE WHEN row BETWEEN 8 AND 24 THEN (row - 8) % 2 ELSE 0 END) // 2 AS along FROM l)
SELECT CAST(cell AS BIGINT) AS cell, CAST(b * 64 + list_sum([(x // (1 << k)) % 2 * (1 << 2 * k) + (y // (1 << k)) % 2 * (2 << 2 * k) FOR k IN range(0, 3)]) AS BIGINT) AS nested, CAST(coalesce((SELECT sum(4 * least(q, 8, 32 - q)) FROM range(1, s.row) z(q)), 0) + (along - 1 + 4 * len) % (4 * len) AS BIGINT) AS ring,
CAST(cell AS BIGINT) AS back_nested, CAST(cell AS BIGINT) AS back_ring FROM s"""
)
def healpix_numberings(spark, d):
    """Nested and ring numbers of cells, and the way back."""
    t = spark.range(768).select(F.col("id").alias("cell"), hp.xy_to_nested("id", 8).alias("nested"), hp.xy_to_ring("id", 8).alias("ring"))
    return t.select("cell", "nested", "ring", hp.nested_to_xy("nested", 8).alias("back_nested"), hp.ring_to_xy("ring", 8).alias("back_ring"))


@query()
def healpix_neighbours(spark, d):
    cells = sky(spark, d, "supplier").select(hp.radec_to_cell("ra", "dec", 4).alias("cell")).distinct()
    return cells.select("cell", F.explode(hp.neighbours(4)("cell")).alias("neighbour"))


@query()
def healpix_split_margin(spark, d):
    """Every position in all cells that it is within a margin of: the rows of a sky split into overlapping cells."""
    return spread(sky(spark, d, "supplier")).select("id", F.explode(hp.range_search(2, 5.0)("ra", "dec")).alias("cell"))


@query()
def sky_split_grown(spark, d):
    """The same split of all customers by areas that are grown until the margin is covered."""
    return split_with_margin(sky(spark, d, "customer"), 2, 8, 5.0).select("id", "area", "inside")


@query(
    f"""WITH RECURSIVE o AS (SELECT s_suppkey AS id, 1.0e0 + s_suppkey % 7 AS a, s_suppkey % 9 / 10.0e0 AS e, s_suppkey % 5 * 0.1e0 AS i, CAST(s_suppkey % 6 AS DOUBLE) AS m FROM supplier),
k AS (SELECT id, m + e * sin(m) AS b, m + e * sin(m) AS seen, 0 AS n FROM o UNION ALL
SELECT id, b - (b - e * sin(b) - m) / (1 - e * cos(b)), seen - (seen - e * sin(seen) - m + a * (1 - e * cos(seen)) * {ph.METRES_PER_AU / ph.LIGHT / 86400!r} * sqrt({ph.GM_SUN!r} / (a * a * a))) / (1 - e * cos(seen)), n + 1 FROM k JOIN o USING (id) WHERE n < 80),
p AS (SELECT id, b, b - e * sin(b) - m AS left_over, i, a * (cos(seen) - e) AS px, a * sqrt(1 - e * e) * sin(seen) AS py FROM k JOIN o USING (id) WHERE n = 80),
t AS (SELECT *, px * cos(1.1e0) - py * sin(1.1e0) AS u, px * sin(1.1e0) + py * cos(1.1e0) AS v FROM p), h AS (SELECT *, u * cos(0.3e0) - v * cos(i) * sin(0.3e0) AS x, u * sin(0.3e0) + v * cos(i) * cos(0.3e0) AS y, v * sin(i) AS z, radians(23.439281e0) AS t FROM t)
SELECT id, round(b, 6) + 0 AS eccentric, round(left_over, 6) + 0 AS residual, round((degrees(atan2(y * cos(t) - z * sin(t), x)) + 360) % 360, 6) + 0 AS ra, round(degrees(asin((y * sin(t) + z * cos(t)) / sqrt(x * x + y * y + z * z))), 6) + 0 AS dec FROM h"""
)
def kepler_orbits(spark, d):
    t = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (1.0 + F.col("s_suppkey") % 7).alias("a"), ((F.col("s_suppkey") % 9) / 10.0).alias("e"), ((F.col("s_suppkey") % 5) * 0.1).alias("inc"), (F.col("s_suppkey") % 6).cast("double").alias("m"))
    t = t.withColumn("big", ph.kepler("m", "e")).withColumn("p", ph.orbit_radec("a", "e", "inc", F.lit(0.3), F.lit(1.1), "m"))
    return t.select("id", r6("big", "eccentric"), r6(F.col("big") - F.col("e") * F.sin("big") - F.col("m"), "residual"), r6("p.ra", "ra"), r6("p.dec", "dec"))


@query("SELECT job, CAST(unnest(list_concat(list_concat([job % 40], range(job % 11 + 50, job % 11 + 51 + job % 4)), range(job % 7 + 90, job % 5 + 93))) AS BIGINT) AS field FROM (SELECT c_custkey AS job FROM customer)")
def range_list(spark, d):
    """Lists of numbers and ranges written as text, a job for each customer: blanks, other words and backward ranges are passed over."""
    k = F.col("c_custkey")
    part = lambda low, high: F.concat_ws("-", low.cast("string"), high.cast("string"))
    written = F.concat((k % 40).cast("string"), F.lit(", "), part(k % 11 + 50, k % 11 + 50 + k % 4), F.lit(",x,,-,"), part(k % 7 + 90, k % 5 + 92))
    return table(spark, d, "customer").select(k.alias("job"), F.explode(ph.parse_ranges(written)).alias("field"))


@query("SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 10.0e0 * 3600 / 1000 WHEN 1 THEN 10.0e0 * 60 / 1000 WHEN 2 THEN 10.0e0 ELSE round(degrees(atan(36.0e0 / 20.0e0)) * 3600 / 1000, 6) END AS scale FROM supplier")
def scale_units(spark, d):
    unit = F.element_at(F.array(*map(F.lit, ("degwidth", "arcminwidth", "arcsecperpix", "focalmm"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    t = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), unit.alias("u"))
    return t.select("id", F.round(ph.arcsec_per_pixel(F.lit(10.0), "u", F.lit(1000.0)), 6).alias("scale"))


@query("SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 5) AS dot, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm FROM embeddings")
def vector_algebra(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(ph.dot("embedding", "embedding"), 5).alias("dot"), F.round(ph.norm("embedding"), 5).alias("norm"))


@query("SELECT n_nationkey AS id, string_split(n_name, 'A') AS parts, array_to_string(list_reverse(string_split(n_name, 'A')), '-') AS reversed, starts_with(n_name, 'A') AS starts, suffix(n_name, 'A') AS ends, md5(n_name) AS digest, list_position(string_split(n_name, ''), 'N') AS at FROM nation")
def string_lists(spark, d):
    parts = F.split("n_name", "A")
    at = F.array_position(F.split("n_name", ""), "N").cast("int")
    return table(spark, d, "nation").select(
        F.col("n_nationkey").alias("id"), parts.alias("parts"), F.array_join(F.reverse(parts), "-").alias("reversed"), F.col("n_name").startswith("A").alias("starts"), F.col("n_name").endswith("A").alias("ends"), F.md5("n_name").alias("digest"), F.when(at > 0, at).alias("at")
    )


@query("SELECT o_orderkey AS id, list_sort(list_distinct([o_custkey % 7, o_orderkey % 5, 3])) AS uniq, list_contains([o_custkey % 7, o_orderkey % 5, 3], 4) AS has4, list_filter([o_custkey % 7, o_orderkey % 5, 3], lambda x: x <> 3) AS without3, list_reverse([o_custkey % 7, o_orderkey % 5, 3]) AS rev FROM orders")
def sorted_lists(spark, d):
    a = F.array(F.col("o_custkey") % 7, F.col("o_orderkey") % 5, F.lit(3).cast("long"))
    four = F.lit(4).cast("long")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.array_sort(F.array_distinct(a)).alias("uniq"), F.array_contains(a, four).alias("has4"), F.array_remove(a, F.lit(3).cast("long")).alias("without3"), F.reverse(a).alias("rev"))


@query(
    f"""SELECT id, 'SDSS J' || format('{{:02d}}{{:02d}}{{:02d}}.{{:02d}}', h // 360000, h // 6000 % 60, h // 100 % 60, h % 100) || CASE WHEN dec < 0 THEN '-' ELSE '+' END
 || format('{{:02d}}{{:02d}}{{:02d}}.{{:d}}', b // 36000, b // 600 % 60, b // 10 % 60, b % 10) AS name FROM (SELECT id, dec, CAST(floor(ra / 15.0e0 * 360000.0e0 + 1e-6) AS BIGINT) AS h, CAST(floor(abs(dec) * 36000.0e0 + 1e-6) AS BIGINT) AS b FROM {SKY})"""
)
def iau_names(spark, d):
    return sky(spark, d, "customer").select("id", ph.iau_name("ra", "dec").alias("name"))


@query(f"SELECT id, ((b1 - a1) + 720) % 360 <= 40 OR ((a1 - b1) + 720) % 360 <= 25 AS overlap FROM (SELECT id, CAST(id * 37 % 360 AS BIGINT) AS a1, CAST(id * 53 % 360 AS BIGINT) AS b1 FROM {SKY})")
def ra_overlap(spark, d):
    a, b = F.col("id") * 37 % 360, F.col("id") * 53 % 360
    return sky(spark, d, "customer").select("id", sp.ra_ranges_overlap(a, a + 40, b, b + 25).alias("overlap"))
