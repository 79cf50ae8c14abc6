"""Remaining operators: modes, noise, spike joins, footprints, survey coordinates, progressive jobs, locality."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from starloom.functions import healpix as hp
from starloom.functions import physics as ph
from starloom.functions import survey as sv
from starloom.functions.base import let
from starloom.functions.wcs import box, np_boxes_overlap
from starloom.operators import geohash as gh
from starloom.operators import spatial as sj
from starloom.operators import tables as tb
from starloom.operators.verify import dedup_sources
from starloom.plans.registry import query, r6, sky, sky_sql, table, xyz_sql
from starloom.plans.scalars import cell_sql

SKY = sky_sql("customer")


@query(
    f"""WITH m AS (SELECT id, cos(radians(dec)) * cos(radians(ra - 95)) AS x, cos(radians(dec)) * sin(radians(ra - 95)) AS y, sin(radians(dec)) AS z FROM {SKY} WHERE id > 0),
r AS (SELECT id, x, y * cos(radians(10.0e0)) + z * sin(radians(10.0e0)) AS y, z * cos(radians(10.0e0)) - y * sin(radians(10.0e0)) AS z FROM m)
SELECT id, round((degrees(atan2(y, x)) + 360 + 95) % 360, 5) AS mu, round(degrees(atan2(z, sqrt(x*x + y*y))), 5) + 0 AS nu FROM r"""
)
def stripe_coordinates(spark, d):
    mu, nu = sv.radec_to_munu("ra", "dec", 95.0, 10.0)
    return sky(spark, d, "customer").where("id > 0").select("id", F.round(mu, 5).alias("mu"), (F.round(nu, 5) + 0.0).alias("nu"))


@query(f"SELECT id, round(ra, 5) AS ra, round(dec, 5) + 0 AS dec FROM {SKY} WHERE id > 0")
def stripe_roundtrip(spark, d):
    mu, nu = sv.radec_to_munu("ra", "dec", 95.0, 10.0)
    t = sky(spark, d, "customer").where("id > 0").select("id", mu.alias("mu"), nu.alias("nu"))
    ra, dec = sv.munu_to_radec("mu", "nu", 95.0, 10.0)
    return t.select("id", F.round(ra, 5).alias("ra"), (F.round(dec, 5) + 0.0).alias("dec"))


@query(
    f"""WITH g AS (SELECT radians(192.8595e0) AS a, radians(27.12825e0) AS t, radians(32.932e0) AS l), sun AS (SELECT -sin(t) * cos(l) * cos(a) - sin(l) * sin(a) AS sx, sin(l) * cos(a) - sin(t) * cos(l) * sin(a) AS sy, cos(t) * cos(l) AS sz FROM g),
s AS (SELECT id, ra, dec, 1.0e0 + id % 5 AS dist, radians(ra + 3.0e0 / cos(radians(dec)) / 3.6e6) AS r2, radians(dec - 2.0e0 / 3.6e6) AS d2 FROM {SKY} WHERE id > 0),
m AS (SELECT id, ra, dec, dist * cos(d2) * cos(r2) - {sv.SUN_SPEED!r} * sx AS x, dist * cos(d2) * sin(r2) - {sv.SUN_SPEED!r} * sy AS y, dist * sin(d2) - {sv.SUN_SPEED!r} * sz AS z FROM s, sun),
n AS (SELECT id, dec, degrees(atan2(y, x)) - ra AS dra, degrees(atan2(z, sqrt(x * x + y * y))) AS dec3 FROM m)
SELECT id, round((dra - 360 * round(dra / 360)) * cos(radians(dec3)) * 3.6e6, 2) + 0 AS pm_ra, round((dec3 - dec) * 3.6e6, 2) + 0 AS pm_dec FROM n"""
)
def solar_motion_removed(spark, d):
    pm = sv.remove_solar_motion("ra", "dec", F.lit(1.0) + F.col("id") % 5, F.lit(3.0), F.lit(-2.0))
    return sky(spark, d, "customer").where("id > 0").select("id", (F.round(pm[0], 2) + 0.0).alias("pm_ra"), (F.round(pm[1], 2) + 0.0).alias("pm_dec"))


@query("SELECT c_custkey AS id, round(0.001e0 + u + 0.02e0 * r + 0.003e0 * u * v, 6) + 0 AS x, round(1.01e0 * v - 0.002e0 * r * r * r, 6) + 0 AS y FROM (SELECT *, sqrt(u * u + v * v) AS r FROM (SELECT c_custkey, c_custkey % 41 / 20.0e0 - 1 AS u, c_custkey % 37 / 18.0e0 - 1 AS v FROM customer))")
def tpv_distortion(spark, d):
    k = F.col("c_custkey")
    t = table(spark, d, "customer").select(k.alias("id"), (k % 41 / 20.0 - 1).alias("u"), (k % 37 / 18.0 - 1).alias("v"))
    x, y = sv.tpv_distort("u", "v", {0: 0.001, 1: 1.0, 3: 0.02, 5: 0.003}, {1: 1.01, 11: -0.002})
    return t.select("id", r6(x, "x"), r6(y, "y"))


@query(f"SELECT id, round(((ra + 180) % 360) - 180, 5) + 0 AS x, round(degrees(sin(radians(dec))), 5) + 0 AS y FROM {SKY}")
def equal_area_cylinder(spark, d):
    x, y = sv.cylindrical_equal_area("ra", "dec")
    return sky(spark, d, "customer").select("id", (F.round(x, 5) + 0.0).alias("x"), (F.round(y, 5) + 0.0).alias("y"))


@query(
    f"""WITH RECURSIVE t AS (SELECT id, radians(((ra + 180) % 360) - 180) AS lam, pi() * sin(radians(dec)) AS goal, -pi() / 2 AS low, pi() / 2 AS high, 0 AS n FROM {SKY} WHERE id > 0 UNION ALL
SELECT id, lam, goal, CASE WHEN low + high + sin(low + high) < goal THEN (low + high) / 2 ELSE low END, CASE WHEN low + high + sin(low + high) < goal THEN high ELSE (low + high) / 2 END, n + 1 FROM t WHERE n < 60)
SELECT id, round(2 * sqrt(2.0e0) / pi() * lam * cos(low), 5) + 0 AS x, round(sqrt(2.0e0) * sin(low), 5) + 0 AS y FROM t WHERE n = 60"""
)
def mollweide_projection(spark, d):
    """The SQL finds the auxiliary angle by halving an interval."""
    x, y = sv.mollweide("ra", "dec")
    return sky(spark, d, "customer").where("id > 0").select("id", (F.round(x, 5) + 0.0).alias("x"), (F.round(y, 5) + 0.0).alias("y"))


@query(
    """WITH e AS (SELECT quantile_cont(l_extendedprice, 0.02) AS a, quantile_cont(l_extendedprice, 0.98) AS b FROM lineitem),
c AS (SELECT least(floor((l_extendedprice - a) / (b - a) * 64), 63) AS bin, a, b, CAST(count(*) AS DOUBLE) AS w FROM lineitem, e WHERE l_extendedprice BETWEEN a AND b GROUP BY ALL),
u AS (SELECT a, b, (bin + 0.5e0) * (2.0e0 / 64) - 1 AS x, w, ln(w) AS y FROM c WHERE w >= 0.5e0 * (SELECT max(w) FROM c)),
s AS (SELECT any_value(a) AS a, any_value(b) AS b, min(x) AS l, max(x) AS r, sum(w) AS s0, sum(w*x) AS s1, sum(w*x*x) AS s2, sum(w*x*x*x) AS s3, sum(w*x*x*x*x) AS s4, sum(w*y) AS t0, sum(w*y*x) AS t1, sum(w*y*x*x) AS t2 FROM u),
d AS (SELECT a, b, l, r, s0 * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s3 * s2) + s2 * (s1 * t2 - t1 * s2) AS p, s0 * (s2 * t2 - t1 * s3) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s3 - s2 * s2) AS q FROM s)
SELECT round(a + (-p / (2 * q) + 1) / 2 * (b - a), 3) AS mode, q < 0 AND -p / (2 * q) BETWEEN l AND r AS bracketed FROM d"""
)
def brightness_mode(spark, d):
    """Mode of a column: a bell curve fitted to the histogram between two quantiles."""
    return tb.column_mode(table(spark, d, "lineitem"), "l_extendedprice").select(F.round("mode", 3).alias("mode"), "bracketed")


@query(
    """WITH p AS (SELECT l_partkey % 64 AS x, l_suppkey % 64 AS y, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2), d AS (SELECT abs(a.v - b.v) AS d FROM p a JOIN p b ON b.x = a.x + 5 AND b.y = a.y + 5)
SELECT count(*) AS n, round(quantile_cont(d, 0.5), 6) AS median_diff, round(avg(d * d), 4) AS mean_sq FROM d"""
)
def pixel_pair_noise(spark, d):
    """Differences of pixel pairs at a diagonal offset: an equi-join of the pixel table with itself."""
    p = table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 64).alias("x"), (F.col("l_suppkey") % 64).alias("y")).agg(F.sum("l_quantity").alias("v"))
    q = p.select((F.col("x") - 5).alias("x"), (F.col("y") - 5).alias("y"), F.col("v").alias("v2"))
    e = p.join(q, ["x", "y"]).select(F.abs(F.col("v") - F.col("v2")).alias("d"))
    return e.agg(F.count("*").alias("n"), F.round(F.percentile("d", F.lit(0.5)), 6).alias("median_diff"), F.round(F.avg(F.col("d") * F.col("d")), 4).alias("mean_sq"))


@query("SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50) AS spike FROM part")
def spike_flags(spark, d):
    """A table with a flag for the ids that a list of spikes holds."""
    bad = table(spark, d, "lineitem").where("l_quantity >= 50").select(F.col("l_partkey").alias("k")).distinct().withColumn("spike", F.lit(True))
    return table(spark, d, "part").join(bad, F.col("p_partkey") == F.col("k"), "left").select("p_partkey", F.coalesce("spike", F.lit(False)).alias("spike"))


@query("SELECT c_custkey AS hd, count(o_orderkey) AS n, min(o_orderkey) AS first_id FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def cross_identification(spark, d):
    """Identifiers of one catalogue joined to another's through a cross table."""
    j = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.groupBy(F.col("c_custkey").alias("hd")).agg(F.count("o_orderkey").alias("n"), F.min("o_orderkey").alias("first_id"))


@query(
    f"""WITH f AS (SELECT id, radians(ra) AS a, radians(dec) AS t FROM {sky_sql("supplier")} WHERE id > 0), v AS (SELECT *, cos(t) * cos(a) AS x, cos(t) * sin(a) AS y, sin(t) AS z FROM f),
k AS (SELECT unnest(range(-6, 7)) AS i), g AS (SELECT p.i * radians(0.5e0) AS u, q.i * radians(0.5e0) AS w FROM k p, k q WHERE greatest(abs(p.i), abs(q.i)) = 6 OR (p.i = 0 AND q.i = 0)),
e AS (SELECT id, x - u * sin(a) - w * sin(t) * cos(a) AS ex, y + u * cos(a) - w * sin(t) * sin(a) AS ey, z + w * cos(t) AS ez FROM v, g),
n AS (SELECT l.id AS l_id, r.id AS r_id FROM v l JOIN v r ON l.id < r.id AND l.x * r.x + l.y * r.y + l.z * r.z >= cos(radians(9.0e0))),
b AS (SELECT l_id, r_id, l_id AS p, r_id AS q FROM n UNION ALL SELECT l_id, r_id, r_id, l_id FROM n),
c AS (SELECT l_id, r_id, ex * x + ey * y + ez * z AS along, ey * cos(a) - ex * sin(a) AS east, ez * cos(t) - ex * sin(t) * cos(a) - ey * sin(t) * sin(a) AS north FROM b JOIN e ON e.id = p JOIN v ON v.id = q)
SELECT DISTINCT l_id, r_id FROM c WHERE along > 0 AND abs(east) <= along * radians(3.0e0) AND abs(north) <= along * radians(3.0e0)"""
)
def footprint_overlaps(spark, d):
    """Pairs of square footprints that meet: near centres by a sky join, then the exact outline test."""
    t = sky(spark, d, "supplier").where("id > 0")
    near = sj.sky_join(t, t, 9.0).where("l_id < r_id").select("l_id", "l_ra", "l_dec", "r_id", "r_ra", "r_dec")

    def run(batches):
        for pdf in batches:
            ok = np_boxes_overlap((pdf["l_ra"].to_numpy(), pdf["l_dec"].to_numpy()), (pdf["r_ra"].to_numpy(), pdf["r_dec"].to_numpy()), 6.0, 600)
            yield pdf.loc[ok, ["l_id", "r_id"]]

    return near.mapInPandas(run, "l_id long, r_id long")


@query(
    f"""SELECT id, round((1 + id % 7 / 2.0e0) * 3600 / (100 + id % 5 * 50), 6) AS scale, round((1 + id % 7 / 2.0e0) / sqrt(2.0e0), 6) AS radius, round(id % 90 * 1.0e0, 6) AS orientation, -1 AS parity, round(ra, 6) AS ra, round(dec, 6) + 0 AS dec
FROM {sky_sql("supplier")} WHERE id > 0"""
)
def header_properties(spark, d):
    """Scale, radius, orientation, parity and centre of turned square headers of several sizes about every position."""
    t = sky(spark, d, "supplier").where("id > 0")

    def run(batches):
        for pdf in batches:
            w = [box(ra, dec, 1 + k % 7 / 2, 100 + k % 5 * 50).rotated(k % 90) for k, ra, dec in zip(pdf["id"], pdf["ra"], pdf["dec"], strict=True)]
            rows = [(v.pixel_scale, v.radius, v.orientation, v.parity, *v.centre) for v in w]
            out = pd.DataFrame(rows, columns=["scale", "radius", "orientation", "parity", "ra", "dec"]).round(6) + 0
            yield out.assign(id=pdf["id"].to_numpy())

    return t.mapInPandas(run, "id long, scale double, radius double, orientation double, parity int, ra double, dec double")


@query()
def deduplicated_sources(spark, d):
    """Greedy de-duplication of every field, brightest first."""
    k = F.col("o_orderkey")
    t = table(spark, d, "orders").select(F.floor(F.col("o_custkey") / 10).alias("field"), k.alias("id"), (k * 7919 % 211).cast("double").alias("x"), (k * 104729 % 199).cast("double").alias("y"), "o_totalprice")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["o_totalprice", "id"], ascending=[False, True])
        return pdf.iloc[dedup_sources(pdf[["x", "y"]].to_numpy(), np.full(len(pdf), 12.0))][["field", "id"]]

    return t.groupBy("field").applyInPandas(run, "field long, id long")


@query("SELECT s_suppkey AS id, round(sqrt(1.0e0 + (s_suppkey % 3) * (s_suppkey % 3) + (s_suppkey % 11) * (s_suppkey % 11)), 6) AS norm, round(5.0e0 / (5 * (2 + s_suppkey % 5) - 2), 6) AS inv, CASE WHEN s_suppkey % 7 <> 1 THEN round(1.0e0 / (s_suppkey % 7 - 1), 6) END AS inv2 FROM supplier")
def small_matrices(spark, d):
    """Corners of inverses of full 3 x 3 and 2 x 2 matrices, null where a matrix is singular, and a norm."""
    k = F.col("s_suppkey")
    three = ph.invert_3by3([[2 + k % 5, 1, 0], [1, 3, 1], [0, 1, 2]])[0][0]
    two = ph.invert_2by2(k % 7, 2, 3, 6)[0]
    return table(spark, d, "supplier").select(k.alias("id"), F.round(ph.norm(F.array(F.lit(1.0), (k % 3).cast("double"), (k % 11).cast("double"))), 6).alias("norm"), F.round(three, 6).alias("inv"), F.round(two, 6).alias("inv2"))


@query(
    """WITH RECURSIVE g AS (SELECT k, k / 20.0e0 AS e, i * 2 * pi() / 64 AS m FROM (SELECT unnest(range(0, 4)) AS k), (SELECT unnest(range(0, 64)) AS i)), s AS (SELECT *, m AS b, 0 AS n FROM g UNION ALL SELECT k, e, m, b - (b - e * sin(b) - m) / (1 - e * cos(b)), n + 1 FROM s WHERE n < 20),
v AS (SELECT k, m, 10 * (cos(2 * atan2(sqrt(1 + e) * sin(b / 2), sqrt(1 - e) * cos(b / 2)) + 0.3e0) + e * cos(0.3e0)) AS v FROM s WHERE n = 20),
a AS (SELECT k, sqrt(pow(sum(v * cos(m)), 2) + pow(sum(v * sin(m)), 2)) / 32 AS a1, sqrt(pow(sum(v * cos(2 * m)), 2) + pow(sum(v * sin(2 * m)), 2)) / 32 AS a2 FROM v GROUP BY k)
SELECT s_suppkey AS id, round(a1, 3) AS first, round(a2 / a1, 3) + 0 AS ratio, k / 20.0e0 AS e FROM supplier JOIN a ON k = s_suppkey % 4"""
)
def velocity_harmonics(spark, d):
    """Amplitudes of the first two harmonics of radial-velocity curves, and the eccentricity that they tell."""

    def run(batches):
        for pdf in batches:
            rows = []
            for k in pdf["s_suppkey"]:
                e = (k % 4) / 20
                phase = np.linspace(0, 2 * np.pi, 64, endpoint=False)
                a = ph.fourier_amplitudes(phase, ph.radial_velocity(phase, 10.0, e, 0.3))
                rows.append((int(k), round(float(a[0]), 3), round(float(a[1] / a[0]), 3) + 0.0, e))
            yield pd.DataFrame(rows, columns=["id", "first", "ratio", "e"])

    return table(spark, d, "supplier").select("s_suppkey").mapInPandas(run, "id long, first double, ratio double, e double")


@query("SELECT doc_id, array_to_string(string_split(source, 'r'), '|') AS parts, '''' || replace(lang, '''', '''\\''''') || '''' AS quoted FROM documents")
def shell_words(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(F.split("source", "r"), "|").alias("parts"), ph.shell_escape("lang").alias("quoted"))


@query(
    """WITH RECURSIVE b AS (SELECT row_number() OVER () AS rid, item_id, string_split(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') AS ws FROM benchmark WHERE text IS NOT NULL),
t AS (SELECT rid, 1 AS i, '' AS line, NULL::VARCHAR AS done FROM b UNION ALL
SELECT t.rid, i + 1, CASE WHEN line = '' OR length(line) + 1 + length(ws[i]) > 60 THEN ws[i] ELSE line || ' ' || ws[i] END, CASE WHEN line <> '' AND length(line) + 1 + length(ws[i]) > 60 THEN line END FROM t JOIN b USING (rid) WHERE i <= len(ws))
SELECT item_id, done AS line FROM t JOIN b USING (rid) WHERE done IS NOT NULL UNION ALL SELECT item_id, line FROM t JOIN b USING (rid) WHERE i = len(ws) + 1"""
)
def wrapped_lines(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.explode(ph.split_long(F.regexp_replace("text", r"\s+", " "), 60)).alias("line"))


@query("SELECT o_orderkey, CAST(depth AS INT) AS depth FROM (SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 1 WHEN o_totalprice >= 200000 THEN 2 WHEN o_totalprice >= 100000 THEN 3 END AS depth FROM orders) WHERE depth IS NOT NULL")
def progressive_depths(spark, d):
    """Jobs tried at growing depths; what a shallower depth has solved is not tried again."""
    jobs, solved = table(spark, d, "orders").select("o_orderkey", "o_totalprice"), None
    for depth, least in enumerate((300000, 200000, 100000), 1):
        todo = jobs if solved is None else jobs.join(solved, "o_orderkey", "left_anti")
        got = todo.where(F.col("o_totalprice") >= least).select("o_orderkey", F.lit(depth).alias("depth"))
        solved = got if solved is None else solved.unionByName(got)
    return solved


@query(
    f"""WITH c AS (SELECT id, cell // 256 * 256 + list_sum([(cell // 16 % 16 // (1 << b)) % 2 * (1 << 2 * b) + (cell % 16 // (1 << b)) % 2 * (2 << 2 * b) FOR b IN range(0, 4)]) AS nested FROM {cell_sql(xyz_sql(SKY), 16)})
SELECT id, CAST(nested AS BIGINT) AS nested, row_number() OVER (ORDER BY nested, id) - 1 AS place FROM c"""
)
def locality_order(spark, d):
    """Places of stars sorted by nested cell, so that neighbours on the sky are stored together."""
    t = sky(spark, d, "customer").select("id", hp.xy_to_nested(hp.radec_to_cell("ra", "dec", 16), 16).alias("nested"))
    return tb.row_index(t, ["nested", "id"], "place").select("id", "nested", "place")


@query("SELECT event_type, bool_or(value > 90) AS any_high, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def merged_flags(spark, d):
    """Solved flags of several files merged by OR."""
    return table(spark, d, "events").groupBy("event_type").agg(F.bool_or(F.col("value") > 90).alias("any_high"), F.countDistinct("user_id").alias("users"))


@query("SELECT star, list(quad ORDER BY quad) AS quads FROM (SELECT s_suppkey AS quad, unnest([s_suppkey, s_suppkey % 10 + 1, s_suppkey // 7 + 2]) AS star FROM supplier) GROUP BY 1")
def inverted_index(spark, d):
    """Star to quads: explode, group, sorted arrays."""
    k = F.col("s_suppkey")
    return gh.star_to_quads(table(spark, d, "supplier").select(k.alias("quad_id"), F.array(k, k % 10 + 1, F.floor(k / 7) + 2).alias("stars")))


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1 HAVING count(*) > 0")
def group_statistics(spark, d):
    t = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("m"))
    return t.select("user_id", "n", F.round(let(F.col("m"), lambda v: v), 6).alias("mean"))


