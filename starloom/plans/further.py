"""Dereferencing, universal filters, even ordering for verification, PSF models, exports, polling, bounds, partitions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from starloom.functions.sphere import dec_to_dms, ra_to_hms, within_radius
from starloom.functions.wcs import box
from starloom.operators import geohash as gh
from starloom.operators import images as im
from starloom.operators.checkpoints import scratch_folder
from starloom.plans.registry import r6, query, sky, sky_sql, table, xyz_sql
from starloom.streaming import jobs

SUPP = sky_sql("supplier")
TRIPLES = "SELECT s_suppkey AS quad, [s_suppkey, s_suppkey % 10 + 1, s_suppkey % 7 + 2] AS stars FROM supplier"


def _triples(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("quad"), F.array(k, k % 10 + 1, k % 7 + 2).alias("stars"))


@query(f"WITH q AS ({TRIPLES}), p AS (SELECT quad, unnest(range(0, 3)) AS pos, unnest(stars) AS star FROM q) SELECT quad, list(star ORDER BY pos) AS ids, round(sum(dec), 5) + 0 AS dec_sum FROM p JOIN {SUPP} s ON s.id = star GROUP BY quad")
def quad_dereference(spark, d):
    """Star records of every quad, in the quad's order."""
    t = gh.dereference(_triples(spark, d), sky(spark, d, "supplier"))
    return t.select("quad", F.col("star_list.id").alias("ids"), (F.round(F.aggregate("star_list.dec", F.lit(0.0), lambda a, v: a + v), 5) + 0.0).alias("dec_sum"))


NEAR = "x * (cos(radians(37.0e0)) * cos(radians(72.0e0))) + y * (cos(radians(37.0e0)) * sin(radians(72.0e0))) + z * sin(radians(37.0e0)) >= cos(radians(120.0e0))"


@query(f"WITH q AS ({TRIPLES}), p AS (SELECT quad, unnest(stars) AS star FROM q) SELECT quad FROM p JOIN {xyz_sql(SUPP)} s ON s.id = star GROUP BY quad HAVING bool_and({NEAR})")
def all_stars_in_cone(spark, d):
    """Quads all of whose stars lie in a cone."""
    t = _triples(spark, d).select("quad", F.explode("stars").alias("id")).join(sky(spark, d, "supplier"), "id")
    return t.groupBy("quad").agg(F.bool_and(within_radius("ra", "dec", 72.0, 37.0, 120.0)).alias("ok")).where("ok").select("quad")


@query("WITH b AS (SELECT o_orderkey AS id, CAST(floor(o_orderkey * 7919 % 1000 / 250) AS BIGINT) AS bx, CAST(floor(o_orderkey * 104729 % 1000 / 250) AS BIGINT) AS b_y, o_totalprice FROM orders) SELECT id, bx, b_y, CAST(row_number() OVER (PARTITION BY b_y, bx ORDER BY o_totalprice DESC, id) AS INT) AS round FROM b")
def verification_order(spark, d):
    """Order of test stars by (round, row of bins, bin): the rank of each within its bin."""
    k = F.col("o_orderkey")
    t = table(spark, d, "orders").select(k.alias("id"), F.floor(k * 7919 % 1000 / 250).alias("bx"), F.floor(k * 104729 % 1000 / 250).alias("b_y"), "o_totalprice")
    return t.select("id", "bx", "b_y", F.row_number().over(Window.partitionBy("b_y", "bx").orderBy(F.col("o_totalprice").desc(), "id")).alias("round"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey BETWEEN 1 AND 500")
def valid_fields(spark, d):
    """Field numbers outside the file's range are left out."""
    return table(spark, d, "orders").where(F.col("o_custkey").between(1, 500)).select("o_orderkey")


@query(
    """WITH g AS (SELECT exp(-0.5e0 * (i * i + j * j)) AS one, exp(-0.125e0 * (i * i + j * j)) AS two, exp(-(i * i + j * j) / 18.0e0) AS three, i, j FROM (SELECT unnest(range(-5, 6)) AS i), (SELECT unnest(range(-5, 6)) AS j)),
w AS (SELECT s_suppkey AS id, 1 + 0.2e0 * (s_suppkey * 7 % 2048) / 1000 + 0.1e0 * (s_suppkey * 13 % 1489) / 1000 AS a, 0.05e0 + 0.01e0 * (s_suppkey * 7 % 2048) / 1000 * (s_suppkey * 13 % 1489) / 1000 AS b FROM supplier)
SELECT id, round(sum(a * one + b * two), 5) AS psf_sum, round(sum(one + 0.1e0 * three) / 1.1e0, 5) AS gauss_sum, round(sum(CASE WHEN i = 0 AND j BETWEEN 0 AND 2 THEN 1 / ((100 * (a * one + b * two) + 50) / 4 + 1) END), 5) AS invvar FROM w, g GROUP BY id"""
)
def psf_models(spark, d):
    """Point-spread functions at positions: eigen-images, double Gaussians, inverse variances, as digests."""

    def run(batches):
        yy, xx = np.mgrid[-5:6, -5:6]
        r = np.hypot(xx, yy)
        eigen = np.stack([np.exp(-0.5 * (r / s) ** 2) for s in (1.0, 2.0)])
        coeff = np.array([[[1.0, 0.1], [0.2, 0.0]], [[0.05, 0.0], [0.0, 0.01]]])
        for pdf in batches:
            rows = []
            for k in pdf["s_suppkey"]:
                p = im.psf_at(eigen, coeff, float(k * 7 % 2048), float(k * 13 % 1489))
                rows.append((int(k), round(float(p.sum()), 5), round(float(im.double_gaussian(r, 1.0, 3.0, 0.1).sum()), 5), round(float(im.inverse_variance(np.full(3, 50.0), p[5, 5:8] * 100, 4.0, 1.0).sum()), 5)))
            yield pd.DataFrame(rows, columns=["id", "psf_sum", "gauss_sum", "invvar"])

    return table(spark, d, "supplier").select("s_suppkey").mapInPandas(run, "id long, psf_sum double, gauss_sum double, invvar double")


@query(f"SELECT id, ra AS x_world, dec AS y_world, 1.0e0 / 3600 AS err_a, c_acctbal AS mag FROM {sky_sql('customer', 'c_acctbal')} WHERE dec > 0")
def reference_catalogue_export(spark, d):
    """Columns and units of an astrometric reference catalogue."""
    return sky(spark, d, "customer", "c_acctbal").where("dec > 0").select("id", F.col("ra").alias("x_world"), F.col("dec").alias("y_world"), F.lit(1.0 / 3600).alias("err_a"), F.col("c_acctbal").alias("mag"))


@query(
    f"""WITH m AS (SELECT id, dec < 0 AS south, CAST(floor(((ra % 360) + 360) % 360 / 15 * 3600000 + 0.5e0) AS BIGINT) % 86400000 AS a, CAST(floor(abs(dec) * 3600000 + 0.5e0) AS BIGINT) AS t FROM {SUPP} WHERE id > 0)
SELECT id, format('{{}}\t{{:02d}}:{{:02d}}:{{:02d}}.{{:03d}}\t{{}}{{:02d}}:{{:02d}}:{{:02d}}.{{:03d}}', id, a // 3600000, a // 60000 % 60, a // 1000 % 60, a % 1000, CASE WHEN south THEN '-' ELSE '+' END, t // 3600000, t // 60000 % 60, t // 1000 % 60, t % 1000) AS line FROM m"""
)
def planetarium_export(spark, d):
    """Text lines of a planetarium catalogue."""
    t = sky(spark, d, "supplier").where("id > 0")
    return t.select("id", F.concat_ws("\t", F.col("id").cast("string"), ra_to_hms("ra"), dec_to_dms("dec")).alias("line"))


@query("SELECT event_id FROM events WHERE event_type = 'signup'")
def queue_poll(spark, d):
    """New rows handed over batch by batch by a polling stream, progress kept in its checkpoint."""
    folder = scratch_folder(spark, "queue")
    stream = jobs.events(spark, d, table(spark, d, "events").schema).where("event_type = 'signup'").select("event_id")
    jobs.poll_queue(stream, lambda df, _: df.write.mode("append").parquet(f"{folder}/done"), f"{folder}/state", once=True).awaitTermination()
    return spark.read.schema("event_id long").parquet(f"{folder}/done")


@query(
    f"""WITH f AS (SELECT id, ra, radians(dec) AS t, radians(id % 90) AS o FROM {SUPP} WHERE abs(dec) < 70), k AS (SELECT unnest(range(-2, 3)) AS i), g AS (SELECT p.i * radians(0.5e0) AS u, q.i * radians(0.5e0) AS w FROM k p, k q WHERE greatest(abs(p.i), abs(q.i)) = 2),
e AS (SELECT id, ra, t, w * sin(o) - u * cos(o) AS east, u * sin(o) + w * cos(o) AS north FROM f, g), x AS (SELECT id, ra, atan2(east, cos(t) - north * sin(t)) AS da, atan2(sin(t) + north * cos(t), sqrt(east * east + pow(cos(t) - north * sin(t), 2))) AS dd FROM e)
SELECT id, round(ra + degrees(min(da)), 4) + 0 AS ramin, round(ra + degrees(max(da)), 4) + 0 AS ramax, round(degrees(min(dd)), 4) + 0 AS decmin, round(degrees(max(dd)), 4) + 0 AS decmax, round(sqrt(2.0e0), 4) AS radius, round(id % 90 * 1.0e0, 3) AS orientation, -1 AS parity FROM x GROUP BY id, ra"""
)
def footprint_bounds(spark, d):
    """RA and Dec bounds, radius and orientation of square footprints about positions."""

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                w = box(r.ra, r.dec, 2.0, 200).rotated(float(r.id % 90))
                rows.append((r.id, *[round(v, 4) + 0.0 for v in w.radec_bounds()], round(w.radius, 4), round(w.orientation, 3) + 0.0, w.parity))
            yield pd.DataFrame(rows, columns=["id", "ramin", "ramax", "decmin", "decmax", "radius", "orientation", "parity"])

    return sky(spark, d, "supplier").where("abs(dec) < 70").select("id", "ra", "dec").mapInPandas(run, "id long, ramin double, ramax double, decmin double, decmax double, radius double, orientation double, parity int")


@query("SELECT o_orderkey, o_custkey % 3 AS run, o_orderkey % 6 + 1 AS camcol FROM orders WHERE o_custkey % 3 = 1 AND o_orderkey % 6 + 1 = 4")
def survey_partitions(spark, d):
    """Survey objects stored by run and camera column; one partition is read."""
    path = scratch_folder(spark, "survey")
    t = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 3).alias("run"), (F.col("o_orderkey") % 6 + 1).alias("camcol"))
    t.write.partitionBy("run", "camcol").parquet(path)
    r = spark.read.schema("o_orderkey long, run long, camcol long").parquet(path)
    return r.where("run = 1 AND camcol = 4")


#: three multiplicative hashes of the key below a prime, so that a row's draw needs no other row and no partition order
DRAWS = tuple(f"((s_suppkey % 1000003 * (s_suppkey % 1000003) * {m} + s_suppkey % 1000003 * {n} + {c}) % 1000003 + 0.5e0) / 1000003e0" for m, n, c in ((97, 50021, 11), (193, 77773, 5003), (389, 15013, 70001)))
RA_DRAW, DEC_DRAW, JITTER = f"360.0e0 * ({DRAWS[0]})", f"degrees(asin(2.0e0 * ({DRAWS[1]}) - 1.0e0))", f"sqrt(-2.0e0 * ln({DRAWS[2]})) * cos(2.0e0 * pi() * ({DRAWS[0]}))"


@query(f"SELECT s_suppkey AS id, round({RA_DRAW}, 6) AS ra, round({DEC_DRAW}, 6) + 0 AS dec, round({JITTER}, 6) + 0 AS jitter FROM supplier")
def random_sky(spark, d):
    """Seeded positions, even over the sphere, and a normal deviate each: the same on every run, whatever the partitions."""
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.round(F.expr(RA_DRAW), 6).alias("ra"), r6(F.expr(DEC_DRAW), "dec"), r6(F.expr(JITTER), "jitter"))
