"""Annotation, lookup and polygon queries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from starloom.functions import healpix as hp
from starloom.operators import polygons as pg
from starloom.operators import spatial as sj
from starloom.plans.registry import query, sky, sky_sql, table, xyz_sql
from starloom.plans.scalars import HEADER, cell_sql, tan_sql


@query(f"SELECT t.id, c_name || ' (' || c_mktsegment || ')' AS label, round(px, 3) + 0 AS px, round(py, 3) + 0 AS py FROM {tan_sql()} t JOIN customer ON c_custkey = t.id WHERE px BETWEEN 0.5 AND 1024.5 AND py BETWEEN 0.5 AND 1024.5 ORDER BY c_acctbal DESC, t.id LIMIT 30")
def annotate_field(spark, d):
    """Brightest catalogue objects in a footprint with labels."""
    px, py = HEADER.radec_to_pixel("ra", "dec")
    t = sky(spark, d, "customer", "c_name", "c_mktsegment", "c_acctbal").where(HEADER.contains("ra", "dec")).orderBy(F.col("c_acctbal").desc(), "id").limit(30)
    return t.select("id", F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit(")")).alias("label"), (F.round(px, 3) + 0.0).alias("px"), (F.round(py, 3) + 0.0).alias("py"))


@query("SELECT p_partkey, p_name FROM part WHERE lower(replace(p_name, ' ', '')) IN (SELECT lower(replace(p_name, ' ', '')) FROM part WHERE p_partkey % 50 = 0)")
def name_lookup(spark, d):
    """Objects by name, spaces and case ignored."""
    key = F.lower(F.replace("p_name", F.lit(" "), F.lit("")))
    t = table(spark, d, "part").withColumn("k", key)
    return t.join(t.where("p_partkey % 50 = 0").select("k").distinct(), "k", "left_semi").select("p_partkey", "p_name")


SC = xyz_sql(sky_sql("supplier"))
CC = xyz_sql(sky_sql("customer"))
SEP = "degrees(2 * asin(least(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) / 2, 1)))"


@query(f"SELECT a.id AS target, b.id % 7 AS run, b.id % 5 AS camcol, b.id AS field FROM {SC} a JOIN {CC} b ON {SEP} <= 3")
def sky_to_field(spark, d):
    """Survey fields (run, camera column, field) whose centre is near a position."""
    # the right side is the one that is copied to the buckets around
    p = sj.sky_join(sky(spark, d, "customer"), sky(spark, d, "supplier"), 3.0)
    return p.select(F.col("r_id").alias("target"), (F.col("l_id") % 7).alias("run"), (F.col("l_id") % 5).alias("camcol"), F.col("l_id").alias("field"))


@query(f"SELECT t.id, round(px, 3) + 0 AS px, round(py, 3) + 0 AS py FROM {tan_sql()} t JOIN customer ON c_custkey = t.id WHERE px BETWEEN -49.5 AND 1074.5 AND py BETWEEN -49.5 AND 1074.5 AND (CAST(c_custkey AS BIGINT) & 4) <> 0")
def primaries_in_footprint(spark, d):
    """Rows of the partitions under a footprint with a pixel margin, by a status bit."""
    px, py = HEADER.radec_to_pixel("ra", "dec")
    t = sky(spark, d, "customer").select("id", px.alias("px"), py.alias("py")).where("px BETWEEN -49.5 AND 1074.5 AND py BETWEEN -49.5 AND 1074.5")
    return t.where(F.col("id").bitwiseAND(F.lit(4).cast("long")) != 0).select("id", (F.round("px", 3) + 0.0).alias("px"), (F.round("py", 3) + 0.0).alias("py"))


@query("SELECT i AS id, x, y, (x + y <= 10 AND x >= 0 AND y >= 0 AND x <= 6) AS inside FROM (SELECT c_custkey AS i, (c_custkey * 13 % 97) / 8.0e0 - 0.4e0 AS x, (c_custkey * 29 % 89) / 8.0e0 - 0.3e0 AS y FROM customer)")
def point_in_polygon(spark, d):
    xs, ys = F.array(*[F.lit(v) for v in (0.0, 6.0, 6.0, 0.0)]), F.array(*[F.lit(v) for v in (0.0, 0.0, 4.0, 10.0)])
    k = F.col("c_custkey")
    t = table(spark, d, "customer").select(k.alias("id"), ((k * 13 % 97) / 8.0 - 0.4).alias("x"), ((k * 29 % 89) / 8.0 - 0.3).alias("y"))
    return t.select("id", "x", "y", pg.point_in_polygon("x", "y", xs, ys).alias("inside"))


@query("SELECT s_suppkey AS id, round(w * h, 6) AS area, round(w / 2.0e0, 6) AS cx, round(h / 2.0e0, 6) AS cy FROM (SELECT s_suppkey, 1.0e0 + s_suppkey % 7 AS w, 2.0e0 + s_suppkey % 3 AS h FROM supplier)")
def polygon_measures(spark, d):
    """Area of a rectangle and the crossing of its diagonals."""
    k = F.col("s_suppkey")
    t = table(spark, d, "supplier").select(k.alias("id"), (1.0 + k % 7).alias("w"), (2.0 + k % 3).alias("h"))
    zero = F.lit(0.0)
    cx, cy = pg.line_intersection((zero, zero), ("w", "h"), ("w", zero), (zero, "h"))
    return t.select("id", F.round(pg.polygon_area(F.array(zero, F.col("w"), F.col("w"), zero), F.array(zero, zero, F.col("h"), F.col("h"))), 6).alias("area"), F.round(cx, 6).alias("cx"), F.round(cy, 6).alias("cy"))


@query()
def clipped_polygons(spark, d):
    """Area of triangles clipped to the unit square, and whether they meet it."""

    def run(batches):
        square = np.array([(0, 0), (1, 0), (1, 1), (0, 1)], float)
        for pdf in batches:
            rows = []
            for k in pdf["s_suppkey"]:
                t = np.array([(-0.5 + k % 5 * 0.4, -0.2), (1.2, k % 3 * 0.5), (0.3, 1.4 - k % 7 * 0.2)])
                c = pg.np_clip(t, square)
                area = 0.0 if len(c) < 3 else 0.5 * abs(float(np.dot(c[:, 0], np.roll(c[:, 1], -1)) - np.dot(c[:, 1], np.roll(c[:, 0], -1))))
                rows.append((int(k), round(area, 6), pg.np_intersect(t, square)))
            yield pd.DataFrame(rows, columns=["id", "area", "meets"])

    return table(spark, d, "supplier").select("s_suppkey").mapInPandas(run, "id long, area double, meets boolean")


@query(f"SELECT c.id, c.cell AS region, r.name FROM {cell_sql(CC, 2)} c JOIN (SELECT i AS cell, 'region ' || i AS name FROM range(48) t(i)) r USING (cell)")
def region_of_position(spark, d):
    """The named sky region that holds each position: a bucket join with a small table."""
    names = spark.range(48).select(F.col("id").alias("region"), F.concat(F.lit("region "), F.col("id").cast("string")).alias("name"))
    t = sky(spark, d, "customer").select("id", hp.radec_to_cell("ra", "dec", 2).alias("region"))
    return t.join(F.broadcast(names), "region").select("id", "region", "name")


@query(f"SELECT id FROM (SELECT s_suppkey AS id, s_suppkey % 20 * 3.0e0 AS lo, s_suppkey % 20 * 3.0e0 + 5 AS hi FROM supplier) WHERE NOT (lo > 30 OR hi < 12)")
def scale_overlap(spark, d):
    """Indexes whose scale interval overlaps the asked one."""
    k = F.col("s_suppkey")
    t = table(spark, d, "supplier").select(k.alias("id"), (k % 20 * 3.0).alias("lo"), (k % 20 * 3.0 + 5).alias("hi"))
    return t.where("NOT (lo > 30 OR hi < 12)").select("id")


@query()
def cells_near_position(spark, d):
    """Indexes (cells) within 20 degrees of a position."""
    return spark.range(12 * 4 * 4).select(F.col("id").alias("cell"), F.round(hp.distance(4)("id", F.lit(72.0), F.lit(37.0)), 6).alias("deg")).where("deg <= 20")
