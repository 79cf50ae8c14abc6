"""Queries over tiled images whose pixels are sums over line items."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from starloom.functions.wcs import Wcs
from starloom.operators import tiles as tl
from starloom.plans.registry import query, table

WIDE, HIGH, TILE = 100, 70, 32
X, Y, IMAGE = "(l_orderkey * 7 + l_linenumber * 13) % 100", "(l_partkey * 31 + l_suppkey * 3) % 70", "l_linenumber % 2"
PIXELS = f"SELECT {IMAGE} AS image, {X} AS x, {Y} AS y, CAST(sum(floor(l_quantity)) % 251 AS DOUBLE) AS v FROM lineitem GROUP BY ALL"
#: all pixels of both images, also those without line items
FULL = f"SELECT i.image, gx.x, gy.y, coalesce(p.v, 0.0e0) AS v FROM (SELECT DISTINCT image FROM ({PIXELS})) i, (SELECT unnest(range({WIDE})) AS x) gx, (SELECT unnest(range({HIGH})) AS y) gy LEFT JOIN ({PIXELS}) p ON p.image = i.image AND p.x = gx.x AND p.y = gy.y"


def image_tiles(spark, d):
    p = table(spark, d, "lineitem").groupBy(F.expr(IMAGE).cast("long").alias("image"), F.expr(X).alias("x"), F.expr(Y).alias("y")).agg((F.sum(F.floor("l_quantity")) % 251).cast("double").alias("v"))
    return tl.cut(p, WIDE, HIGH, TILE)


def _pixels(tiles):
    return tl.to_pixels(tiles, TILE).select("image", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "v")


@query(
    f"""WITH f AS ({FULL}), k AS (SELECT a.k AS dx, b.k AS dy FROM (SELECT unnest(range(-2, 3)) AS k) a, (SELECT unnest(range(-2, 3)) AS k) b)
SELECT o.image, o.x, o.y, median(n.v) AS v FROM f o, k JOIN f n ON n.image = o.image AND n.x = least(greatest(o.x + dx, 0), {WIDE - 1}) AND n.y = least(greatest(o.y + dy, 0), {HIGH - 1}) GROUP BY ALL"""
)
def tiled_median(spark, d):
    """Median filter of radius 2 over tiles with halos."""
    return _pixels(tl.median(image_tiles(spark, d), 2, WIDE, HIGH, TILE))


@query(f"WITH f AS ({FULL}) SELECT image, CAST(x // {TILE} AS INT) AS tx, CAST(y // {TILE} AS INT) AS ty, round(sum(v), 6) AS total, max(v) AS high FROM f GROUP BY ALL")
def tile_sums(spark, d):
    """Sum and maximum of every tile's pixels."""
    t = image_tiles(spark, d)
    return t.select("image", "tx", "ty", F.round(F.aggregate("pixels", F.lit(0.0), lambda a, v: a + v), 6).alias("total"), F.array_max("pixels").alias("high"))


@query(
    f"""WITH f AS ({FULL}), k AS (SELECT unnest(range(0, {WIDE}, 12)) AS nx), g AS (SELECT unnest(range(0, {HIGH}, 12)) AS ny)
SELECT image, CAST(nx AS BIGINT) AS x, CAST(ny AS BIGINT) AS y, median(v) AS v FROM f, k, g WHERE abs(f.x - nx) <= 12 AND abs(f.y - ny) <= 12 GROUP BY ALL"""
)
def background_nodes(spark, d):
    """Background of medians on a grid of step 12, at the nodes of the grid, where it is the median of the box itself."""
    return _pixels(tl.background(image_tiles(spark, d), 12, WIDE, HIGH, TILE)).where("x % 12 = 0 AND y % 12 = 0")


#: the target turns the source by 20 degrees about a point, at 0.7 of its scale
TURN, SHRINK = 20.0, 0.7
SOURCE = Wcs((40.0, 10.0), (50.5, 35.5), ((-0.001, 0.0), (0.0, 0.001)), WIDE, HIGH)
C, S = (float(f(np.radians(TURN))) * 0.001 * SHRINK for f in (np.cos, np.sin))
TARGET = Wcs((40.0, 10.0), (60.5, 40.5), ((-C, S), (S, C)), 120, 90)
IN_X = f"(50.5e0 + ((tx + 1 - 60.5e0) * {C!r}e0 - (ty + 1 - 40.5e0) * {S!r}e0) / 0.001e0 - 1)"
IN_Y = f"(35.5e0 + ((tx + 1 - 60.5e0) * {S!r}e0 + (ty + 1 - 40.5e0) * {C!r}e0) / 0.001e0 - 1)"


@query(
    f"""WITH f AS ({FULL}), t AS (SELECT a.k AS tx, b.k AS ty FROM (SELECT unnest(range(120)) AS k) a, (SELECT unnest(range(90)) AS k) b), m AS (SELECT tx, ty, round({IN_X}) AS sx, round({IN_Y}) AS sy FROM t)
SELECT image, tx AS x, ty AS y, v FROM m JOIN f ON f.x = sx AND f.y = sy"""
)
def resampled_nearest(spark, d):
    """Images resampled onto a turned and finer grid, nearest pixels; where the source does not reach, none."""
    return _pixels(tl.resample(image_tiles(spark, d), SOURCE, TARGET, 0, TILE)).where("v IS NOT NULL")
