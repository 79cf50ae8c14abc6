"""Saved star indexes: reopened, searched, merged."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.operators.checkpoints import scratch_folder
from starloom.plans.registry import query, r6, sky, sky_sql, xyz_sql
from starloom.sources import starindex as si

CONES = ((72.0, 37.0, 15.0), (200.0, -60.0, 12.0), (0.5, 5.0, 9.0))
SEVERAL = sky_sql("customer", "c_acctbal AS bal"), sky_sql("supplier", "s_acctbal AS bal")


def _far(ra: float, dec: float) -> str:
    """Squared chord from a position in SQL."""
    x, y, z = f"cos(radians({dec}e0)) * cos(radians({ra}e0))", f"cos(radians({dec}e0)) * sin(radians({ra}e0))", f"sin(radians({dec}e0))"
    return f"((x - {x}) * (x - {x}) + (y - {y}) * (y - {y}) + (z - {z}) * (z - {z}))"


def _near(ra: float, dec: float, radius: float) -> str:
    return f"{_far(ra, dec)} <= (2 * sin(radians({radius}e0) / 2)) * (2 * sin(radians({radius}e0) / 2))"


def saved(spark, d, name: str, bal: str, rows_per_file: int = 100_000, least_files: int = 16) -> si.StarIndex:
    """An index of one table's positions, in files of a size, or in more of them where the table is small."""
    stars = sky(spark, d, name, F.col(bal).alias("bal"))
    return si.save(stars, scratch_folder(spark, "index"), max(1, min(rows_per_file, stars.count() // least_files)))


@query(f"SELECT id, bal, round(degrees(2 * asin(least(sqrt({_far(72.0, 37.0)}) / 2, 1))), 6) AS sep FROM {xyz_sql(SEVERAL[0])} WHERE {_near(*CONES[0])}")
def index_cone_search(spark, d):
    """A cone in a saved index, opened again, with a column stored along."""
    path = saved(spark, d, "customer", "c_acctbal").path
    return si.open_index(spark, path).cone(*CONES[0], columns=["bal"]).select("id", "bal", r6("sep", "sep"))


@query(f"SELECT part, id, bal FROM (SELECT 0 AS part, * FROM {xyz_sql(SEVERAL[0])} UNION ALL SELECT 1, * FROM {xyz_sql(SEVERAL[1])}) WHERE {' OR '.join(_near(*c) for c in CONES)}")
def merged_index_search(spark, d):
    """Several cones in one index merged of two by their manifests."""
    paths = [saved(spark, d, n, b).path for n, b in (("customer", "c_acctbal"), ("supplier", "s_acctbal"))]
    whole = si.merge(spark, paths, scratch_folder(spark, "index"))
    return whole.cones(CONES, ["bal"]).select("part", "id", "bal")


@query(f"SELECT id, CAST(row_number() OVER (ORDER BY f, id) AS INT) AS rank, round(degrees(2 * asin(least(sqrt(f) / 2, 1))), 6) AS sep FROM (SELECT id, {_far(200.0, -60.0)} AS f FROM {xyz_sql(SEVERAL[0])}) ORDER BY f, id LIMIT 25")
def index_nearest(spark, d):
    """The nearest stars of a position, by the bounds of files first."""
    from pyspark.sql import Window

    found = saved(spark, d, "customer", "c_acctbal").nearest(200.0, -60.0, 25)
    return found.select("id", F.row_number().over(Window.orderBy("sep", "id")).alias("rank"), r6("sep", "sep"))


@query(f"SELECT count(*) AS n, count(DISTINCT id) AS ids, 0 AS first_star, count(*) - 1 AS last_star, round(min(x), 6) AS low, round(max(x), 6) AS high FROM {xyz_sql(SEVERAL[0])}")
def index_permutation(spark, d):
    """Size and bounding box by the manifest alone, and the permutation from places along the curve back to ids."""
    index = saved(spark, d, "customer", "c_acctbal")
    low, high = index.box()["x"]
    p = index.permutation()
    return p.agg(F.lit(index.n).alias("n"), F.count_distinct("id").alias("ids"), F.min("star").alias("first_star"), F.max("star").alias("last_star")).select("*", F.round(F.lit(low), 6).alias("low"), F.round(F.lit(high), 6).alias("high"))
