"""Distance-join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.functions.sphere import radec_to_xyz, within_radius
from starloom.operators import blocks as bl
from starloom.operators import spatial as sj
from starloom.operators.metric import metric_join, metric_nearest
from starloom.plans.registry import query, r6, sky, sky_sql, table, xyz_sql

CUST, SUPP = xyz_sql(sky_sql("customer")), xyz_sql(sky_sql("supplier"))
D2 = "((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z))"
CHORD2 = lambda deg: f"(2 * sin(radians({deg}e0) / 2)) * (2 * sin(radians({deg}e0) / 2))"
SEP = f"degrees(2 * asin(least(sqrt({D2}) / 2, 1)))"


def pairs_sql(left: str, right: str, deg: float) -> str:
    return f"(SELECT a.id AS l_id, b.id AS r_id, {SEP} AS sep FROM {left} a JOIN {right} b ON {D2} <= {CHORD2(deg)})"


@query(f"SELECT l_id, r_id, round(sep, 6) AS sep FROM {pairs_sql(CUST, SUPP, 5.0)}")
def xmatch_radec(spark, d):
    return bl.sky_pairs(sky(spark, d, "customer"), sky(spark, d, "supplier"), 5.0)


@query(f"SELECT l_id, r_id, round(sep, 6) AS sep FROM {pairs_sql(CUST, CUST, 2.0)} WHERE l_id <> r_id")
def xmatch_notself(spark, d):
    return bl.sky_pairs(sky(spark, d, "customer"), sky(spark, d, "customer"), 2.0, differ=True)


@query(f"SELECT l_id, arg_min(r_id, (sep, r_id)) AS r_id, round(min(sep), 6) AS sep FROM {pairs_sql(CUST, SUPP, 5.0)} GROUP BY l_id")
def xmatch_nearest(spark, d):
    return sj.k_nearest_within(sky(spark, d, "customer"), sky(spark, d, "supplier"), 5.0, 1, sj.nearest).select("l_id", "r_id", r6("sep", "sep"))


@query(f"SELECT l_id, arg_min(r_id, (sep, r_id)) AS r_id, round(min(sep), 6) AS sep, count(*) AS n FROM {pairs_sql(CUST, SUPP, 8.0)} GROUP BY l_id")
def xmatch_count(spark, d):
    near = sj.k_nearest_within(sky(spark, d, "customer"), sky(spark, d, "supplier"), 8.0, 1, sj.nearest)
    return near.join(sj.count_within(sky(spark, d, "customer"), sky(spark, d, "supplier"), 8.0), "l_id").select("l_id", "r_id", r6("sep", "sep"), "n")


@query(f"SELECT c.c_custkey AS l_id, p.ids FROM customer c LEFT JOIN (SELECT l_id, list(r_id ORDER BY r_id) AS ids FROM {pairs_sql(CUST, SUPP, 5.0)} GROUP BY l_id) p ON p.l_id = c.c_custkey")
def xmatch_list(spark, d):
    return bl.all_sky_lists(sky(spark, d, "customer"), sky(spark, d, "supplier"), 5.0)


@query(f"SELECT l_id, r_id, round(sep, 6) AS sep FROM (SELECT a.id AS l_id, b.id AS r_id, {SEP} AS sep FROM {CUST} a JOIN {SUPP} b ON {D2} <= {CHORD2(6.0)} AND {D2} >= {CHORD2(3.0)})")
def xmatch_annulus(spark, d):
    return bl.sky_pairs(sky(spark, d, "customer"), sky(spark, d, "supplier"), 6.0, 3.0)


@query(f"SELECT count(*) AS n, round(sum(sep), 3) AS total FROM {pairs_sql(CUST, CUST, 3.0)} WHERE l_id < r_id")
def xmatch_count_only(spark, d):
    return bl.sky_pair_totals(sky(spark, d, "customer"), sky(spark, d, "customer"), 3.0).select("n", F.round("total", 3).alias("total"))


FLAT = lambda t, k: f"(SELECT {k} AS id, CAST({k} * 7919 % 2048 AS DOUBLE) AS x, CAST({k} * 104729 % 2048 AS DOUBLE) AS y FROM {t})"


@query(f"SELECT a.id AS l_id, b.id AS r_id, round(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)), 6) AS dist FROM {FLAT('customer', 'c_custkey')} a JOIN {FLAT('supplier', 's_suppkey')} b ON (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) <= 400")
def match_xy(spark, d):
    flat = lambda t, k, p: table(spark, d, t).select(F.col(k).alias(f"{p}_id"), (F.col(k) * 7919 % 2048).cast("double").alias(f"{p}x"), (F.col(k) * 104729 % 2048).cast("double").alias(f"{p}y"))
    return sj.range_join(flat("customer", "c_custkey", "l"), flat("supplier", "s_suppkey", "r"), 20.0, ["lx", "ly"], ["rx", "ry"]).select("l_id", "r_id", r6("dist", "dist"))


EMB = "(SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)"


@query(f"SELECT a.vec_id AS l_id, b.vec_id AS r_id, round(list_distance(a.e, b.e), 5) AS dist FROM {EMB} a JOIN {EMB} b ON a.vec_id < b.vec_id AND list_distance(a.e, b.e) <= 1.15")
def nd_range_join(spark, d):
    e = table(spark, d, "embeddings")
    left, right = e.select(F.col("vec_id").alias("l_id"), F.col("embedding").alias("p")), e.select(F.col("vec_id").alias("r_id"), F.col("embedding").alias("q"))
    return metric_join(left, right, 1.15, "p", "q").where("l_id < r_id").select("l_id", "r_id", F.round("dist", 5).alias("dist"))


@query(f"SELECT a.vec_id AS l_id, arg_min(b.vec_id, (list_distance(a.e, b.e), b.vec_id)) AS r_id, round(min(list_distance(a.e, b.e)), 5) AS dist FROM {EMB} a JOIN {EMB} b ON a.vec_id <> b.vec_id AND list_distance(a.e, b.e) <= 1.2 GROUP BY a.vec_id")
def nd_nearest(spark, d):
    e = table(spark, d, "embeddings")
    left, right = e.select(F.col("vec_id").alias("l_id"), F.col("embedding").alias("p")), e.select(F.col("vec_id").alias("r_id"), F.col("embedding").alias("q"))
    return metric_nearest(left, right, 1.2, "p", "q", "l_id", "r_id").select("l_id", "r_id", F.round("dist", 5).alias("dist"))


#: angle from the sum of the directions and their difference, which is as exact for small angles as for large ones
TURN = "degrees(2 * atan2(list_distance(list_transform(a.e, lambda v: v / a.n), list_transform(b.e, lambda v: v / b.n)), list_distance(list_transform(a.e, lambda v: v / a.n), list_transform(b.e, lambda v: -v / b.n))))"


@query(f"WITH u AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM {EMB}) SELECT l_id, r_id, round(turn, 4) AS turn FROM (SELECT a.vec_id AS l_id, b.vec_id AS r_id, {TURN} AS turn FROM u a JOIN u b ON a.vec_id < b.vec_id) WHERE turn <= 70")
def nd_angle_join(spark, d):
    """Pairs of vectors whose directions are at most 70 degrees apart."""
    e = table(spark, d, "embeddings")
    left, right = e.select(F.col("vec_id").alias("l_id"), F.col("embedding").alias("p")), e.select(F.col("vec_id").alias("r_id"), F.col("embedding").alias("q"))
    return metric_join(left, right, 70.0, "p", "q", "angular", "turn", once=("l_id", "r_id"), columns=["l_id", "r_id"]).select("l_id", "r_id", F.round("turn", 4).alias("turn"))


GRID = lambda t: f"(SELECT CAST(floor(x * 2) AS BIGINT) AS cell0, CAST(floor(y * 2) AS BIGINT) AS cell1, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, count(*) AS n FROM {t} GROUP BY 1, 2)"


@query(
    f"""SELECT a.cell0, a.cell1, b.cell0 AS other0, b.cell1 AS other1, round(pow(greatest(a.min_x - b.max_x, b.min_x - a.max_x, 0), 2) + pow(greatest(a.min_y - b.max_y, b.min_y - a.max_y, 0), 2), 6) AS low,
round(pow(greatest(a.max_x - b.min_x, b.max_x - a.min_x), 2) + pow(greatest(a.max_y - b.min_y, b.max_y - a.min_y), 2), 6) AS high FROM {GRID(CUST)} a JOIN {GRID(SUPP)} b ON abs(a.cell0 - b.cell0) <= 1 AND abs(a.cell1 - b.cell1) <= 1"""
)
def bucket_pair_bounds(spark, d):
    """Least and greatest squared distance between the boxes of neighbouring buckets of two tables."""
    x, y, _ = radec_to_xyz("ra", "dec")

    def boxes(name, spread):
        t = sky(spark, d, name).select(x.alias("x"), y.alias("y"))
        b = sj.box_bounds(t, [F.floor(F.col("x") * 2).cast("long"), F.floor(F.col("y") * 2).cast("long")], ["x", "y"])
        near = F.explode(F.array(*[F.struct((F.col("cell0") + i).alias("k0"), (F.col("cell1") + j).alias("k1")) for i in spread for j in spread]))
        return b.withColumn("k", near)

    a, b = boxes("customer", (0,)), boxes("supplier", (-1, 0, 1)).withColumnsRenamed({c: f"o_{c}" for c in ("cell0", "cell1", "n", "min_x", "max_x", "min_y", "max_y")})
    low, high = sj.box_box_distsq(["x", "y"], "", "o_")
    return a.join(b, "k").select("cell0", "cell1", F.col("o_cell0").alias("other0"), F.col("o_cell1").alias("other1"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(f"SELECT l_id, rank, r_id, round(sep, 6) AS sep FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_id ORDER BY sep, r_id) AS INT) AS rank FROM {pairs_sql(SUPP, CUST, 12.0)}) WHERE rank <= 5")
def sky_knn(spark, d):
    best = lambda pairs: sj.k_nearest(pairs, 5)
    return sj.k_nearest_within(sky(spark, d, "supplier"), sky(spark, d, "customer"), 12.0, 5, best).select("l_id", "rank", "r_id", r6("sep", "sep"))


@query(f"SELECT id, round(sep, 6) AS sep FROM (SELECT a.id, {SEP} AS sep FROM {CUST} a, (SELECT cos(radians(37.0e0)) * cos(radians(72.0e0)) AS x, cos(radians(37.0e0)) * sin(radians(72.0e0)) AS y, sin(radians(37.0e0)) AS z) b) WHERE sep <= 25 ORDER BY sep, id LIMIT 20")
def range_search_sorted(spark, d):
    from starloom.functions.sphere import degrees_between

    t = sky(spark, d, "customer").where(within_radius("ra", "dec", 72.0, 37.0, 25.0)).select("id", degrees_between("ra", "dec", F.lit(72.0), F.lit(37.0)).alias("s"))
    return t.orderBy("s", "id").limit(20).select("id", r6("s", "sep"))


DOT = "x * (cos(radians(37.0e0)) * cos(radians(72.0e0))) + y * (cos(radians(37.0e0)) * sin(radians(72.0e0))) + z * sin(radians(37.0e0))"


@query(f"SELECT id, bal FROM (SELECT id, {DOT} AS dot, c_acctbal AS bal FROM {xyz_sql(sky_sql('customer', 'c_acctbal'))}) WHERE dot >= cos(radians(15.0e0))")
def cone_search(spark, d):
    """Positions in a cone with a payload column."""
    return sky(spark, d, "customer", "c_acctbal").where(within_radius("ra", "dec", 72.0, 37.0, 15.0)).select("id", F.col("c_acctbal").alias("bal"))


@query(f"SELECT id FROM (SELECT id, {DOT} AS dot FROM {CUST}) WHERE dot >= cos(radians(30.0e0)) AND dot <= cos(radians(20.0e0))")
def annulus_search(spark, d):
    return sky(spark, d, "customer").where(within_radius("ra", "dec", 72.0, 37.0, 30.0, 20.0)).select("id")


@query(f"SELECT id, cat FROM (SELECT id, {DOT} AS dot, 'customer' AS cat FROM {CUST} UNION ALL SELECT id, {DOT}, 'supplier' FROM {SUPP}) WHERE dot >= cos(radians(25.0e0))")
def multi_index_search(spark, d):
    one = lambda n: sky(spark, d, n).where(within_radius("ra", "dec", 72.0, 37.0, 25.0)).select("id", F.lit(n).alias("cat"))
    return one("customer").unionByName(one("supplier"))


@query(f"SELECT count(*) AS n FROM (SELECT {DOT} AS dot FROM {CUST}) WHERE dot >= cos(radians(40.0e0))")
def range_count(spark, d):
    return sky(spark, d, "customer").where(within_radius("ra", "dec", 72.0, 37.0, 40.0)).agg(F.count("*").alias("n"))


@query(f"SELECT id FROM (SELECT id, {DOT} AS dot FROM {CUST}) ORDER BY dot DESC, id LIMIT 1")
def nearest_to_point(spark, d):
    from starloom.functions.sphere import distsq_between

    return sky(spark, d, "customer").orderBy(distsq_between("ra", "dec", F.lit(72.0), F.lit(37.0)), "id").limit(1).select("id")


@query(
    f"""WITH b AS (SELECT CAST(floor(x * 4) AS BIGINT) AS cell0, CAST(floor(y * 4) AS BIGINT) AS cell1, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, count(*) AS n FROM {CUST} GROUP BY 1, 2)
SELECT cell0, cell1, n, round(pow(greatest(min_x - 0.3e0, 0.3e0 - max_x, 0), 2) + pow(greatest(min_y - 0.2e0, 0.2e0 - max_y, 0), 2), 6) AS low, round(pow(greatest(abs(min_x - 0.3e0), abs(max_x - 0.3e0)), 2) + pow(greatest(abs(min_y - 0.2e0), abs(max_y - 0.2e0)), 2), 6) AS high FROM b"""
)
def bucket_distance_bounds(spark, d):
    x, y, _ = radec_to_xyz("ra", "dec")
    t = sky(spark, d, "customer").select(x.alias("x"), y.alias("y"))
    b = sj.box_bounds(t, [F.floor(F.col("x") * 4).cast("long"), F.floor(F.col("y") * 4).cast("long")], ["x", "y"])
    low, high = sj.box_point_distsq(["x", "y"], [0.3, 0.2])
    return b.select("cell0", "cell1", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(
    f"""WITH RECURSIVE e AS (SELECT DISTINCT l_id AS a, r_id AS b FROM {pairs_sql(SUPP, SUPP, 12.0)} WHERE l_id <> r_id), r AS (SELECT a AS id, b AS other FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.other = e.a)
SELECT id, min(least(id, other)) AS cluster FROM r GROUP BY id"""
)
def fof_clusters(spark, d):
    return sj.friends_of_friends(sky(spark, d, "supplier"), 12.0)
