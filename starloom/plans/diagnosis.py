"""Why fields are not solved, and pixels that two headers agree on."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.operators import align
from starloom.operators import diagnose as dg
from starloom.operators import geohash as gh
from starloom.operators.verify import header_values
from starloom.plans.registry import query, r6, table
from starloom.plans.solving import HEADERS, QUADS, _all, field_rules, local_sky, made_up_fields, patch_header, patches, star_lists

#: one field a list of stars, 16 degrees wide, turned and mirrored by its number
FIELD = {
    "crval0": "178.0e0 + list % 5", "crval1": "list % 3 - 1.0e0", "crpix0": "480.5e0", "crpix1": "520.5e0",
    "cd00": "CASE WHEN list % 2 = 0 THEN -0.016e0 ELSE 0.016e0 END", "cd01": "0.002e0", "cd10": "CASE WHEN list % 2 = 0 THEN 0.002e0 ELSE -0.002e0 END", "cd11": "0.016e0",
}
#: a source is off by up to three pixels in x and one in y, every ninth star has none
SHIFT_X, SHIFT_Y = "(star * 31 % 13 - 6) * 0.45e0", "(star * 17 % 5 - 2) * 0.4e0"
AB_PX, DEPTH, TOLERANCE = (520.0, 790.0), 15, 0.004

SQL_HEAD = f"""{QUADS}, head AS (SELECT *, {", ".join(f"{v} AS {k}" for k, v in FIELD.items())} FROM (SELECT DISTINCT list FROM s)),
sky AS (SELECT s.id AS star, head.*, x * cos(radians(crval1)) * cos(radians(crval0)) + y * cos(radians(crval1)) * sin(radians(crval0)) + z * sin(radians(crval1)) AS al,
  y * cos(radians(crval0)) - x * sin(radians(crval0)) AS e1, z * cos(radians(crval1)) - sin(radians(crval1)) * (x * cos(radians(crval0)) + y * sin(radians(crval0))) AS n1 FROM s JOIN head USING (list)),
pix AS (SELECT *, (cd11 * degrees(e1 / al) - cd01 * degrees(n1 / al)) / (cd00 * cd11 - cd01 * cd10) + crpix0 AS tx, (cd00 * degrees(n1 / al) - cd10 * degrees(e1 / al)) / (cd00 * cd11 - cd01 * cd10) + crpix1 AS ty FROM sky WHERE al > 0),
onf AS (SELECT list, star, tx, ty FROM pix WHERE tx BETWEEN 0.5 AND 1000.5 AND ty BETWEEN 0.5 AND 1000.5),
src AS (SELECT list, row_number() OVER (PARTITION BY list ORDER BY star * 37 % 701, star) - 1 AS rank, tx + {SHIFT_X} AS sx, ty + {SHIFT_Y} AS sy FROM onf WHERE star % 9 <> 0)"""
APART = lambda v: "sqrt(" + " + ".join(f"({v}[{i}] - code[{i}]) * ({v}[{i}] - code[{i}])" for i in range(1, 5)) + ")"
SQL_STAGES = f"""{SQL_HEAD},
near AS (SELECT o.list, star, arg_min({{'rank': rank, 'sx': sx, 'sy': sy}}, (sqrt((tx-sx)*(tx-sx) + (ty-sy)*(ty-sy)), rank)) AS m FROM onf o JOIN src ON o.list = src.list AND (tx-sx)*(tx-sx) + (ty-sy)*(ty-sy) <= 9.0 GROUP BY 1, 2),
k AS (SELECT a, b, c, d, code, unnest([a, b, c, d]) AS star, unnest([0, 1, 2, 3]) AS k FROM f),
t AS (SELECT k.*, o.list, m.rank AS rank, m.sx AS sx, m.sy AS sy FROM k JOIN onf o USING (star) LEFT JOIN near n ON n.star = o.star AND n.list = o.list),
g AS (SELECT list, a, b, c, d, code, count(*) AS n_inside, count(rank) AS n_found, count(DISTINCT rank) AS n_sources, max(rank) AS faintest,
  {", ".join(f"max(CASE WHEN k = {i} THEN sx END) AS x{i}, max(CASE WHEN k = {i} THEN sy END) AS y{i}" for i in range(4))} FROM t GROUP BY ALL),
w AS (SELECT *, CASE WHEN n_sources = 4 THEN sqrt((x1-x0)*(x1-x0) + (y1-y0)*(y1-y0)) END AS ab_px FROM g),
cc AS (SELECT *, (x1-x0)*(x1-x0) + (y1-y0)*(y1-y0) AS z, (y1-y0) + (x1-x0) AS co, (y1-y0) - (x1-x0) AS si FROM w),
bo AS (SELECT *, [((x2-x0)*co + (y2-y0)*si) / z, ((y2-y0)*co - (x2-x0)*si) / z, ((x3-x0)*co + (y3-y0)*si) / z, ((y3-y0)*co - (x3-x0)*si) / z] AS pl,
  [((y2-y0)*co - (x2-x0)*si) / z, ((x2-x0)*co + (y2-y0)*si) / z, ((y3-y0)*co - (x3-x0)*si) / z, ((x3-x0)*co + (y3-y0)*si) / z] AS sw FROM cc),
er AS (SELECT *, CASE WHEN n_sources = 4 THEN least({APART("pl")}, {APART("sw")}) END AS code_err, CASE WHEN {APART("sw")} < {APART("pl")} THEN sw ELSE pl END AS v FROM bo),
re AS (SELECT *, CASE WHEN n_inside < 4 THEN 'outside' WHEN n_found < 4 THEN 'no_source' WHEN n_sources < 4 THEN 'shared_source' WHEN ab_px NOT BETWEEN {AB_PX[0]} AND {AB_PX[1]} THEN 'scale'
  WHEN faintest >= {DEPTH} THEN 'depth' WHEN code_err > {TOLERANCE} THEN 'code' WHEN v[1] + v[3] > {1 + 3 * TOLERANCE} OR v[1] > v[3] + {1.5 * TOLERANCE} OR v[1]*v[1] - v[1] + v[2]*v[2] - v[2] > 0.02 OR v[3]*v[3] - v[3] + v[4]*v[4] - v[4] > 0.02 THEN 'pruned'
  ELSE 'verify' END AS reason FROM er)"""


def _fields(spark, d):
    """Stars on the field of their list, and its sources."""
    stars = star_lists(spark, d)
    headers = stars.select("list").distinct().select("list", F.col("list").alias("field_id"), *[F.expr(v).cast("double").alias(k) for k, v in FIELD.items()])
    on = dg.stars_on_fields(stars, headers, 1000, 1000, 0.0162 * 3600, by="list")
    from pyspark.sql import Window

    rank = (F.row_number().over(Window.partitionBy("field_id").orderBy(F.col("star") * 37 % 701, "star")) - 1).cast("long")
    sources = on.where("star % 9 <> 0").select("field_id", rank.alias("rank"), (F.col("x") + F.expr(SHIFT_X)).alias("x"), (F.col("y") + F.expr(SHIFT_Y)).alias("y"))
    return on, sources


def _stages(spark, d):
    on, sources = _fields(spark, d)
    quads = _all(spark, d).withColumn("stars", F.array("a", "b", "c", "d")).withColumn("quad_id", F.xxhash64("stars"))
    found = dg.geometric_stages(on, sources, quads.select("quad_id", "stars", "code"), 3.0, AB_PX, DEPTH, TOLERANCE).withColumn("reason", F.coalesce("reason", F.lit("verify")))
    return found.join(quads.select("quad_id", "a", "b", "c", "d"), "quad_id")


@query(f"{SQL_STAGES} SELECT list AS field_id, a, b, c, d, n_inside, n_found, faintest, round(ab_px, 4) AS ab_px, round(code_err, 6) AS code_err, reason FROM re")
def why_not_stages(spark, d):
    """Every quad with a star on the field of its list, with the first geometric stage at which it falls out."""
    return _stages(spark, d).select("field_id", "a", "b", "c", "d", "n_inside", "n_found", "faintest", F.round("ab_px", 4).alias("ab_px"), F.round("code_err", 6).alias("code_err"), "reason")


@query(f"{SQL_STAGES} SELECT list AS field_id, reason, count(*) AS quads, max(n_found) AS most_found FROM re GROUP BY ALL")
def why_not_counts(spark, d):
    """Numbers of quads by field and reason."""
    return _stages(spark, d).groupBy("field_id", "reason").agg(F.count("*").alias("quads"), F.max("n_found").alias("most_found"))


@query()
def why_not_solved(spark, d):
    """All stages up to verification for the quads on all made-up fields, whose headers are known."""
    _, n, zoom = patches(spark, d)
    stars = local_sky(spark, d)
    quads = gh.build_quads(stars, 30 * zoom, 0.8 / zoom, 1.8 / zoom, passes=2)
    rows = [(2 * p + h, *map(float, header_values(patch_header(p, h, zoom)))) for p in range(n) for h in HEADERS]
    headers = spark.createDataFrame(rows, "field_id long, " + ", ".join(f"{h} double" for h in dg.HEADER))
    got = dg.why_not(headers, made_up_fields(spark, d), stars, quads, 1000, 1000, (12.0 / zoom, 18.0 / zoom), (0.8 / zoom, 1.8 / zoom), 24, rules=field_rules(zoom))
    return got.select("field_id", "quad_id", "n_inside", "n_found", "faintest", F.round("code_err", 6).alias("code_err"), F.round("logodds", 3).alias("logodds"), "reason")


#: two headers a customer with one tangent point: turned by up to 40 degrees, enlarged and moved
TURN, ZOOM, MOVE = "radians(5.0e0 + c_custkey % 36)", "(1.0e0 + c_custkey % 7 * 0.01e0)", ("c_custkey % 41 - 20.0e0", "c_custkey % 23 - 11.0e0")


@query(
    f"""WITH h AS (SELECT c_custkey AS id, {ZOOM} * cos({TURN}) AS c, {ZOOM} * sin({TURN}) AS s, 500.5e0 + {MOVE[0]} AS p, 500.5e0 + {MOVE[1]} AS q FROM customer),
t AS (SELECT *, p - (c * 500.5 + s * 500.5) AS u, q - (c * 500.5 - s * 500.5) AS v, (1 - c) * (1 - c) + s * s AS det FROM h)
SELECT id, round(((1 - c) * u + s * v) / det, 4) AS x, round(((1 - c) * v - s * u) / det, 4) AS y FROM t"""
)
def agreeing_pixels(spark, d):
    """The centre of rotation between two headers of one tangent point, which SQL has in closed form."""
    k = F.col("c_custkey")
    size = 0.002
    first = {"crval0": F.pmod(k * 7, F.lit(360)).cast("double"), "crval1": (k % 120 - 60).cast("double"), "crpix0": F.lit(500.5), "crpix1": F.lit(500.5), "cd00": F.lit(-size), "cd01": F.lit(0.0), "cd10": F.lit(0.0), "cd11": F.lit(size)}
    c, s = (F.expr(f"{f}({TURN}) / {ZOOM} * {size}e0") for f in ("cos", "sin"))
    second = first | {"crpix0": 500.5 + F.expr(MOVE[0]), "crpix1": 500.5 + F.expr(MOVE[1]), "cd00": -c, "cd01": s, "cd10": s, "cd11": c}
    pairs = table(spark, d, "customer").select(k.alias("id"), *[v.alias(f"{p}_{n}") for p, h in (("a", first), ("b", second)) for n, v in h.items()])
    return dg.agreeing_pixels(pairs, "id", 1000, 1000).select("id", r6(F.round("x", 4), "x"), r6(F.round("y", 4), "y"))


#: headers that are off by hundreds of pixels, and sources that are a little off besides
OFF_X, OFF_Y = "(list % 5 - 2) * 61.0e0 + 17.25e0", "(list % 3 - 1) * 83.0e0 - 40.5e0"


@query(
    f"""{SQL_HEAD}, off AS (SELECT o.list, sx + {OFF_X} - tx AS dx, sy + {OFF_Y} - ty AS dy FROM src JOIN onf o USING (list) WHERE pow(sx + {OFF_X} - tx, 2) + pow(sy + {OFF_Y} - ty, 2) <= 250.0 * 250.0),
gr AS (SELECT g.i * 2 + h.i AS grid, g.i AS i, h.i AS j FROM (SELECT unnest([0, 1]) AS i) g, (SELECT unnest([0, 1]) AS i) h),
vo AS (SELECT list, grid, floor((dx + i * 4.0e0) / 8.0e0) AS bx, floor((dy + j * 4.0e0) / 8.0e0) AS by_, count(*) AS votes, avg(dx) AS dx, avg(dy) AS dy FROM off, gr GROUP BY ALL)
SELECT list AS field_id, round(dx, 5) AS dx, round(dy, 5) AS dy, votes FROM (SELECT *, row_number() OVER (PARTITION BY list ORDER BY votes DESC, grid, bx, by_) AS n FROM vo) WHERE n = 1"""
)
def voted_shifts(spark, d):
    """The shift of every field's header, found by the vote of all pairs of sources and stars."""
    on, sources = _fields(spark, d)
    lists = {c: F.expr(e.replace("list", "field_id")) for c, e in (("x", OFF_X), ("y", OFF_Y))}
    moved = sources.select("field_id", *[(F.col(c) + e).alias(c) for c, e in lists.items()])
    return align.voted_shifts(moved, on, 250.0, 8.0).select("field_id", F.round("dx", 5).alias("dx"), F.round("dy", 5).alias("dy"), "votes")


#: plane coefficients a customer: squares and cubes, which pixels can express exactly
FIRST = {4: "c_custkey % 7 * 0.001e0", 5: "c_custkey % 5 * -0.0005e0", 7: "c_custkey % 3 * 0.0002e0"}
SECOND = {4: "c_custkey % 4 * 0.0007e0", 6: "c_custkey % 6 * 0.0003e0"}


@query(f"SELECT c_custkey AS id, round(({FIRST[4]}) * 0.01e0 * 1e6, 4) AS a20, round(({FIRST[5]}) * 0.01e0 * 1e6, 4) + 0 AS a11, round(({FIRST[7]}) * 0.0001e0 * 1e9, 4) AS a30, round(({SECOND[4]}) * 0.01e0 * 1e6, 4) AS b02, round(({SECOND[6]}) * 0.01e0 * 1e6, 4) AS b20, TRUE AS exact FROM customer")
def plane_to_pixel_distortion(spark, d):
    """Polynomials of the plane turned into distortion by pixels, in millionths and milliardths."""
    coefficients = lambda given: F.create_map(*[v for k, e in given.items() for v in (F.lit(k), F.expr(e).cast("double"))])
    numbers = {"crpix0": 500.5, "crpix1": 400.5, "cd00": 0.01, "cd01": 0.0, "cd10": 0.0, "cd11": 0.01, "width": 1000.0, "height": 800.0}
    heads = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), *[F.lit(v).alias(k) for k, v in numbers.items()], coefficients(FIRST).alias("first"), coefficients(SECOND).alias("second"))
    got = align.pixel_distortions(heads, "id", 3)
    pick = lambda poly, p, q, unit: F.round(F.element_at(F.filter(poly, lambda t: (t["p"] == p) & (t["q"] == q)), 1)["c"] * unit, 4) + 0.0
    return got.select("id", pick("a", 2, 0, 1e6).alias("a20"), pick("a", 1, 1, 1e6).alias("a11"), pick("a", 3, 0, 1e9).alias("a30"), pick("b", 0, 2, 1e6).alias("b02"), pick("b", 2, 0, 1e6).alias("b20"), (F.col("error") < 1e-3).alias("exact"))
