"""Table maintenance, set operations, ordering and windows."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from starloom.operators import tables as tb
from starloom.operators.prefilter import prefilter
from starloom.operators.selection import order_statistics, quantiles
from starloom.operators.lines import remove_axis_lines, remove_rotated_lines
from starloom.operators.uniformize import round_robin, sweeps, uniformize_catalogue
from starloom.functions import healpix as hp
from starloom.plans.registry import query, sky, sky_sql, table, xyz_sql
from starloom.plans.scalars import cell_sql


@query("SELECT p_partkey, p_brand, p_size FROM part")
def column_subset(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_brand", "p_size")


@query("SELECT i AS position, c_custkey, c_name FROM (SELECT CAST(unnest(range(0, 50)) AS BIGINT) AS i) JOIN (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS r FROM customer) ON r = i * 7 % 20")
def gather_rows(spark, d):
    """Rows at indexes, repeated and reordered."""
    rows = tb.row_index(table(spark, d, "customer").select("c_custkey", "c_name"), ["c_custkey"])
    want = spark.range(50).select(F.col("id").alias("position"), (F.col("id") * 7 % 20).alias("at"))
    return tb.gather(rows, want).select("position", "c_custkey", "c_name")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0e0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal < 0 THEN 'NONE' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def masked_assignment(spark, d):
    t = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    low = F.col("c_acctbal") < 0
    return t.withColumns({"c_acctbal": F.when(low, F.lit(0.0)).otherwise(F.col("c_acctbal")), "c_mktsegment": F.when(low, F.lit("NONE")).otherwise(F.col("c_mktsegment"))})


@query("SELECT s_suppkey AS id, CAST(s_acctbal AS FLOAT) AS balance, CAST(s_nationkey AS SMALLINT) AS nation FROM supplier WHERE s_acctbal > 0")
def cut_rename_cast(spark, d):
    t = tb.cut(table(spark, d, "supplier"), F.col("s_acctbal") > 0)
    return t.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").cast("float").alias("balance"), F.col("s_nationkey").cast("short").alias("nation"))


NAMES = lambda t, p: f"SELECT {p}_{'custkey' if p == 'c' else 'suppkey'} AS id, {p}_name AS name, {p}_acctbal AS bal"


@query(f"{NAMES('customer', 'c')} FROM customer UNION ALL {NAMES('supplier', 's')} FROM supplier")
def merge_strict(spark, d):
    one = lambda t, p, k: table(spark, d, t).select(F.col(f"{p}_{k}").alias("id"), F.col(f"{p}_name").alias("name"), F.col(f"{p}_acctbal").alias("bal"))
    return tb.merge([one("customer", "c", "custkey"), None, one("supplier", "s", "suppkey").select("bal", "name", "id")])


def _two(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal"), F.col("s_nationkey").alias("nation"))
    return a, b


@query("SELECT c_custkey AS id, c_acctbal AS bal FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def merge_minimal(spark, d):
    return tb.merge(_two(spark, d), "minimal")


@query("SELECT c_custkey AS id, c_acctbal AS bal, c_mktsegment AS segment, CAST(0 AS INT) AS nation FROM customer UNION ALL SELECT s_suppkey, s_acctbal, '', s_nationkey FROM supplier")
def merge_fillzero(spark, d):
    return tb.merge(_two(spark, d), "fillzero")


@query("SELECT c_acctbal AS bal FROM customer UNION ALL SELECT s_acctbal FROM supplier")
def merge_columns(spark, d):
    return tb.merge(_two(spark, d), ["bal"])


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def append_rows(spark, d):
    r = table(spark, d, "region").select(F.col("r_name").alias("n_name"), F.col("r_regionkey").alias("n_nationkey"), F.lit(1).alias("extra"))
    return tb.append(table(spark, d, "nation").select("n_nationkey", "n_name"), r)


@query("SELECT l_partkey AS id FROM lineitem WHERE l_quantity > 45 UNION SELECT p_partkey FROM part WHERE p_size > 40")
def union_predicates(spark, d):
    return table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id")).union(table(spark, d, "part").where("p_size > 40").select("p_partkey")).distinct()


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def exclude_members(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT CAST(place AS INT) AS place, s_suppkey, s_acctbal FROM (SELECT *, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) - 1 AS place FROM supplier)")
def table_sort_desc(spark, d):
    t = tb.row_index(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), [F.col("s_acctbal").desc(), F.col("s_suppkey")], "place")
    return t.select(F.col("place").cast("int").alias("place"), "s_suppkey", "s_acctbal")


@query("WITH p AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1 AS r FROM supplier) SELECT id, i, r AS inverse, (SELECT q.i FROM p q WHERE q.r = p.i) AS permutation FROM p")
def argsort_permutation(spark, d):
    """Position of each row in the order of a column, and the row that stands at each position."""
    t = tb.row_index(tb.row_index(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), "s_acctbal"), ["id"], "i"), ["s_acctbal", "id"], "r")
    at = t.select(F.col("r").alias("i"), F.col("i").alias("permutation"))
    return t.select("id", "i", F.col("r").alias("inverse")).join(at, "i").select("id", "i", "inverse", "permutation")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_linenumber, l_shipdate) AS n FROM lineitem) WHERE n <= 3")
def head_per_group(spark, d):
    t = table(spark, d, "lineitem")
    return tb.head_per_group(t, 3, ["l_suppkey"], [F.col("l_extendedprice").desc(), "l_orderkey", "l_partkey", "l_linenumber", "l_shipdate"]).select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")


@query("SELECT a.r AS row, n_name, r_name FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS r FROM nation) a JOIN (SELECT *, row_number() OVER (ORDER BY r_regionkey) - 1 AS r FROM region) b USING (r)")
def zip_join(spark, d):
    a = tb.row_index(table(spark, d, "nation").select("n_nationkey", "n_name"), ["n_nationkey"])
    b = tb.row_index(table(spark, d, "region").select("r_regionkey", "r_name"), ["r_regionkey"])
    return tb.zip_join(a, b).select(F.col("_row").alias("row"), "n_name", "r_name")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def paginated(spark, d):
    return tb.paginate(table(spark, d, "orders"), [F.col("o_totalprice").desc(), "o_orderkey"], 3, 20).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def brightest_k(spark, d):
    return table(spark, d, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


# --- histograms and statistics ----------------------------------------------------------------------------------


@query("SELECT CAST(least(greatest(CAST(floor((l_extendedprice - 1000.0e0) / (90000.0e0 / 49)) AS INT), 0), 49) AS INT) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def hist1d(spark, d):
    return tb.histogram(table(spark, d, "lineitem"), F.col("l_extendedprice"), 1000.0, 91000.0, nbins=50)


@query("SELECT least(greatest(CAST(floor((l_quantity - 5.0e0) / 4.0e0) AS INT), 0), 9) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def hist1d_binsize(spark, d):
    return tb.histogram(table(spark, d, "lineitem"), F.col("l_quantity"), 5.0, 40.0, binsize=4.0)


@query("SELECT round(1.0e0 + sum(n * bin * 1.0e0) / sum(n), 6) AS mean FROM (SELECT least(greatest(CAST(floor(l_quantity - 1.0e0) AS INT), 0), 49) AS bin, count(*) AS n FROM lineitem GROUP BY 1)")
def hist_mean(spark, d):
    return tb.histogram_mean(tb.histogram(table(spark, d, "lineitem"), F.col("l_quantity"), 1.0, 50.0, nbins=50), 1.0, 1.0).select(F.round("mean", 6).alias("mean"))


H2 = "SELECT CAST(floor((l_quantity - 5.0e0) / 4.0e0) AS INT) AS bin_x, CAST(floor((l_discount * 100 - 1.0e0) / 2.0e0) AS INT) AS bin_y FROM lineitem"


@query(f"SELECT least(greatest(bin_x, 0), 9) AS bin_x, least(greatest(bin_y, 0), 3) AS bin_y, count(*) AS n FROM ({H2}) GROUP BY 1, 2")
def hist2d_truncate(spark, d):
    return tb.histogram2d(table(spark, d, "lineitem"), F.col("l_quantity"), F.col("l_discount") * 100, (5.0, 45.0), (1.0, 9.0), 10, 4)


@query(f"SELECT bin_x, least(greatest(bin_y, 0), 3) AS bin_y, count(*) AS n FROM ({H2}) WHERE bin_x BETWEEN 0 AND 9 GROUP BY 1, 2")
def hist2d_discard(spark, d):
    return tb.histogram2d(table(spark, d, "lineitem"), F.col("l_quantity"), F.col("l_discount") * 100, (5.0, 45.0), (1.0, 9.0), 10, 4, "discard")


@query("SELECT l_returnflag AS flag, round(quantile_cont(l_extendedprice, 0.25), 6) AS q1, round(median(l_extendedprice), 6) AS q2, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95 FROM lineitem GROUP BY l_returnflag")
def percentiles(spark, d):
    q = quantiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.25, 0.5, 0.95])
    return q.select(F.col("l_returnflag").alias("flag"), *[F.round(f"q{i}", 6).alias(n) for i, n in enumerate(("q1", "q2", "p95"))])


@query("SELECT o_custkey AS customer, count(*) AS n, round(quantile_cont(o_totalprice, 0.1), 6) AS low, round(median(o_totalprice), 6) AS middle, max(o_totalprice) AS high FROM orders GROUP BY o_custkey")
def percentiles_of_groups(spark, d):
    """Many small groups in the same plan as a few large ones."""
    q = quantiles(table(spark, d, "orders"), ["o_custkey"], "o_totalprice", [0.1, 0.5, 1.0])
    return q.select(F.col("o_custkey").alias("customer"), "n", F.round("q0", 6).alias("low"), F.round("q1", 6).alias("middle"), F.col("q2").alias("high"))


@query("WITH o AS (SELECT l_quantity AS value, row_number() OVER (ORDER BY l_quantity) AS place, count(*) OVER () AS n FROM lineitem), k AS (SELECT unnest([1, 2, 3, 4]) AS nth, unnest([0.0e0, 0.2e0, 0.5e0, 1.0e0]) AS p) SELECT nth, value FROM o JOIN k ON place = greatest(ceil(p * n), 1)")
def tied_order_statistics(spark, d):
    """Order statistics of a column with fifty values, each of which fills many bins of a histogram."""
    t = table(spark, d, "lineitem").select(F.lit("all").alias("g"), F.col("l_quantity").cast("double").alias("v")).where("v IS NOT NULL")
    probs = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("nth"), F.lit(p).alias("p")) for i, p in enumerate((0.0, 0.2, 0.5, 1.0))]))
    ranks = t.groupBy("g").agg(F.count("*").alias("n")).select("g", "n", probs.alias("k")).select("g", "n", "k.nth", F.greatest(F.ceil(F.col("k.p") * F.col("n")) - 1, F.lit(0)).cast("long").alias("rank"))
    return order_statistics(t, ranks).join(ranks, ["g", "rank"]).select("nth", "value")


@query("SELECT p_brand AS band, min(p_retailprice) AS low, max(p_retailprice) AS high, round(avg(p_retailprice), 6) AS mean, count(*) AS n FROM part GROUP BY p_brand")
def band_statistics(spark, d):
    p = F.col("p_retailprice")
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("band")).agg(F.min(p).alias("low"), F.max(p).alias("high"), F.round(F.avg(p), 6).alias("mean"), F.count("*").alias("n"))


# --- windows ----------------------------------------------------------------------------------------------------


@query(f"SELECT id, cell, CAST(n - 1 AS INT) AS sweep FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY c_acctbal DESC, id) AS n FROM {cell_sql(xyz_sql(sky_sql('customer', 'c_acctbal')), 3)}) WHERE n <= 4")
def catalogue_sweeps(spark, d):
    t = sky(spark, d, "customer", "c_acctbal")
    return sweeps(t, hp.radec_to_cell("ra", "dec", 3), [F.col("c_acctbal").desc(), F.col("id")], 4).select("id", "cell", "sweep")


@query()
def uniformized_catalogue(spark, d):
    """Best three a cell with greedy de-duplication within 2 degrees."""
    return uniformize_catalogue(sky(spark, d, "customer", "c_acctbal"), 8, 3, 2.0, sort_col="c_acctbal", ascending=False, min_cut=-500.0).select("id", "cell", "sweep")


P = "SELECT c_custkey AS id, CAST(c_custkey * 7919 % 2048 AS DOUBLE) AS x, CAST(c_custkey * 104729 % 2048 AS DOUBLE) AS y, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS src FROM customer"


def _points(spark, d):
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 7919 % 2048).cast("double").alias("x"), (F.col("c_custkey") * 104729 % 2048).cast("double").alias("y"), "c_acctbal")
    return tb.row_index(t, [F.col("c_acctbal").desc(), F.col("id")], "src")


@query(
    f"""WITH p AS ({P}), b AS (SELECT *, min(x) OVER () AS x0, max(x) OVER () - min(x) OVER () AS w, min(y) OVER () AS y0, max(y) OVER () - min(y) OVER () AS h FROM p),
k AS (SELECT CAST(unnest([greatest(1, floor(sqrt(100 * w / h))), greatest(1, ceil(sqrt(100 * w / h)))]) AS INT) AS nx, w, h FROM (SELECT DISTINCT w, h FROM b)),
g AS (SELECT nx, CAST(greatest(1, floor(100.0e0 / nx + 0.5e0)) AS INT) AS ny FROM k ORDER BY abs(ln(w / nx) - ln(h / greatest(1, floor(100.0e0 / nx + 0.5e0)))), nx LIMIT 1),
c AS (SELECT id, src, CAST(least(floor((y - y0) / h * ny), ny - 1) * nx + least(floor((x - x0) / w * nx), nx - 1) AS INT) AS box FROM b, g),
t AS (SELECT id, box, CAST(row_number() OVER (PARTITION BY box ORDER BY src) AS INT) AS turn FROM c)
SELECT id, box, turn, row_number() OVER (ORDER BY turn, box) - 1 AS place FROM t"""
)
def uniformize_grid(spark, d):
    return round_robin(_points(spark, d), "x", "y", "src", 100).select("id", "box", "turn", "place")


@query(
    """WITH k AS (SELECT s_nationkey, s_suppkey AS id, least(2 * row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey), 2 * row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal + s_suppkey * 37 % 5000 DESC, s_suppkey) + 1) AS k FROM supplier)
SELECT s_nationkey AS field, id, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY k) - 1 AS INT) AS place FROM k"""
)
def resort_interleave(spark, d):
    t = table(spark, d, "supplier")
    flux, both = F.col("s_acctbal").desc(), (F.col("s_acctbal") + F.col("s_suppkey") * 37 % 5000).desc()
    return tb.interleave(t, [flux, F.col("s_suppkey")], [both, F.col("s_suppkey")], ["s_nationkey"]).select(F.col("s_nationkey").alias("field"), F.col("s_suppkey").alias("id"), "place")


@query("SELECT o_custkey AS field, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS best, max(o_totalprice) AS odds FROM orders GROUP BY o_custkey")
def best_per_group(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("field")).agg((-F.max(F.struct("o_totalprice", -F.col("o_orderkey")))["col2"]).alias("best"), F.max("o_totalprice").alias("odds"))


AGREE = "SELECT o_custkey AS field, o_orderkey AS id, o_totalprice AS odds, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_totalprice >= 100000"


@query(f"SELECT field, id FROM ({AGREE}) WHERE n = 1")
def agree_first(spark, d):
    t = table(spark, d, "orders").where("o_totalprice >= 100000")
    return t.groupBy(F.col("o_custkey").alias("field")).agg(F.min("o_orderkey").alias("id"))


@query("SELECT o_custkey AS field, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS id FROM orders WHERE o_totalprice >= 100000 GROUP BY o_custkey")
def agree_best(spark, d):
    t = table(spark, d, "orders").where("o_totalprice >= 100000")
    return t.groupBy(F.col("o_custkey").alias("field")).agg(F.max(F.struct("o_totalprice", "o_orderkey"))["o_orderkey"].alias("id"))


@query(f"SELECT field, id FROM ({AGREE})")
def agree_all(spark, d):
    return table(spark, d, "orders").where("o_totalprice >= 100000").select(F.col("o_custkey").alias("field"), F.col("o_orderkey").alias("id"))


@query("SELECT DISTINCT o_custkey AS field FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice >= 100000)")
def agree_leftovers(spark, d):
    o = table(spark, d, "orders")
    return o.join(o.where("o_totalprice >= 100000").select("o_custkey"), "o_custkey", "left_anti").select(F.col("o_custkey").alias("field")).distinct()


@query("SELECT o_orderkey, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank BETWEEN 3 AND 6")
def depth_window(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return table(spark, d, "orders").withColumn("rank", F.row_number().over(w)).where("rank BETWEEN 3 AND 6").select("o_orderkey", "rank")


@query("SELECT event_id, lag(event_id) OVER w AS before_id, lead(event_id) OVER w AS after_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS total, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def time_brackets_and_running_state(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, d, "events").select("event_id", F.lag("event_id").over(w).alias("before_id"), F.lead("event_id").over(w).alias("after_id"), F.round(F.sum("value").over(run), 4).alias("total"), F.max("value").over(run).alias("best"))


@query(
    """WITH f AS (SELECT o_orderkey, CAST((o_orderkey * 31 + o_custkey * 17) % 2048 AS DOUBLE) AS x FROM orders), c AS (SELECT CAST(floor(x + 0.5e0) AS BIGINT) AS b, count(*) - 1 AS k FROM f GROUP BY 1), o AS (SELECT b, k, avg(k) OVER () AS m FROM c WHERE k > 0)
SELECT o_orderkey, x FROM f WHERE CAST(floor(x + 0.5e0) AS BIGINT) NOT IN (SELECT b FROM o WHERE k * ln(m) - m - k * (k - 1) / 2 < -20)"""
)
def remove_lines(spark, d):
    f = table(spark, d, "orders").select("o_orderkey", ((F.col("o_orderkey") * 31 + F.col("o_custkey") * 17) % 2048).cast("double").alias("x"))
    return remove_axis_lines(f, "x", 20.0)


CHAIN_X, CHAIN_Y = "CASE WHEN o_orderkey % 17 = 0 THEN 512.0e0 ELSE CAST((o_orderkey * 31 + o_custkey * 17) % 2048 AS DOUBLE) END", "CAST((o_orderkey * 7 + o_custkey * 29) % 1024 AS DOUBLE)"


@query(
    f"""WITH s0 AS (SELECT o_custkey % 12 AS field_id, o_orderkey AS id, {CHAIN_X} AS x, {CHAIN_Y} AS y, o_totalprice AS flux, o_totalprice + o_orderkey % 1000 * 90 AS both_ FROM orders),
x1 AS (SELECT field_id, CAST(floor(x + 0.5e0) AS BIGINT) AS b, count(*) - 1 AS k FROM s0 GROUP BY 1, 2 HAVING count(*) > 1), x2 AS (SELECT *, avg(k) OVER (PARTITION BY field_id) AS m FROM x1),
s1 AS (SELECT s.* FROM s0 s WHERE NOT EXISTS (SELECT 1 FROM x2 WHERE x2.field_id = s.field_id AND x2.b = CAST(floor(s.x + 0.5e0) AS BIGINT) AND k * ln(m) - m - k * (k - 1) / 2 < -20)),
y1 AS (SELECT field_id, CAST(floor(y + 0.5e0) AS BIGINT) AS b, count(*) - 1 AS k FROM s1 GROUP BY 1, 2 HAVING count(*) > 1), y2 AS (SELECT *, avg(k) OVER (PARTITION BY field_id) AS m FROM y1),
s2 AS (SELECT s.* FROM s1 s WHERE NOT EXISTS (SELECT 1 FROM y2 WHERE y2.field_id = s.field_id AND y2.b = CAST(floor(s.y + 0.5e0) AS BIGINT) AND k * ln(m) - m - k * (k - 1) / 2 < -20)),
r AS (SELECT *, least(2 * row_number() OVER (PARTITION BY field_id ORDER BY flux DESC, id), 2 * row_number() OVER (PARTITION BY field_id ORDER BY both_ DESC, id) + 1) AS k FROM s2),
o AS (SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY k, flux DESC, id) - 1 AS p, min(x) OVER f AS x0, max(x) OVER f - min(x) OVER f AS w, min(y) OVER f AS y0, max(y) OVER f - min(y) OVER f AS h FROM r WINDOW f AS (PARTITION BY field_id)),
c AS (SELECT DISTINCT field_id, w, h, unnest([greatest(1.0e0, floor(sqrt(10 * w / h))), greatest(1.0e0, ceil(sqrt(10 * w / h)))]) AS nx FROM o),
g AS (SELECT field_id, arg_min({{'nx': nx, 'ny': greatest(1.0e0, floor(10 / nx + 0.5e0))}}, (abs(ln(w / nx) - ln(h / greatest(1.0e0, floor(10 / nx + 0.5e0)))), nx)) AS g FROM c GROUP BY 1),
b AS (SELECT o.*, least(floor((y - y0) / h * g.ny), g.ny - 1) * g.nx + least(floor((x - x0) / w * g.nx), g.nx - 1) AS box FROM o JOIN g USING (field_id)),
t AS (SELECT *, row_number() OVER (PARTITION BY field_id, box ORDER BY p) AS turn FROM b),
e AS (SELECT field_id, id, row_number() OVER (PARTITION BY field_id ORDER BY turn, box) - 1 AS place FROM t)
SELECT field_id, id, place FROM e WHERE place < 100"""
)
def prefiltered_fields(spark, d):
    """Sources of all fields without lines, brightest first by two measures, in turns over boxes, a hundred a field."""
    s = table(spark, d, "orders").select((F.col("o_custkey") % 12).alias("field_id"), F.col("o_orderkey").alias("id"), F.expr(CHAIN_X).alias("x"), F.expr(CHAIN_Y).alias("y"), F.col("o_totalprice").alias("flux"), (F.col("o_orderkey") % 1000 * 90).alias("sky"))
    return prefilter(s, background="sky", cut=20.0, keep=100).select("field_id", "id", F.col("place").cast("long").alias("place"))


@query(
    """WITH p AS (SELECT c_custkey AS id, CAST(c_custkey * 7919 % 2048 AS DOUBLE) AS x, CAST(c_custkey * 104729 % 2048 AS DOUBLE) AS y FROM customer UNION ALL SELECT i + 100000, i * 3.0e0 + 200, i * 3.0e0 + 400 FROM range(300) r(i)),
v AS (SELECT id, i * (pi() / 180) AS t, CAST(floor(((x - 1024) * cos(i * (pi() / 180)) + (y - 1024) * sin(i * (pi() / 180))) / 4) AS BIGINT) AS r FROM p, range(180) a(i)), c AS (SELECT t, r, count(*) AS n, abs((r + 0.5e0) * 4) AS far FROM v GROUP BY t, r),
h AS (SELECT *, 1024 * (abs(cos(t)) + abs(sin(t))) AS half, 1024 * abs(abs(cos(t)) - abs(sin(t))) AS inside, 2048 / greatest(abs(sin(t)), abs(cos(t))) AS whole FROM c),
e AS (SELECT *, greatest(1e-3, (SELECT count(*) FROM p) / (2048.0e0 * 2048) * 4 * CASE WHEN far >= half THEN 0 WHEN far <= inside THEN whole ELSE whole * (half - far) / (half - inside) END) AS m FROM h),
bad AS (SELECT t, r FROM e WHERE n > m AND n * ln(m) - m - n * ln(n) + n < -100) SELECT id, x, y FROM p WHERE id NOT IN (SELECT id FROM v JOIN bad USING (t, r))"""
)
def remove_lines_any_angle(spark, d):
    line = spark.range(300).select((F.col("id") + 100000).alias("id"), (F.col("id") * 3.0 + 200).alias("x"), (F.col("id") * 3.0 + 400).alias("y"))
    points = _points(spark, d).select("id", "x", "y").unionByName(line)
    return remove_rotated_lines(points, "x", "y", 2048.0, 2048.0, angles=180, cut=100.0, bin_size=4.0)


@query("SELECT CAST(floor(l_partkey / 100) AS BIGINT) AS bx, CAST(floor(l_suppkey / 10) AS BIGINT) AS by, round(avg(l_quantity), 6) AS v, round(sum(l_quantity * l_discount) / sum(l_discount), 6) AS weighted, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING sum(l_discount) > 0")
def block_average(spark, d):
    """Plain and weighted block averages of a sparse image."""
    q, w = F.col("l_quantity"), F.col("l_discount")
    t = table(spark, d, "lineitem").groupBy(F.floor(F.col("l_partkey") / 100).alias("bx"), F.floor(F.col("l_suppkey") / 10).alias("by"))
    return t.agg(F.round(F.avg(q), 6).alias("v"), F.round(F.sum(q * w) / F.sum(w), 6).alias("weighted"), F.count("*").alias("n"), F.sum(w).alias("_w")).where("_w > 0").drop("_w")


@query("SELECT l_partkey % 64 AS x, l_suppkey % 64 AS y, round(sum(l_quantity * l_tax) / sum(l_tax), 6) AS v, round(sum(l_tax), 6) AS weight FROM lineitem GROUP BY 1, 2 HAVING sum(l_tax) > 0")
def coadd(spark, d):
    t = table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 64).alias("x"), (F.col("l_suppkey") % 64).alias("y")).agg(F.sum(F.col("l_quantity") * F.col("l_tax")).alias("a"), F.sum("l_tax").alias("w"))
    return t.where("w > 0").select("x", "y", F.round(F.col("a") / F.col("w"), 6).alias("v"), F.round("w", 6).alias("weight"))


@query(
    """WITH m AS (SELECT l_suppkey AS r, l_partkey AS c, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2), n AS (SELECT r, c, v / sum(v) OVER (PARTITION BY r) AS v FROM m)
SELECT r, round(sum(v * p_size), 6) AS product, count(*) AS n, round(sum(v), 6) AS row_sum, round(max(v), 6) AS top, arg_max(c, (v, -c)) AS top_c FROM n JOIN part ON p_partkey = c GROUP BY r"""
)
def sparse_matvec(spark, d):
    """Row-normalised sparse matrix times a vector, with row sums, maxima and their places."""
    m = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("r"), F.col("l_partkey").alias("c")).agg(F.sum("l_quantity").alias("v"))
    n = m.withColumn("v", F.col("v") / F.sum("v").over(Window.partitionBy("r")))
    t = n.join(table(spark, d, "part").select(F.col("p_partkey").alias("c"), "p_size"), "c")
    top = (-F.max(F.struct("v", -F.col("c")))["col2"]).alias("top_c")
    return t.groupBy("r").agg(F.round(F.sum(F.col("v") * F.col("p_size")), 6).alias("product"), F.count("*").alias("n"), F.round(F.sum("v"), 6).alias("row_sum"), F.round(F.max("v"), 6).alias("top"), top)


@query("SELECT p_partkey AS id, round(CASE WHEN p_size % 2 = 0 AND p_size % 3 = 0 THEN (p_retailprice + p_size) / 2 WHEN p_size % 2 = 0 THEN p_retailprice WHEN p_size % 3 = 0 THEN p_size ELSE 0 END, 6) AS mag FROM part")
def average_magnitudes(spark, d):
    from starloom.functions.physics import average_mag

    s = F.col("p_size")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(average_mag("p_retailprice", s % 2 == 0, s, s % 3 == 0), 6).alias("mag"))


@query("SELECT l_returnflag AS flag, round(sqrt(avg((l_extendedprice / l_quantity - 1500) * (l_extendedprice / l_quantity - 1500))), 4) AS rms, round(sum(l_tax * l_quantity) / sum(l_tax), 6) AS centroid, count(*) FILTER (l_discount > 0.05) AS matches, count(*) FILTER (l_discount <= 0.05) AS distractors, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1")
def rms_centroid_counts(spark, d):
    e = F.col("l_extendedprice") / F.col("l_quantity") - 1500
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(
        F.round(F.sqrt(F.avg(e * e)), 4).alias("rms"), F.round(F.sum(F.col("l_tax") * F.col("l_quantity")) / F.sum("l_tax"), 6).alias("centroid"),
        F.count_if(F.col("l_discount") > 0.05).alias("matches"), F.count_if(F.col("l_discount") <= 0.05).alias("distractors"), F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"),
    )


@query(
    "SELECT l_suppkey AS g, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1"
)
def least_squares(spark, d):
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("g")).agg(F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 3).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2"))


@query("SELECT l_partkey AS c, round(sum(l_quantity * s_nationkey), 4) AS product FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1")
def sparse_transpose_matvec(spark, d):
    """Transpose of the supplier-by-part matrix times a vector over suppliers."""
    entries = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("r"), F.col("l_partkey").alias("c")).agg(F.sum("l_quantity").alias("v"))
    vector = table(spark, d, "supplier").select(F.col("s_suppkey").alias("r"), F.col("s_nationkey").alias("value"))
    return tb.transpose_product(entries, vector).select("c", F.round("product", 4).alias("product"))


@query(
    """WITH m AS (SELECT l_suppkey AS g, var_pop(l_quantity) AS xx, var_pop(l_discount) AS yy, covar_pop(l_quantity, l_discount) AS xy, avg(l_quantity) AS mx, avg(l_discount) AS my,
covar_pop(l_quantity, l_extendedprice) AS xp, covar_pop(l_discount, l_extendedprice) AS yp, avg(l_extendedprice) AS mp, covar_pop(l_quantity, l_tax) AS xt, covar_pop(l_discount, l_tax) AS yt, avg(l_tax) AS mt FROM lineitem GROUP BY 1),
b AS (SELECT *, (yy * xp - xy * yp) / (xx * yy - xy * xy) AS p1, (xx * yp - xy * xp) / (xx * yy - xy * xy) AS p2, (yy * xt - xy * yt) / (xx * yy - xy * xy) AS t1, (xx * yt - xy * xt) / (xx * yy - xy * xy) AS t2 FROM m)
SELECT g, round(p1, 3) AS price_1, round(p2, 2) AS price_2, round(mp - p1 * mx - p2 * my, 2) AS price_0, round(t1, 8) + 0 AS tax_1, round(t2, 7) + 0 AS tax_2, round(mt - t1 * mx - t2 * my, 7) + 0 AS tax_0 FROM b"""
)
def least_squares_many(spark, d):
    """Two right-hand sides on two regressors and a constant, a fit for each supplier."""
    t = tb.plane_fit(table(spark, d, "lineitem"), F.col("l_suppkey"), "l_quantity", "l_discount", ["l_extendedprice", "l_tax"])
    digits = {"1": (3, 8), "2": (2, 7), "0": (2, 7)}
    both = [((F.round(f"l_{c}_{k}", digits[k][i]) + 0.0) if i else F.round(f"l_{c}_{k}", digits[k][i])).alias(f"{'price' if c == 'extendedprice' else c}_{k}") for i, c in enumerate(("extendedprice", "tax")) for k in ("1", "2", "0")]
    return t.select("g", *both)
