"""Relational search surface: visibility, tags, positions, status pages, best jobs, counters, file store.

The tables stand in: orders are jobs of an image (their customer), documents are tagged images, events is the queue.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from starloom.functions import healpix as hp
from starloom.functions.sphere import radec_to_xyz
from starloom.operators import tables as tb
from starloom.operators.checkpoints import reliable, spread
from starloom.plans.registry import query, sky, sky_sql, table, xyz_sql
from starloom.plans.scalars import cell_sql


@query("SELECT o_orderkey FROM orders WHERE o_custkey % 10 <> 0 OR o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def visible_images(spark, d):
    """Anonymous rows only when solved, others all, newest first."""
    t = table(spark, d, "orders").where("o_custkey % 10 <> 0 OR o_orderstatus = 'F'")
    return t.orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(100).select("o_orderkey")


@query("SELECT lang AS tag, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, tag LIMIT 50")
def tags_freq(spark, d):
    t = table(spark, d, "documents").groupBy(F.col("lang").alias("tag")).agg(F.count("*").alias("n"))
    return t.orderBy(F.col("n").desc(), "tag").limit(50)


@query("SELECT DISTINCT doc_id FROM documents WHERE lower(source) = 'src3'")
def tag_search_exact(spark, d):
    return table(spark, d, "documents").where(F.lower("source") == "src3").select("doc_id").distinct()


@query("SELECT DISTINCT source FROM documents WHERE contains(lower(source), 'c1')")
def tag_search_substring(spark, d):
    return table(spark, d, "documents").where(F.lower("source").contains("c1")).select("source").distinct()


@query(f"SELECT id FROM {xyz_sql(sky_sql('customer'))} WHERE pow(x - cos(radians(37.0e0)) * cos(radians(72.0e0)), 2) + pow(y - cos(radians(37.0e0)) * sin(radians(72.0e0)), 2) + pow(z - sin(radians(37.0e0)), 2) < pow(radians(12.0e0), 2) AND id % 30 <= 12")
def location_search(spark, d):
    """Calibrations near a position whose own radius is not larger than asked."""
    import math

    x, y, z = radec_to_xyz("ra", "dec")
    a, e = math.radians(72.0), math.radians(37.0)
    gap = (x - math.cos(e) * math.cos(a)) ** 2 + (y - math.cos(e) * math.sin(a)) ** 2 + (z - math.sin(e)) ** 2
    return sky(spark, d, "customer").where((gap < math.radians(12.0) ** 2) & (F.col("id") % 30 <= 12)).select("id")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P') ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 20")
def status_filter_page(spark, d):
    t = table(spark, d, "orders").where(F.col("o_orderstatus").isin("F", "P"))
    return tb.paginate(t, [F.col("o_orderdate").desc(), "o_orderkey"], 2, 20).select("o_orderkey", "o_orderstatus")


@query("SELECT o_custkey AS image, arg_max(o_orderkey, (CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END, o_orderdate, o_orderkey)) AS job FROM orders GROUP BY o_custkey")
def best_job(spark, d):
    """A calibrated job if any, then the latest."""
    key = F.struct((F.col("o_orderstatus") == "F").cast("int").alias("s"), "o_orderdate", "o_orderkey")
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("image")).agg(F.max(key)["o_orderkey"].alias("job"))


#: parts that the images of a cell are dealt to; each image meets one part after another, as short lists that come again and again take little place in files
PARTS = 8

C64 = cell_sql(xyz_sql(sky_sql("customer")), 64)


@query(f"WITH c AS (SELECT id, cell FROM {C64}) SELECT a.id, b.id AS other FROM c a JOIN c b ON a.cell = b.cell AND a.id <> b.id UNION SELECT a.id, b.id FROM c a JOIN c b ON a.cell // 4096 * 1024 + a.cell % 4096 // 64 // 2 * 32 + a.cell % 64 // 2 = b.cell // 4096 * 1024 + b.cell % 4096 // 64 // 2 * 32 + b.cell % 64 // 2 AND a.id <> b.id")
def nearby_images(spark, d):
    """Images in the same cell or the same coarser cell: the coarser cell holds the finer one, so one join does."""
    t = sky(spark, d, "customer").select("id", hp.convert_nside(hp.radec_to_cell("ra", "dec", 64), 64, 32).alias("parent"))
    # a crowded cell's images are dealt to parts, each of which all images meet
    left = spread(t.withColumn("part", F.explode(F.array(*map(F.lit, range(PARTS))))), "parent", "part")
    right = spread(t.select(F.col("id").alias("other"), "parent", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int").alias("part")), "parent", "part")
    return left.join(right.hint("merge"), ["parent", "part"]).where("id <> other").select("id", "other")


@query()
def nearby_images_by_level(spark, d):
    """Images near an image of its own level of cells, over the levels as far as needed to find more than six.

    First those in the same cell; if they, the image included, are six at most, those of the cells around as well; if
    that is not enough either, those in the next coarser cell and in or around the four next finer ones.
    """
    at = lambda n: hp.radec_to_cell("ra", "dec", n)
    kind = F.col("id") % 3
    t = sky(spark, d, "customer").select("id", F.when(kind == 0, 8).when(kind == 1, 16).otherwise(32).cast("long").alias("nside"), F.when(kind == 0, at(8)).when(kind == 1, at(16)).otherwise(at(32)).alias("cell"))
    levels = None
    for n in (8, 16, 32):
        own = t.where(F.col("nside") == n).select("cell").distinct()
        base, x, y = hp.decompose("cell", n)
        finer = [hp.compose(base, x * 2 + i, y * 2 + j, 2 * n) for i in (0, 1) for j in (0, 1)]
        around = own.select("cell", hp.neighbours(n)("cell").alias("around"), hp.convert_nside("cell", n, n // 2).alias("parent"), *[hp.neighbours(2 * n)(f).alias(f"f{k}") for k, f in enumerate(finer)])
        reach = lambda nside, stage, cells: F.transform(cells, lambda c: F.struct(F.lit(nside).cast("long").alias("nside2"), c.alias("cell2"), F.lit(stage).alias("stage")))
        wide = F.array_distinct(F.concat("f0", "f1", "f2", "f3"))
        rows = around.select(F.lit(n).cast("long").alias("nside"), "cell", F.explode(F.concat(reach(n, 0, F.array("cell")), reach(n, 1, F.col("around")), reach(n // 2, 2, F.array("parent")), reach(2 * n, 2, wide))).alias("to"))
        rows = rows.select("nside", "cell", "to.nside2", "to.cell2", "to.stage")
        levels = rows if levels is None else levels.unionByName(rows)
    # how far an image looks depends on how many there are in each cell alone, so only the pairs that are wanted are made
    there = t.select(F.col("id").alias("other"), F.col("nside").alias("nside2"), F.col("cell").alias("cell2"))
    held = levels.join(there.groupBy("nside2", "cell2").agg(F.count("*").alias("n")), ["nside2", "cell2"])
    n0, n1 = (F.coalesce(F.sum(F.when(F.col("stage") <= k, F.col("n"))), F.lit(0)) for k in (0, 1))
    last = held.groupBy("nside", "cell").agg(F.when(n0 > 6, 0).when(n1 > 6, 1).otherwise(2).alias("last"))
    wanted = reliable(held.join(last, ["nside", "cell"]).where("stage <= last").select("nside", "cell", "nside2", "cell2", "stage"))
    left = t.join(wanted, ["nside", "cell"]).select("id", "nside2", "cell2", "stage", F.explode(F.array(*map(F.lit, range(PARTS)))).alias("part"))
    right = there.withColumn("part", F.pmod(F.xxhash64("other"), F.lit(PARTS)).cast("int"))
    keys = ["nside2", "cell2", "part"]
    return spread(left, *keys).join(spread(right, *keys).hint("merge"), keys).where("id <> other").select("id", "other", "stage")


@query("SELECT o_orderkey AS job, c_name AS owner, n_name AS place, list(l_linenumber ORDER BY l_linenumber) AS objects FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3")
def job_info(spark, d):
    o = table(spark, d, "orders")
    j = o.join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    j = j.join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy(F.col("o_orderkey").alias("job"), F.col("c_name").alias("owner"), F.col("n_name").alias("place")).agg(F.sort_array(F.collect_list("l_linenumber")).alias("objects"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%00000%1%' ORDER BY c_name, c_custkey LIMIT 10")
def user_autocomplete(spark, d):
    return table(spark, d, "customer").where(F.col("c_name").like("%00000%1%")).orderBy("c_name", "c_custkey").limit(10).select("c_custkey", "c_name")


@query("SELECT o_orderstatus AS status, count(*) AS jobs, count(DISTINCT o_custkey) AS owners, count(*) FILTER (o_totalprice > 100000) AS large FROM orders GROUP BY 1")
def job_counters(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("jobs"), F.countDistinct("o_custkey").alias("owners"), F.count_if(F.col("o_totalprice") > 100000).alias("large"))


@query("SELECT md5(text) AS hash, count(*) AS n, min(doc_id) AS kept FROM documents GROUP BY 1")
def content_store(spark, d):
    """Content-addressed store: one row a hash."""
    return table(spark, d, "documents").groupBy(F.md5("text").alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("kept"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def orphaned_files(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT c_custkey AS image, list(DISTINCT o_orderpriority ORDER BY o_orderpriority) AS albums, bool_or(o_orderstatus = 'F') AS flagged FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def image_albums_and_flags(spark, d):
    j = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy(F.col("c_custkey").alias("image")).agg(F.sort_array(F.collect_set("o_orderpriority")).alias("albums"), F.bool_or(F.col("o_orderstatus") == "F").alias("flagged"))


@query("SELECT event_id, user_id, CAST(place AS INT) AS place FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events WHERE event_type <> 'purchase') WHERE place <= 3")
def queue_pending(spark, d):
    """Unprocessed rows, a fair share for each user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").where("event_type <> 'purchase'").withColumn("place", F.row_number().over(w)).where("place <= 3").select("event_id", "user_id", "place")


@query("SELECT user_id, CAST(epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch(max(ts)) AS BIGINT) AS age FROM events GROUP BY user_id")
def watchdog_age(spark, d):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return table(spark, d, "events").groupBy("user_id").agg(F.floor((F.unix_micros(now) - F.unix_micros(F.max("ts").cast("timestamp"))) / 1e6 + 0.5).alias("age"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'")
def cache_eviction(spark, d):
    """What stays when rows older than a limit are evicted."""
    return table(spark, d, "events").where(F.col("ts") >= F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("event_id")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_type || ':' || user_id AS label FROM events")
def json_fields(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.concat("event_type", F.lit(":"), F.col("user_id").cast("string")).alias("label"))
