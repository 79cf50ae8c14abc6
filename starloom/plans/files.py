"""Tables written as files of the text formats and packed records, in the checkpoint folder, and read by their readers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.operators.checkpoints import scratch_folder
from starloom.plans.registry import query, r6, table
from starloom.sources import catalogs as cat
from starloom.sources import text as tx

#: rows of one whole-file document (XML, parameter file), which a reader holds in memory at once
FILE_ROWS = 1000


def _folder(spark) -> str:
    return scratch_folder(spark, "files")


def _documents(t: DataFrame, key: str, row: Column, head: str, tail: str, sep: str, path: str) -> None:
    """One text file for every ``FILE_ROWS`` keys of ``t``: ``head``, a text a row, ``tail``."""
    parts = t.select(F.floor(F.col(key) / FILE_ROWS).alias("part"), F.struct(F.col(key), row.alias("row")).alias("r")).groupBy("part").agg(F.sort_array(F.collect_list("r")).alias("rs"))
    parts.select("part", F.concat(F.lit(head), F.array_join("rs.row", sep), F.lit(tail)).alias("value")).write.partitionBy("part").text(path)


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice END AS price, CAST(CASE WHEN o_orderkey % 5 > 0 THEN o_custkey ELSE -1000000 END AS INT) AS owner, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS status FROM orders WHERE o_orderkey % 7 > 0")
def text_table_scan(spark, d):
    """Delimited lines with comments, null tokens and lines of the wrong arity, which are left out."""
    k, path = F.col("o_orderkey"), _folder(spark)
    cells = [k.cast("string"), F.when(k % 4 > 0, F.col("o_totalprice").cast("string")).otherwise(F.lit("NaN")), F.when(k % 5 > 0, F.col("o_custkey").cast("string")).otherwise(F.lit("")), F.when(k % 3 > 0, F.col("o_orderstatus")).otherwise(F.lit("null"))]
    line = F.when(k % 7 > 0, F.concat_ws(",", *cells)).when(k % 2 == 0, F.concat(F.lit("# "), cells[0])).otherwise(F.concat_ws(",", *cells[:2]))
    table(spark, d, "orders").select(line.alias("value")).write.text(path)
    return tx.text_table(spark, path, "id long, price double, owner int, status string", header=False, int_null=tx.INT_NULL)


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 6 > 0 THEN round(c_custkey % 360000 / 1000.0e0, 3) END AS ra, CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS kind FROM customer")
def pipe_table_scan(spark, d):
    """Fixed-width lines under a header of names and types between pipes; header and lines are files of one folder."""
    k, path = F.col("c_custkey"), _folder(spark)
    spark.createDataFrame([("\\ made-up sources",), ("|         id|         ra|                kind|",), ("|       long|     double|                char|",)], "value string").coalesce(1).write.text(path)
    ra = F.when(k % 6 > 0, F.format_string("%.3f", k % 360000 / 1000.0)).otherwise(F.lit("null"))
    line = F.concat(F.lpad(k.cast("string"), 12, " "), F.lpad(ra, 12, " "), F.lpad(F.when(k % 5 > 0, F.col("c_mktsegment")).otherwise(F.lit("null")), 21, " "))
    table(spark, d, "customer").select(line.alias("value")).write.mode("append").text(path)
    return tx.pipe_table(spark, path)


@query("SELECT CAST(s_suppkey AS BIGINT) AS id, CASE WHEN s_suppkey % 4 > 0 THEN s_name || ' <' || s_nationkey || '>' END AS name, s_suppkey % 100 / 8.0e0 AS mag FROM supplier")
def votable_scan(spark, d):
    """XML tables with escaped text and empty cells."""
    k, path = F.col("s_suppkey"), _folder(spark)
    cell = lambda c: F.concat(F.lit("<TD>"), c, F.lit("</TD>"))
    name = F.when(k % 4 > 0, F.concat("s_name", F.lit(" &lt;"), F.col("s_nationkey").cast("string"), F.lit("&gt;"))).otherwise(F.lit(""))
    row = F.concat(F.lit("<TR>"), cell(k.cast("string")), cell(name), cell((k % 100 / 8.0).cast("string")), F.lit("</TR>"))
    fields = '<FIELD name="id" datatype="long"/><FIELD name="name" datatype="char" arraysize="*"/><FIELD name="mag" datatype="double"/>'
    _documents(table(spark, d, "supplier"), "s_suppkey", row, f"<VOTABLE><RESOURCE><TABLE>{fields}<DATA><TABLEDATA>", "</TABLEDATA></DATA></TABLE></RESOURCE></VOTABLE>", "", path)
    return tx.votable(spark, path)


@query("SELECT CAST(p_partkey AS BIGINT) AS id, p_name AS name, [p_size * 1.0e0, p_size / 2.0e0] AS mags, CASE WHEN p_size % 2 = 0 THEN 'EVEN' ELSE 'ODD' END AS kind FROM part")
def parameter_file_scan(spark, d):
    """Parameter files: a keyword, an enumeration, a typed struct with an array and quoted text, then rows and comments."""
    path = _folder(spark)
    head = "survey 7 # number\ntypedef enum { EVEN, ODD } PARITY;\ntypedef struct {\n  long id;\n  char name[64];\n  double mags[2];\n  PARITY kind;\n} STAR;\n\n"
    row = F.concat(F.lit("STAR "), F.col("p_partkey").cast("string"), F.lit(' "'), F.col("p_name"), F.lit('" { '), (F.col("p_size") * 1.0).cast("string"), F.lit(" "), (F.col("p_size") / 2.0).cast("string"), F.lit(" } "), F.when(F.col("p_size") % 2 == 0, F.lit("EVEN")).otherwise(F.lit("ODD")), F.lit(" # row"))
    _documents(table(spark, d, "part"), "p_partkey", row, head, "\n", "\n", path)
    return tx.parameters(spark, path, "star")


def _packed(spark, d, layout, **values):
    """Customers as packed records: ``values`` give the stored number of a field from the array of keys."""

    def run(batches):
        for pdf in batches:
            k = pdf["c_custkey"].to_numpy()
            rec = np.zeros(len(k), np.dtype([(n, c) for n, c, *_ in layout]))
            for name, value in values.items():
                rec[name] = value(k)
            yield pd.DataFrame({"content": [rec.tobytes()]})

    def unpack(batches):
        for pdf in batches:
            for content in pdf["content"]:
                yield cat.decode(bytes(content), layout)

    path = _folder(spark)
    table(spark, d, "customer").select("c_custkey").mapInPandas(run, "content binary").write.parquet(path)
    return spark.read.parquet(path).mapInPandas(unpack, cat.schema(layout))


@query("SELECT c_custkey AS id, round(c_custkey % 360 + 0.25e0, 6) AS ra, round(c_custkey % 180 - 89.75e0, 6) AS dec, round(c_custkey % 16000 / 1000.0e0, 6) AS mag, round(1900 + c_custkey % 9000 / 100.0e0, 6) AS epoch_ra, round((c_custkey % 2001 - 1000) / 10000.0e0, 6) + 0 AS pm_ra, round(c_custkey % 100 / 100.0e0, 6) AS jmag_err FROM customer")
def ucac3_records(spark, d):
    """84-byte star records, packed and decoded."""
    t = _packed(spark, d, cat.UCAC3, mpos=lambda k: k, ra=lambda k: k % 360 * 3_600_000 + 900_000, dec=lambda k: k % 180 * 3_600_000 + 900_000, mag=lambda k: k % 16000, epoch_ra=lambda k: k % 9000, pm_ra=lambda k: k % 2001 - 1000, jmag_err=lambda k: k % 100)
    return t.select(F.col("mpos").alias("id"), r6("ra", "ra"), r6("dec", "dec"), r6("mag", "mag"), r6("epoch_ra", "epoch_ra"), r6("pm_ra", "pm_ra"), r6("jmag_err", "jmag_err"))


@query("SELECT c_custkey AS id, round(c_custkey % 360 + 0.25e0, 6) AS ra, round((c_custkey % 251 - 125 + 128) / 3600000.0e0, 9) + 0 AS sigma_ra, round((c_custkey % 256 + 128) / 10000.0e0, 6) AS sigma_pm_ra, round(c_custkey % 1000 * 1.0e0, 6) AS zone, round((c_custkey % 20000 - 2000) / 1000.0e0, 6) + 0 AS vmag FROM customer")
def ucac4_records(spark, d):
    """78-byte star records with offset errors, packed and decoded."""
    t = _packed(spark, d, cat.UCAC4, mpos=lambda k: k, ra=lambda k: k % 360 * 3_600_000 + 900_000, sigma_ra=lambda k: k % 251 - 125, sigma_pm_ra=lambda k: k % 256, ucac2_zone=lambda k: k % 1000, vmag=lambda k: k % 20000 - 2000)
    return t.select(F.col("mpos").alias("id"), r6("ra", "ra"), (F.round("sigma_ra", 9) + 0.0).alias("sigma_ra"), r6("sigma_pm_ra", "sigma_pm_ra"), F.col("ucac2_zone").cast("double").alias("zone"), r6("vmag", "vmag"))


@query(
    """WITH s AS (SELECT c_custkey AS id, c_custkey % 360 + 0.25e0 AS ra, c_custkey % 180 - 89.999e0 AS dec, (c_custkey % 2001 - 1000) * 0.0001e0 / 3600 AS pa, (c_custkey % 4001 - 2000) * 0.0001e0 / 3600 AS pd, 2050 - 1997 - c_custkey % 15000 / 1000.0e0 AS dt FROM customer),
m AS (SELECT id, ra + pa * dt / cos(radians(dec)) AS ra, dec + pd * dt AS dec FROM s) SELECT id, round((CASE WHEN abs(dec) > 90 THEN ra + 180 ELSE ra END % 360 + 360) % 360, 6) AS ra, round(CASE WHEN dec > 90 THEN 180 - dec WHEN dec < -90 THEN -180 - dec ELSE dec END, 6) + 0 AS dec FROM m"""
)
def ucac5_moved_to_epoch(spark, d):
    """52-byte star records, decoded and moved by their proper motions to an epoch."""
    t = _packed(spark, d, cat.UCAC5, srcid=lambda k: k, ira=lambda k: k % 360 * 3_600_000 + 900_000, idc=lambda k: (k % 180 - 90) * 3_600_000 + 3600, epu=lambda k: k % 15000, pmur=lambda k: k % 2001 - 1000, pmud=lambda k: k % 4001 - 2000)
    ra, dec = cat.ucac5_at_epoch(2050.0)
    return t.select(F.col("srcid").alias("id"), r6(ra, "ra"), r6(dec, "dec"))


@query(
    """WITH s AS (SELECT c_custkey AS k FROM customer) SELECT CAST(k AS BIGINT) AS id, round(k % 36000 * 0.01e0 + 0.001e0, 6) AS ra, round(k % 18000 * 0.01e0 - 90, 6) + 0 AS dec, round(0.002e0 * (k % 10000 - 5000), 6) + 0 AS pm_ra, round(0.1e0 * (k % 10), 6) AS pm_prob, CAST(k % 5 AS BIGINT) AS ndetections,
round(k % 3000 / 100.0e0, 6) AS mag, ['O', 'E', 'J', 'F', 'J', 'F', 'F', 'N', 'N', 'N'][k % 10 + 1] AS band, CAST([1, 1, 2, 2, 2, 1, 2, 2, 2, 2][k % 10 + 1] AS INT) AS plate_epoch FROM s WHERE k % 5 >= 2 AND k % 3 > 0"""
)
def usnob_records(spark, d):
    """80-byte records of packed decimal digits, decoded, with the band and epoch of their survey and the quality cuts."""

    def run(batches):
        for pdf in batches:
            k = pdf["c_custkey"].to_numpy()
            u = np.zeros((len(k), 20), "<u4")
            u[:, 0], u[:, 1], u[:, 2] = k % 36000 * 3600 + 360, k % 18000 * 3600, k % 10000 + 5000 * 10**4 + k % 10 * 10**8
            u[:, 3], u[:, 6], u[:, 16] = k % 5 * 10**8 + (k % 3 == 0) * 10**9, k % 3000 + 345 * 10**4 + k % 10 * 10**7, k
            yield cat.decode_usnob(u.tobytes())

    names = cat.decode_usnob(b"\0" * 80).dtypes
    ddl = ", ".join(f"{n} {'boolean' if t.kind == 'b' else 'bigint' if t.kind == 'i' else 'double'}" for n, t in names.items())
    t = table(spark, d, "customer").select("c_custkey").mapInPandas(run, ddl).where(cat.usnob_cuts())
    return t.select(F.col("pmmscan_1").alias("id"), r6("ra", "ra"), r6("dec", "dec"), r6("pm_ra", "pm_ra"), r6("pm_prob", "pm_prob"), "ndetections", r6("mag_1", "mag"), cat.usnob_band(F.col("survey_1")).alias("band"), cat.usnob_epoch(F.col("survey_1"), 1).cast("int").alias("plate_epoch"))
