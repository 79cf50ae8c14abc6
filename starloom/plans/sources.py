"""Source and sink queries: tables written in a format and read back, and records parsed from made-up lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from starloom.sources import catalogs as cat
from starloom.operators.checkpoints import scratch_folder
from starloom.sources import fits
from starloom.sources import fits_source as fs
from starloom.sources import text as tx
from starloom.plans.registry import query, table


@query("SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, s_nationkey AS nation, s_acctbal > 0 AS solvent FROM supplier")
def fits_table_roundtrip(spark, d):
    """A table encoded as one binary-table file a nation, on the executors, and decoded again."""
    t = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"), (F.col("s_acctbal") > 0).alias("solvent"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"content": [fits.PRIMARY + fits.encode(pdf)]})

    def unpack(batches):
        for pdf in batches:
            for content in pdf["content"]:
                data = bytes(content)
                for ext, h, _, at in fits.extensions(data):
                    if ext == 1:
                        yield fits.decode(h, data, at)

    files = t.groupBy("nation").applyInPandas(pack, "content binary")
    return files.mapInPandas(unpack, "id long, name string, balance double, nation int, solvent boolean")


@query("SELECT o_orderkey AS orderkey, o_totalprice AS price, o_orderpriority AS priority FROM orders WHERE o_totalprice > 150000 AND o_custkey <= 700 AND o_orderpriority <> '5-LOW'")
def fits_source_scan(spark, d):
    """Orders written as binary tables by all tasks and scanned by row ranges, comparisons tested on the raw records."""
    fs.register(spark)
    path, t = scratch_folder(spark, "fits"), table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    t.repartition(4).write.format(fs.NAME).mode("append").option("rows", 500_000).save(path)
    r = spark.read.format(fs.NAME).option("rows", 250_000).load(path).where("o_totalprice > 150000 AND o_custkey <= 700 AND o_orderpriority <> '5-LOW'")
    return r.select(F.col("o_orderkey").alias("orderkey"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))


@query("SELECT c_custkey AS id, round(c_custkey % 360000 / 1000.0e0, 6) AS ra, round(c_custkey % 180000 / 1000.0e0 - 90, 6) + 0 AS dec, round((c_custkey % 20000) / 1000.0e0, 6) AS mag_v, CAST(c_custkey % 8 AS INT) AS position_src, CAST(c_custkey // 8 % 2 AS INT) AS diffraction FROM customer")
def packed_catalogue_records(spark, d):
    """88-byte star records, packed and decoded."""

    def pack(batches):
        for pdf in batches:
            k = pdf["c_custkey"].to_numpy()
            rec = np.zeros(len(k), np.dtype([(n, c) for n, c, *_ in cat.NOMAD]))
            rec["ra"], rec["dec"], rec["mag_v"] = k % 360000 * 3600, k % 180000 * 3600, k % 20000
            rec["usnob_id"], rec["flags"] = k, (k % 8) | ((k // 8 % 2) << 25)
            yield cat.decode(rec.tobytes(), cat.NOMAD)

    t = table(spark, d, "customer").select("c_custkey").mapInPandas(pack, cat.schema(cat.NOMAD))
    t = t.select("*", *cat.nomad_flags(F.col("flags")))
    return t.select(F.col("usnob_id").alias("id"), F.round("ra", 6).alias("ra"), (F.round("dec", 6) + 0.0).alias("dec"), F.round("mag_v", 6).alias("mag_v"), "position_src", "diffraction")


@query("SELECT CAST(s_suppkey AS INT) AS tyc2, round(s_suppkey % 360 + 0.25e0, 6) AS ra, CASE WHEN s_suppkey % 3 > 0 THEN round(5 + s_suppkey % 9 / 10.0e0, 6) END AS mag_bt, s_suppkey % 2 = 0 AS double_star FROM supplier")
def aligned_catalogue_lines(spark, d):
    """Column-aligned text records; blank magnitudes are null."""
    k = F.col("s_suppkey")
    line = F.concat(F.lit("0001 "), F.lpad(k.cast("string"), 5, "0"), F.lit(" 1"), F.rpad(F.lit(""), 98, " "), F.when(k % 3 > 0, F.format_string("%6.3f", 5 + k % 9 / 10.0)).otherwise(F.lit("      ")), F.rpad(F.lit(""), 20, " "), F.lit("999"), F.rpad(F.lit(""), 13, " "))
    line = F.concat(line, F.format_string("%12.8f", k % 360 + 0.25), F.lit(" "), F.format_string("%12.8f", F.lit(1.5)), F.lit(" 1.50 1.50 88.0  90.0  "), F.lit(""))
    line = F.concat(F.rpad(line, 200, " "), F.when(k % 2 == 0, F.lit("D")).otherwise(F.lit(" ")), F.lit(" 0.10"))
    t = cat.parse_tycho2(table(spark, d, "supplier").select(F.rpad(line, 206, " ").alias("value")))
    return t.select("tyc2", F.round("ra", 6).alias("ra"), F.round("mag_bt", 6).alias("mag_bt"), "double_star")


@query("SELECT s_suppkey AS key, round(s_suppkey % 360 * 1.0e0, 6) AS ra, CASE WHEN s_suppkey % 4 > 0 THEN round(10 + s_suppkey % 7 / 10.0e0, 6) END AS j_m FROM supplier WHERE s_suppkey % 5 > 0")
def piped_catalogue_lines(spark, d):
    """Pipe-delimited records with quality cuts."""
    k = F.col("s_suppkey")
    cells = {"ra": (k % 360).cast("string"), "j_m": F.when(k % 4 > 0, F.format_string("%.1f", 10 + k % 7 / 10.0)).otherwise(F.lit("\\N")), "pts_key": k.cast("string"), "ph_qual": F.lit("AAB"), "cc_flg": F.when(k % 5 > 0, F.lit("000")).otherwise(F.lit("p00")), "gal_contam": F.lit("0"), "mp_flg": F.lit("0")}
    line = F.concat_ws("|", *[cells.get(n, F.lit("\\N")) for n in cat.TWOMASS])
    t = cat.parse_twomass(table(spark, d, "supplier").select(line.alias("value"))).where(cat.twomass_cuts())
    return t.select(F.col("pts_key").cast("long").alias("key"), F.round("ra", 6).alias("ra"), F.round("j_m", 6).alias("j_m"))


@query("SELECT '2008-Jan-' || format('{:02d}', CAST(s_suppkey % 28 + 1 AS INT)) || ' 00:00' AS at, round(15 * (s_suppkey % 24 + 0.5e0), 6) AS ra, round(-(s_suppkey % 60 + 0.25e0), 6) AS dec FROM supplier")
def ephemeris_lines(spark, d):
    k = F.col("s_suppkey")
    line = F.format_string(" 2008-Jan-%02d 00:00     %02d 30 00.0 -%02d 15 00.0", (k % 28 + 1).cast("int"), (k % 24).cast("int"), (k % 60).cast("int"))
    t = tx.parse_ephemerides(table(spark, d, "supplier").select(line.alias("value")))
    return t.select("at", F.round("ra", 6).alias("ra"), F.round("dec", 6).alias("dec"))


@query("SELECT p_partkey AS id, p_size % 7 AS ec, round(p_retailprice, 2) AS qr FROM part")
def orbital_element_text(spark, d):
    t = table(spark, d, "part").select("p_partkey", F.concat(F.lit(" EC= "), F.col("p_size") % 7, F.lit(" QR= "), F.format_string("%.2f", "p_retailprice"), F.lit(" IN= 3.5")).alias("v"))
    e = tx.elements(F.col("v"))
    return t.select(F.col("p_partkey").alias("id"), e["ec"].cast("int").alias("ec"), F.round(e["qr"], 2).alias("qr"))


KINDS = {"png": "89504e470d0a1a0a", "jpeg": "ffd8ffe0", "fits": "53494d504c4520203d202020", "gzip": "1f8b08"}


@query(f"SELECT c_custkey AS id, CASE c_custkey % 6 {' '.join(f'WHEN {i} THEN {chr(39)}{k}{chr(39)}' for i, k in enumerate(KINDS))} END AS kind FROM customer")
def file_kinds(spark, d):
    """Kinds of files told by how they begin; a third of the contents are names, which begin like none."""
    k = F.col("c_custkey") % 6
    start = F.coalesce(*[F.when(k == i, F.unhex(F.lit(h))) for i, h in enumerate(KINDS.values())], F.lit(b""))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), tx.file_kind(F.concat(start, F.col("c_name").cast("binary"))).alias("kind"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def unsolved_fields(spark, d):
    """Jobs of fields that the solved table does not have."""
    o = table(spark, d, "orders")
    return o.join(o.where("o_orderstatus = 'P'").select("o_custkey").distinct(), "o_custkey", "left_anti").select("o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 77")
def matches_for_field(spark, d):
    return table(spark, d, "orders").where("o_custkey = 77").select("o_orderkey", "o_totalprice")


@query("SELECT s_suppkey AS id, map_keys(m) AS keys FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN MAP {'OBJECT': 'x', 'CRVAL1': '9', 'CD1_1': '2'} ELSE MAP {'OBJECT': 'x', 'CRVAL1': '9'} END AS m FROM supplier)")
def header_merge(spark, d):
    """Header cards with the coordinate cards replaced by another header's."""
    old = F.create_map(*map(F.lit, ("OBJECT", "x", "CRVAL1", "1", "CRPIX1", "5")))
    new = F.when(F.col("s_suppkey") % 2 == 0, F.create_map(*map(F.lit, ("CRVAL1", "9", "CD1_1", "2")))).otherwise(F.create_map(*map(F.lit, ("CRVAL1", "9"))))
    wcs = lambda k, _: k.rlike("^(CRVAL|CRPIX|CD)")
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~wcs(k, v)), new)
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.map_keys(merged).alias("keys"))


@query("SELECT event_id, json_object('level', event_id % 3, 'type', event_type)::VARCHAR AS line FROM events WHERE event_id % 3 > 0")
def structured_log(spark, d):
    t = table(spark, d, "events").where("event_id % 3 > 0")
    return t.select("event_id", F.to_json(F.struct((F.col("event_id") % 3).alias("level"), F.col("event_type").alias("type"))).alias("line"))
