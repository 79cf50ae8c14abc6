"""Queries by name, each with the SQL that must give the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise ValueError(f"{f.__name__} is registered twice")
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- synthetic skies and fields from the tables -----------------------------------------------------------------

KEYS = {"customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}


def sky(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """id, ra, dec and further columns: keys spread over the sphere along a golden-ratio spiral."""
    k = F.col(KEYS[name])
    dec = F.degrees(F.asin(2.0 * ((k * F.lit(0.6180339887498949)) % 1.0) - 1.0))
    return table(spark, sf_dir, name).select(k.alias("id"), ((k * F.lit(137.50776405003785)) % 360.0).alias("ra"), dec.alias("dec"), *columns)


def sky_sql(name: str, *columns: str) -> str:
    k = KEYS[name]
    more = "".join(f", {c}" for c in columns)
    return f"(SELECT {k} AS id, ({k} * 137.50776405003785e0) % 360.0e0 AS ra, degrees(asin(2.0e0 * (({k} * 0.6180339887498949e0) % 1.0e0) - 1.0e0)) AS dec{more} FROM {name})"


def xyz_sql(source: str) -> str:
    """``source`` with x, y, z."""
    return f"(SELECT *, cos(radians(dec)) * cos(radians(ra)) AS x, cos(radians(dec)) * sin(radians(ra)) AS y, sin(radians(dec)) AS z FROM {source})"


def r6(column, name: str):
    """Rounded to six places under a name; no negative zero."""
    column = F.col(column) if isinstance(column, str) else column
    return (F.round(column, 6) + 0.0).alias(name)
