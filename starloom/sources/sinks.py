"""Sinks: cell-partitioned tables, solution tables, FITS files a partition, statement jobs, and checkpointed stages."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions import healpix as hp
from starloom.functions.wcs import Wcs
from starloom.operators.verify import correspondences


def write_cells(df: DataFrame, path: str, nside: int, margin_deg: float = 0.0, mode: str = "overwrite") -> None:
    """Parquet partitioned by sky cell; with a margin, a row goes to every cell that it is near."""
    cells = F.explode(hp.range_search(nside, margin_deg)("ra", "dec")) if margin_deg else hp.radec_to_cell("ra", "dec", nside)
    df.withColumn("hp", cells).write.mode(mode).partitionBy("hp").parquet(path)


def write_fits(df: DataFrame, path: str) -> DataFrame:
    """(name, content): one encoded table file a partition, for a writer of binary files; nothing is collected."""
    from starloom.sources import fits

    def run(batches):
        frames = [b for b in batches if len(b)]
        if frames:
            yield pd.DataFrame({"name": [f"{path}/{uuid.uuid4().hex}.fits"], "content": [fits.PRIMARY + fits.encode(pd.concat(frames, ignore_index=True))]})

    return df.mapInPandas(run, "name string, content binary")


def solution_tables(solved: DataFrame, sources: DataFrame) -> Mapping[str, DataFrame]:
    """Matches, headers, solved fields and the fields left over."""
    wcs = solved.select("field_id", *[c for c in solved.columns if c.startswith(("cr", "cd"))])
    return {"match": solved, "wcs": wcs, "solved": solved.select("field_id").distinct(), "unsolved": sources.select("field_id").distinct().join(solved, "field_id", "left_anti")}


def field_tables(sources: DataFrame, stars: DataFrame, wcs: Wcs, radius_px: float = 5.0) -> Mapping[str, DataFrame]:
    """Positions of a field's sources on the sky, of index stars in the field, and their correspondences."""
    ra, dec = wcs.pixel_to_radec("x", "y")
    x, y = wcs.radec_to_pixel("ra", "dec")
    inside = stars.where(wcs.contains("ra", "dec"))
    return {"rdls": sources.select("rank", ra.alias("ra"), dec.alias("dec")), "index_xyls": inside.select("id", x.alias("x"), y.alias("y")), "index_rdls": inside.select("id", "ra", "dec"), "corr": correspondences(sources, stars, wcs, radius_px)}


class StatementJobs:
    """Statement texts as named jobs over the session's views: submit, status, result, drop, with a time budget."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jobs = spark, {}

    def submit(self, text: str, table: str | None = None) -> str:
        job = table or f"job_{uuid.uuid4().hex[:12]}"
        try:
            self.spark.sql(text).createOrReplaceTempView(job)
            self.jobs[job] = "ready"
        except Exception as e:  # a wrong statement is a failed job, with its message kept
            self.jobs[job] = f"failed: {str(e)[:300]}"
        return job

    def status(self, job: str) -> str:
        return self.jobs.get(job, "unknown")

    def result(self, job: str) -> DataFrame:
        return self.spark.table(job)

    def drop(self, job: str) -> None:
        self.spark.catalog.dropTempView(job)
        self.jobs.pop(job, None)


def within_budget(spark: SparkSession, action: Callable[[], object], seconds: float):
    """Result of an action, or None when its jobs had to be cancelled after ``seconds``."""
    from threading import Thread

    tag, out = f"budget-{uuid.uuid4().hex}", {}

    def run() -> None:
        spark.addTag(tag)
        try:
            out["value"] = action()
        except Exception as e:
            out["error"] = e
        finally:
            spark.removeTag(tag)

    thread = Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        spark.interruptTag(tag)
        thread.join()
        return None
    if "error" in out:
        raise out["error"]
    return out["value"]


class Stages:
    """Named stages with prerequisites, each written once to a shared folder and read from there afterwards."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.made, self.took = spark, folder, {}, {}

    def add(self, name: str, make: Callable[..., DataFrame], *needs: str) -> None:
        self.made[name] = (make, needs)

    def _done(self, path: str) -> bool:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def run(self, name: str, force: bool = False) -> DataFrame:
        make, needs = self.made[name]
        path = f"{self.folder}/{name}"
        if force or not self._done(path):
            inputs = [self.run(n) for n in needs]
            began = time.time()
            make(*inputs).write.mode("overwrite").parquet(path)
            self.took[name] = time.time() - began
        return self.spark.read.parquet(path)


def structure(df: DataFrame) -> DataFrame:
    """(position, column, type) of a table."""
    return df.sparkSession.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)], "position int, column string, type string")


def column_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, low, high, mean, sigma): one pass, one row a column."""
    one = df.agg(*[F.struct(F.count(c).alias("n"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high"), F.avg(c).alias("mean"), F.stddev(c).alias("sigma")).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("s")) for c in columns])).alias("e")).select("e.column", "e.s.*")
