"""Streams: queue polling, chunked ingest, windows over events, incremental coadds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def events(spark: SparkSession, folder: str, schema, max_files: int | None = 1, glob: str = "events.parquet") -> DataFrame:
    """The events table as a file stream, ``max_files`` files a batch, or all that are there."""
    s = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    s = s if max_files is None else s.option("maxFilesPerTrigger", max_files)
    return s.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    agg = stream.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return agg.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    agg = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return agg.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def incremental_coadd(stream: DataFrame) -> DataFrame:
    """Weighted sums of a pixel stream (x, y, v, w); a snapshot divides them at any time."""
    return stream.groupBy("x", "y").agg(F.sum(F.col("v") * F.col("w")).alias("sum"), F.sum("w").alias("weight"))


def snapshot(sums: DataFrame) -> DataFrame:
    return sums.select("x", "y", F.when(F.col("weight") > 0, F.col("sum") / F.col("weight")).alias("v"), (F.col("weight") <= 0).alias("bad"))


def poll_queue(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, every: str = "5 seconds", once: bool = False) -> StreamingQuery:
    """Hand every batch of new rows to ``work``; progress survives restarts in the checkpoint."""
    w = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return w.trigger(availableNow=True).start() if once else w.trigger(processingTime=every).start()


def drain(stream: DataFrame, folder: str, mode: str, keys: list[str] | None = None, tasks: int | None = None) -> DataFrame:
    """Run a stream over all that is there into Parquet files under a shared ``folder``, each batch in a part of its own.

    In ``append`` mode every row is written once. In ``update`` mode a key's row is written whenever it changes, and the
    one of the last batch is read. Batches are written by the executors and written again whole if they are repeated.
    ``tasks`` is for streams of few keys: over how many tasks their states are dealt, each of which takes time in every
    batch, if not over all shuffle partitions.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")

    name = "spark.sql.shuffle.partitions"
    usual = spark.conf.get(name)
    spark.conf.set(name, str(min(int(usual), tasks or int(usual))))
    try:
        q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, usual)
    q.awaitTermination()
    got = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema.fields)}, batch long").parquet(f"{folder}/out")
    if keys is None:
        return got.drop("batch")
    rest = [c for c in stream.columns if c not in keys]
    return got.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("b")).select(*keys, "b.*")
