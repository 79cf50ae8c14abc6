"""Removal of sources along straight artefacts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remove_axis_lines(df: DataFrame, coord: str, cut: float = 100.0, width: float = 1.0, offset: float = 0.5) -> DataFrame:
    """Drop sources in over-full bins of one coordinate.

    Bins of ``width`` from ``-offset`` with more than one source are occupied; with k = count - 1 and mean k over them,
    a bin is bad if k log(mean) - mean - k (k - 1) / 2 is under ``-cut``. (The last term stands where the logarithm of
    a factorial would; it defines the operator's results and is kept.) Counts are a partial aggregate over bins, the mean
    a scalar subquery, and bad bins leave by an anti-join.
    """
    b = F.floor((F.col(coord) + offset) / width).cast("long")
    counts = df.groupBy(b.alias("_bin")).agg((F.count("*") - 1).alias("_k")).where("_k > 0")
    mean = counts.agg(F.avg("_k")).scalar()
    log_p = F.col("_k") * F.log(mean) - mean - F.col("_k") * (F.col("_k") - 1) / 2
    bad = counts.where(log_p < -cut).select("_bin")
    return df.join(bad, b == F.col("_bin"), "left_anti")


def remove_rotated_lines(df: DataFrame, x: str, y: str, width: float, height: float, angles: int = 180, cut: float = 100.0, bin_size: float = 1.0) -> DataFrame:
    """Drop sources on over-full lines at any angle: votes in (angle, distance) against what the line's length expects.

    Each source votes once an angle, so the table of votes is ``angles`` times the sources at most before the partial
    aggregate; an angle's bins are compared with the density over the image times the chord of the line in the image.
    Bad lines, whose number the angles and the bins across the image bound, are one array that every source is tested
    against in place: the sources are neither copied again nor shuffled.
    """
    theta = F.transform(F.sequence(F.lit(0), F.lit(angles - 1)), lambda i: i * (math.pi / angles))
    r = lambda t: F.floor(((F.col(x) - width / 2) * F.cos(t) + (F.col(y) - height / 2) * F.sin(t)) / bin_size).cast("long")
    votes = df.select(x, y, F.explode(theta).alias("_t")).groupBy("_t", r(F.col("_t")).alias("_r")).agg(F.count("*").alias("_n"))
    total = df.agg(F.count("*")).scalar()
    mean = F.greatest(total / (width * height) * bin_size * chord_length(F.col("_t"), (F.col("_r") + 0.5) * bin_size, width, height), F.lit(1e-3))
    log_p = F.col("_n") * F.log(mean) - mean - (F.col("_n") * F.log(F.col("_n").cast("double")) - F.col("_n"))
    bad = votes.where((F.col("_n") > mean) & (log_p < -cut)).agg(F.collect_list(F.struct("_t", "_r"))).scalar()
    on_line = F.exists("_bad", lambda line: r(line["_t"]) == line["_r"])
    return df.withColumn("_bad", bad).where(~F.coalesce(on_line, F.lit(False))).drop("_bad")


def chord_length(theta: Column, r: Column, width: float, height: float) -> Column:
    """Length of the line at distance ``r`` from the centre, with normal angle ``theta``, inside a rectangle."""
    c, s = F.abs(F.cos(theta)), F.abs(F.sin(theta))
    d = F.abs(r)
    half = (width * c + height * s) / 2
    inner = F.abs(width * c - height * s) / 2
    full = F.least(F.lit(width) / F.greatest(s, F.lit(1e-9)), F.lit(height) / F.greatest(c, F.lit(1e-9)))
    return F.when(d >= half, F.lit(0.0)).when(d <= inner, full).otherwise(full * (half - d) / F.greatest(half - inner, F.lit(1e-9)))
