"""Image queries on made-up images of Gaussian stars, one per supplier nation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from starloom.operators import images as im
from starloom.operators import tables as tb
from starloom.plans.registry import query, table

SIZE = 48


def star_images(spark, d):
    """(image_id, nx, ny, pixels) with a handful of stars from a seed per nation."""

    def run(batches):
        for pdf in batches:
            rows = []
            for key in pdf["n_nationkey"]:
                rng = np.random.default_rng(int(key))
                yy, xx = np.mgrid[0:SIZE, 0:SIZE]
                img = 100 + rng.normal(0, 1, (SIZE, SIZE))
                for i in range(5):
                    cx, cy = 6 + (i * 9 + key) % 37, 6 + (i * 17 + 3 * key) % 37
                    img += 200.0 / (1 + i) * np.exp(-0.5 * ((xx - cx) ** 2 + (yy - cy) ** 2) / 1.44)
                rows.append((int(key), SIZE, SIZE, img.ravel().round(4).tolist()))
            yield pd.DataFrame(rows, columns=["image_id", "nx", "ny", "pixels"])

    return table(spark, d, "nation").select("n_nationkey").mapInPandas(run, "image_id long, nx int, ny int, pixels array<double>")


@query()
def extract_sources(spark, d):
    return im.extract(star_images(spark, d)).select("image_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round("flux", 3).alias("flux"), F.round("background", 3).alias("background"))


@query()
def image_statistics(spark, d):
    p = im.pixels(star_images(spark, d))
    return p.groupBy("image_id").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.round(F.avg("v"), 4).alias("mean"), F.round(F.percentile("v", F.lit(0.5)), 4).alias("median"))


@query()
def image_kernels(spark, d):
    """Smoothing, medians, noise, regions, resampling and stretches of every image, as digests."""

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                img = np.asarray(r.pixels, float).reshape(r.ny, r.nx)
                gx, gy = np.meshgrid(np.arange(10.0, 30.0, 0.5), np.arange(10.0, 30.0, 0.5))
                half = img > 150
                vals = (im.smooth(img, 1.0).max(), im.median_filter(img, 1).mean(), im.noise_sigma(img), im.connected(half).max(), im.resample(img, gx, gy, 3).mean(), im.resample(img, gx, gy).mean(), im.stretch(img).mean(), im.block_average(img, 2).mean(), im.patch_holes(img, ~half).max())
                rows.append((r.image_id, *[round(float(v), 4) for v in vals]))
            yield pd.DataFrame(rows, columns=["image_id", "smooth", "median", "sigma", "regions", "lanczos", "nearest", "stretch", "blocks", "patched"])

    return star_images(spark, d).mapInPandas(run, "image_id long, smooth double, median double, sigma double, regions double, lanczos double, nearest double, stretch double, blocks double, patched double")


@query("SELECT l_suppkey AS id, list_transform(list_zip(list(l_quantity ORDER BY l_orderkey, l_partkey, l_linenumber, l_shipdate), list(l_tax ORDER BY l_orderkey, l_partkey, l_linenumber, l_shipdate)), lambda p: round(p[1] * 2 - p[2], 6)) AS pixels FROM lineitem GROUP BY 1")
def image_arithmetic(spark, d):
    """Pixel-wise arithmetic of two image arrays."""
    t = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate", "l_quantity", "l_tax"))).alias("p"))
    return t.select("id", F.zip_with("p.l_quantity", "p.l_tax", lambda a, b: F.round(a * 2 - b, 6)).alias("pixels"))


@query("SELECT l_suppkey % 16 AS x, l_partkey % 16 AS y, sum(l_quantity) AS v, round(percent_rank() OVER (ORDER BY sum(l_quantity)), 6) AS rank FROM lineitem GROUP BY 1, 2")
def rank_stretch(spark, d):
    """Histogram equalisation of a pixel table: rank of each distinct value by counts over range partitions."""
    p = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 16).alias("x"), (F.col("l_partkey") % 16).alias("y")).agg(F.sum("l_quantity").alias("v"))
    below = tb.running_total(p.groupBy("v").agg(F.count("*").alias("n")), "v", "n")
    total = p.agg(F.count("*").alias("total")).scalar()
    return p.join(below, "v").select("x", "y", "v", F.round(F.col("below") / (total - 1), 6).alias("rank"))
