"""Areas of the sky with a margin, found by growing each area cell by cell until the margin is covered."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions import healpix as hp
from starloom.operators.checkpoints import reliable, spread


def _reach(cells: np.ndarray, nside: int) -> np.ndarray:
    """Degrees from the centre of each cell to the farthest of its corners and edge middles, with some room for curved edges."""
    ends = [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.5, 0.0), (0.0, 0.5), (1.0, 0.5), (0.5, 1.0)]
    middle = hp.np_cell_to_xyz(cells, nside)
    far = np.max([np.linalg.norm(hp.np_cell_to_xyz(cells, nside, *e) - middle, axis=1) for e in ends], axis=0)
    return np.degrees(2 * np.arcsin(np.minimum(far / 2, 1.0))) * 1.05


def margins(spark: SparkSession, area_nside: int, nside: int, margin_deg: float) -> DataFrame:
    """(area, cell, whole): the fine cells outside each coarse one that may hold a point within the margin of it.

    ``whole`` cells lie within the margin altogether. The growth begins at the cells along an area's edge; each round
    takes the neighbours of the cells found last that are new to their area, and keeps those whose nearest point can be
    within the margin; it ends with the round that keeps none, after about the margin in cells. All areas grow at once;
    a round is one shuffle of their rims.
    """
    if nside % area_nside:
        raise ValueError(f"cells of nside {nside} do not fill those of {area_nside}")
    own = lambda c: hp.convert_nside(c, nside, area_nside)

    def measured(batches):
        for pdf in batches:
            cells = pdf["cell"].to_numpy()
            gap = hp.np_distances_deg(pdf["area"].to_numpy(), area_nside, hp.np_cell_to_xyz(cells, nside))
            reach = _reach(cells, nside)
            keep = gap - reach <= margin_deg
            yield pd.DataFrame({"area": pdf["area"], "cell": cells, "whole": gap + reach <= margin_deg})[keep]

    def around(rim: DataFrame) -> DataFrame:
        near = rim.select("area", F.explode(hp.neighbours(nside)("cell")).alias("cell"))
        return near.where(own(F.col("cell")) != F.col("area")).distinct()

    every = spark.range(12 * nside * nside).select(own(F.col("id")).alias("area"), F.col("id").alias("cell"))
    schema = "area long, cell long, whole boolean"
    rim = found = reliable(spread(around(every), "area", "cell").mapInPandas(measured, schema))
    while not rim.isEmpty():
        new = around(rim).join(found.select("area", "cell"), ["area", "cell"], "left_anti")
        rim = reliable(spread(new, "area", "cell").mapInPandas(measured, schema))
        found = reliable(found.unionByName(rim))
    return found


def split_with_margin(stars: DataFrame, area_nside: int, nside: int, margin_deg: float) -> DataFrame:
    """``stars`` (with ra and dec) once for each coarse cell within the margin of them, as ``area``; ``inside`` where it is their own.

    Stars join the grown areas by their fine cell; only those in cells that the margin cuts are measured one by one.
    """
    # the cell's long expression is worked out once; a small file is one partition, so its rows are dealt out first
    placed = reliable(spread(stars).withColumn("_cell", hp.radec_to_cell("ra", "dec", nside)))
    own = placed.withColumn("area", hp.convert_nside("_cell", nside, area_nside)).drop("_cell").withColumn("inside", F.lit(True))
    grown = margins(stars.sparkSession, area_nside, nside, margin_deg)
    near = placed.join(grown, placed["_cell"] == grown["cell"]).drop("_cell", "cell").withColumn("inside", F.lit(False))
    sure, cut = near.where("whole"), near.where("NOT whole").where(hp.within(area_nside, margin_deg)("area", "ra", "dec"))
    sure, cut = sure.drop("whole"), cut.drop("whole")
    return own.unionByName(sure).unionByName(cut)
