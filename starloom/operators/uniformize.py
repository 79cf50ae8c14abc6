"""Even coverage: best-k per cell, round-robin over grids, greedy de-duplication."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.functions import healpix as hp


def sweeps(df: DataFrame, cell: Column, order: Sequence[Column], n: int) -> DataFrame:
    """The best ``n`` rows of each cell with their rank from 0 as ``sweep``."""
    w = Window.partitionBy("cell").orderBy(*order)
    return df.withColumn("cell", cell).withColumn("sweep", F.row_number().over(w) - 1).where(F.col("sweep") < n)


def grid_shape(width: float, height: float, boxes: int) -> tuple[int, int]:
    """Columns and rows of a grid of about ``boxes`` boxes over a rectangle, the boxes as square as whole numbers allow.

    Square boxes would need this many columns; of the two whole numbers beside it, the one with the squarer boxes wins.
    """
    wish = math.sqrt(boxes * width / height)
    shapes = []
    for columns in {max(1, math.floor(wish)), max(1, math.ceil(wish))}:
        rows = max(1, math.floor(boxes / columns + 0.5))
        shapes.append((abs(math.log(width / columns) - math.log(height / rows)), columns, rows))
    return min(shapes)[1:]


def round_robin(df: DataFrame, x: str, y: str, order: str, boxes: int) -> DataFrame:
    """Sources in turns, one from each box of an even grid: their box, their ``turn`` in it by ``order``, and ``place``, the place from 0 in the list that takes the first of every box, then the second of every box.

    Positions that are null or not finite are left out. Without any extent in x or y there is one box.
    """
    from starloom.operators.tables import row_index

    at = df.where(" AND ".join(f"abs(`{c}`) < double('infinity')" for c in (x, y)))
    span = at.agg(*[f(c).cast("double").alias(f"{n}_{k}") for k, c in (("x", x), ("y", y)) for n, f in (("low", F.min), ("high", F.max))]).first()
    flat = span["low_x"] is None or span["low_x"] == span["high_x"] or span["low_y"] == span["high_y"]
    if flat:
        boxed = at.withColumn("box", F.lit(0))
    else:
        columns, rows = grid_shape(span["high_x"] - span["low_x"], span["high_y"] - span["low_y"], boxes)
        # the upper edge itself counts as beyond the last box
        cell = lambda c, k, n: F.least(F.width_bucket(F.col(c).cast("double"), F.lit(span[f"low_{k}"]), F.lit(span[f"high_{k}"]), F.lit(n)), F.lit(n)) - 1
        boxed = at.withColumn("box", (cell(y, "y", rows) * columns + cell(x, "x", columns)).cast("int"))
    turned = boxed.withColumn("turn", F.row_number().over(Window.partitionBy("box").orderBy(order)))
    return row_index(turned, ["turn", "box"], "place")


def greedy_dedup(x: np.ndarray, radius: float) -> np.ndarray:
    """Indexes kept when rows, best first, drop every later row within ``radius`` of a kept one."""
    size = max(radius, 1e-300)
    grid: dict[tuple, list[int]] = {}
    kept = []
    shifts = np.stack(np.meshgrid(*[[-1, 0, 1]] * x.shape[1], indexing="ij"), axis=-1).reshape(-1, x.shape[1])
    for i, p in enumerate(x):
        own = np.floor(p / size).astype(np.int64)
        near = [j for s in shifts for j in grid.get(tuple(own + s), ())]
        if near and (((x[near] - p) ** 2).sum(axis=1) <= radius * radius).any():
            continue
        kept.append(i)
        grid.setdefault(tuple(own), []).append(i)
    return np.array(kept, int)


def uniformize_catalogue(df: DataFrame, nside: int, n_sweeps: int, dedup_deg: float = 0.0, super_nside: int | None = None, sort_col: str | None = None, ascending: bool = True, min_cut: float | None = None) -> DataFrame:
    """Best ``n_sweeps`` stars of each cell (``cell``, ``sweep``), without stars within ``dedup_deg`` of a better one.

    De-duplication is ordered, so it runs as a kernel per super-cell over the stars of the super-cell and of a margin
    of one fine cell around it; margin stars take part but are returned by their own super-cell. Stars and margins are
    dealt out by super-cell, whose number bounds a group.
    """
    if min_cut is not None and sort_col:
        df = df.where(F.col(sort_col) > min_cut)
    fine = df.withColumn("cell", hp.radec_to_cell("ra", "dec", nside))
    order = [F.col(sort_col).asc() if ascending else F.col(sort_col).desc(), F.col("id")] if sort_col else [F.col("id")]
    if not dedup_deg:
        return fine.withColumn("sweep", F.row_number().over(Window.partitionBy("cell").orderBy(*order)) - 1).where(F.col("sweep") < n_sweeps)
    super_nside = super_nside or max(1, nside // 4)
    spread = fine.withColumn("own", hp.convert_nside("cell", nside, super_nside))
    cells = spread.select("cell").distinct().withColumn("near", hp.neighbours(nside)("cell"))
    area = F.array_distinct(F.transform(F.concat(F.array("cell"), F.col("near")), lambda c: hp.convert_nside(c, nside, super_nside)))
    dealt = spread.join(cells.select("cell", F.explode(area).alias("area")), "cell")
    schema = dealt.drop("area").withColumn("sweep", F.lit(0)).schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        area = pdf["area"].iloc[0]
        keys = [sort_col, "id"] if sort_col else ["id"]
        pdf = pdf.sort_values(keys, ascending=[ascending, True][-len(keys) :] if sort_col else True, kind="stable").reset_index(drop=True)
        v = hp.np_radec_to_xyz(pdf["ra"].to_numpy(), pdf["dec"].to_numpy())
        radius = 2 * math.sin(math.radians(dedup_deg) / 2)
        full: dict[int, int] = {}
        grid: dict[tuple, list[int]] = {}
        kept, sweep = [], []
        for i, (p, c) in enumerate(zip(v, pdf["cell"].to_numpy(), strict=True)):
            if full.get(c, 0) >= n_sweeps:
                continue
            own = np.floor(p / radius).astype(int)
            near = [j for a in (-1, 0, 1) for b in (-1, 0, 1) for e in (-1, 0, 1) for j in grid.get((own[0] + a, own[1] + b, own[2] + e), ())]
            if near and (((v[near] - p) ** 2).sum(axis=1) <= radius * radius).any():
                continue
            grid.setdefault(tuple(own), []).append(i)
            kept.append(i), sweep.append(full.get(c, 0))
            full[c] = full.get(c, 0) + 1
        out = pdf.iloc[kept].assign(sweep=np.array(sweep, np.int32))
        return out[out["own"] == area].drop(columns="area")[[f.name for f in schema.fields]]

    return dealt.groupBy("area").applyInPandas(run, schema).drop("own")
