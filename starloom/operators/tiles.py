"""Images as tables of tiles: halos by a join, medians, backgrounds and resampling onto another header.

An image is cut into square tiles, one row each, so that its size is bounded by no task. A kernel that looks at a
neighbourhood gets its tile with a halo: every tile sends each neighbour the strip that the neighbour lacks, and a group
by the receiving tile puts at most a few strips together. Beyond the edge of the image a halo repeats the edge's pixels.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.functions.wcs import Wcs
from starloom.operators import images as im

PIECE = "image long, ty int, tx int, y0 int, x0 int, h int, w int, pixels array<double>"
TILE = "image long, ty int, tx int, h int, w int, pixels array<double>"


class ResampleError(ValueError):
    """Two headers whose images cannot be resampled onto each other."""


class NoOverlap(ResampleError):
    pass


class SmallOverlap(ResampleError):
    pass


def cut(pixels: DataFrame, width: int, height: int, size: int = 64, empty: float = 0.0) -> DataFrame:
    """Tiles (image, ty, tx, h, w, pixels row by row) of a table (image, x, y, v) of pixels from 0; those that are not given are ``empty``."""
    n_x, n_y = -(-width // size), -(-height // size)
    inside = pixels.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
    ty, tx = (F.floor(F.col(c) / size).cast("int") for c in ("y", "x"))
    held = inside.select(F.col("image").cast("long").alias("image"), ty.alias("ty"), tx.alias("tx"), F.struct((F.col("y") % size).cast("int").alias("y"), (F.col("x") % size).cast("int").alias("x"), F.col("v").cast("double").alias("v")).alias("p"))
    held = held.groupBy("image", "ty", "tx").agg(F.collect_list("p").alias("p"))
    grid = pixels.select(F.col("image").cast("long").alias("image")).distinct().select("image", F.explode(F.sequence(F.lit(0), F.lit(n_x * n_y - 1))).alias("k"))
    grid = grid.select("image", F.floor(F.col("k") / n_x).cast("int").alias("ty"), (F.col("k") % n_x).cast("int").alias("tx"))

    def fill(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                h, w = min(size, height - r.ty * size), min(size, width - r.tx * size)
                tile = np.full((h, w), empty)
                if r.p is not None:
                    for q in r.p:
                        tile[q["y"], q["x"]] = q["v"]
                rows.append((r.image, r.ty, r.tx, h, w, tile.ravel()))
            yield pd.DataFrame(rows, columns=["image", "ty", "tx", "h", "w", "pixels"])

    return grid.join(held, ["image", "ty", "tx"], "left").mapInPandas(fill, TILE)


def to_pixels(tiles: DataFrame, size: int = 64) -> DataFrame:
    """The table (image, x, y, v) of tiles."""
    p = tiles.select("image", "ty", "tx", "w", F.posexplode("pixels").alias("i", "v"))
    return p.select("image", (F.col("tx") * size + F.col("i") % F.col("w")).alias("x"), (F.col("ty") * size + F.floor(F.col("i") / F.col("w"))).cast("int").alias("y"), "v")


def map_with_halo(tiles: DataFrame, kernel: Callable[[np.ndarray, int, int, int, int], np.ndarray], halo: int, width: int, height: int, size: int = 64, clip: bool = False) -> DataFrame:
    """Every tile replaced by ``kernel(patch, y0, x0, top, left)`` of its shape, where the patch reaches ``halo`` pixels further on each side.

    y0 and x0 are the image's pixel at which the patch begins, top and left that at which the tile does. With ``clip`` a patch ends at the edge of the image
    instead of repeating the edge's pixels. A halo may be wider than a tile.
    """
    reach = -(-halo // size)

    def strips(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                tile = np.asarray(r.pixels, float).reshape(r.h, r.w)
                y0, x0 = r.ty * size, r.tx * size
                for ty in range(max(0, r.ty - reach), min(-(-height // size), r.ty + reach + 1)):
                    for tx in range(max(0, r.tx - reach), min(-(-width // size), r.tx + reach + 1)):
                        top, left = max(y0, ty * size - halo), max(x0, tx * size - halo)
                        bottom, right = min(y0 + r.h, min((ty + 1) * size, height) + halo), min(x0 + r.w, min((tx + 1) * size, width) + halo)
                        if top < bottom and left < right:
                            part = tile[top - y0 : bottom - y0, left - x0 : right - x0]
                            rows.append((r.image, ty, tx, top, left, *part.shape, part.ravel()))
            yield pd.DataFrame(rows, columns=["image", "ty", "tx", "y0", "x0", "h", "w", "pixels"])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        image, ty, tx = key
        top, left, bottom, right = ty * size, tx * size, min((ty + 1) * size, height), min((tx + 1) * size, width)
        y0, x0, y1, x1 = max(0, top - halo), max(0, left - halo), min(height, bottom + halo), min(width, right + halo)
        patch = np.full((y1 - y0, x1 - x0), np.nan)
        for r in pdf.itertuples():
            patch[r.y0 - y0 : r.y0 - y0 + r.h, r.x0 - x0 : r.x0 - x0 + r.w] = np.asarray(r.pixels, float).reshape(r.h, r.w)
        if not clip:
            patch = np.pad(patch, ((halo - (top - y0), halo - (y1 - bottom)), (halo - (left - x0), halo - (x1 - right))), mode="edge")
            y0, x0 = top - halo, left - halo
        out = kernel(patch, y0, x0, top, left)
        own = out if out.shape == (bottom - top, right - left) else out[top - y0 : bottom - y0, left - x0 : right - x0]
        return pd.DataFrame([(image, ty, tx, *own.shape, np.ascontiguousarray(own).ravel())], columns=["image", "ty", "tx", "h", "w", "pixels"])

    return tiles.mapInPandas(strips, PIECE).groupBy("image", "ty", "tx").applyInPandas(run, TILE)


# --- medians ----------------------------------------------------------------------------------------------------


def sliding_median(patch: np.ndarray, radius: int, levels: int = 1024) -> np.ndarray:
    """Medians of all windows that lie inside the patch, so the result is ``2 radius`` smaller each way.

    Values are replaced by their ranks. Every column keeps a histogram of the rows of the window, from which a row goes
    and to which one comes at each step down; the windows of a row are differences of running sums of those histograms.
    The work a pixel is a pass over the ranks, whatever the radius. A patch with more than ``levels`` different values
    would need long passes, so its windows are sorted instead, row by row.
    """
    side = 2 * radius + 1
    h, w = patch.shape[0] - 2 * radius, patch.shape[1] - 2 * radius
    values, ranks = np.unique(patch, return_inverse=True)
    ranks = ranks.reshape(patch.shape)
    out = np.empty((h, w))
    if len(values) > levels:
        for y in range(h):
            windows = np.lib.stride_tricks.sliding_window_view(patch[y : y + side], (side, side))[0]
            out[y] = np.median(windows.reshape(w, -1), axis=1)
        return out
    columns, at = np.zeros((patch.shape[1], len(values)), np.int32), np.arange(patch.shape[1])
    for y in range(side - 1):
        columns[at, ranks[y]] += 1
    half = side * side // 2
    for y in range(h):
        columns[at, ranks[y + side - 1]] += 1
        sums = np.concatenate([np.zeros((1, len(values)), np.int64), columns.cumsum(axis=0, dtype=np.int64)])
        below = (sums[side:] - sums[:-side]).cumsum(axis=1)
        out[y] = values[(below > half).argmax(axis=1)]
        columns[at, ranks[y]] -= 1
    return out


def median(tiles: DataFrame, radius: int, width: int, height: int, size: int = 64, levels: int = 1024) -> DataFrame:
    """Median filter with square windows; the edge's pixels are repeated beyond it."""
    return map_with_halo(tiles, lambda patch, *_: sliding_median(patch, radius, levels), radius, width, height, size)


def background(tiles: DataFrame, half: int, width: int, height: int, size: int = 64) -> DataFrame:
    """Medians of boxes on a grid of step ``half``, cut off at the edge, interpolated linearly between the nodes.

    The nodes are those of the whole image: a tile computes the ones around it, which it shares with its neighbours.
    """
    nodes = lambda n: np.unique(np.clip(np.arange(0, n + half, half), 0, n - 1))
    all_y, all_x = nodes(height), nodes(width)

    def near(all_nodes: np.ndarray, low: int, high: int) -> np.ndarray:
        first, last = np.searchsorted(all_nodes, low, "right") - 1, np.searchsorted(all_nodes, high, "left")
        return all_nodes[max(0, first) : last + 1]

    def kernel(patch: np.ndarray, y0: int, x0: int, top: int, left: int) -> np.ndarray:
        bottom, right = min(top + size, height), min(left + size, width)
        gy, gx = near(all_y, top, bottom - 1), near(all_x, left, right - 1)
        med = np.array([[np.median(patch[max(0, y - half - y0) : y + half + 1 - y0, max(0, x - half - x0) : x + half + 1 - x0]) for x in gx] for y in gy])
        rows = np.array([np.interp(np.arange(left, right), gx, m) for m in med])
        return np.array([np.interp(np.arange(top, bottom), gy, rows[:, i]) for i in range(right - left)]).T

    return map_with_halo(tiles, kernel, 2 * half, width, height, size, clip=True)


# --- resampling -------------------------------------------------------------------------------------------------

NODES = 4


def _surface(target: Wcs, source: Wcs, top: int, left: int, h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Source pixels (x, y from 0) of the target pixels of a tile, by a bicubic surface through 4 by 4 of them."""
    gy, gx = np.linspace(top, top + h - 1, NODES), np.linspace(left, left + w - 1, NODES)
    xx, yy = np.meshgrid(gx, gy)
    x, y = source.np_radec_to_pixel(*target.np_pixel_to_radec(xx.ravel() + 1.0, yy.ravel() + 1.0))
    x, y = x.reshape(NODES, NODES) - 1.0, y.reshape(NODES, NODES) - 1.0

    def weights(n: int) -> np.ndarray:
        """Lagrange weights (n, nodes) of the pixels of one side."""
        t, k = np.linspace(0.0, NODES - 1.0, n) if n > 1 else np.zeros(1), np.arange(NODES)
        out = np.ones((n, NODES))
        for i in k:
            for j in k[k != i]:
                out[:, i] *= (t - j) / (i - j)
        return out

    wy, wx = weights(h), weights(w)
    return wy @ x @ wx.T, wy @ y @ wx.T


def overlap(target: Wcs, source: Wcs, step: int = 8) -> tuple[int, int]:
    """Width and height of the box of the target's pixels that lie on the source, looked at every ``step`` pixels and at the edges."""
    xs, ys = (np.unique(np.append(np.arange(0, int(n), step), int(n) - 1)) for n in (target.width, target.height))
    xx, yy = np.meshgrid(xs, ys)
    with np.errstate(invalid="ignore"):
        x, y = source.np_radec_to_pixel(*target.np_pixel_to_radec(xx.ravel() + 1.0, yy.ravel() + 1.0))
        on = ((x >= 0.5) & (x <= source.width + 0.5) & (y >= 0.5) & (y <= source.height + 0.5)).reshape(xx.shape)
    if not on.any():
        return 0, 0
    return int(np.ptp(xx[on])) + 1, int(np.ptp(yy[on])) + 1


def resample(tiles: DataFrame, source: Wcs, target: Wcs, order: int = 3, size: int = 64, least: int = 16) -> DataFrame:
    """Tiles of the target's grid, from tiles of images under the ``source`` header; null where the source does not reach.

    Order 0 takes the nearest pixel, others are Lanczos windows. Every target tile asks for the source tiles that its
    pixels and the window around them lie on, an equi-join brings them, and one kernel interpolates. ``NoOverlap`` and
    ``SmallOverlap`` (under ``least`` pixels wide or high) are raised before anything runs.
    """
    wide, high = overlap(target, source)
    if not wide:
        raise NoOverlap("the source has no pixel on the target's grid")
    if min(wide, high) < least:
        raise SmallOverlap(f"the source covers {wide} by {high} pixels of the target's grid, fewer than {least} one way")
    n_x, n_y = -(-int(target.width) // size), -(-int(target.height) // size)
    s_x, s_y = -(-int(source.width) // size), -(-int(source.height) // size)
    spark = tiles.sparkSession
    shape = lambda ty, tx: (ty * size, tx * size, min(size, int(target.height) - ty * size), min(size, int(target.width) - tx * size))

    def asks(batches):
        for pdf in batches:
            rows = []
            for k in pdf["id"]:
                ty, tx = int(k) // n_x, int(k) % n_x
                x, y = _surface(target, source, *shape(ty, tx))
                if not np.isfinite(x).any():
                    continue
                x0, x1, y0, y1 = np.nanmin(x) - order - 1, np.nanmax(x) + order + 1, np.nanmin(y) - order - 1, np.nanmax(y) + order + 1
                for sy in range(max(0, int(y0 // size)), min(s_y - 1, int(y1 // size)) + 1):
                    rows += [(ty, tx, sy, sx) for sx in range(max(0, int(x0 // size)), min(s_x - 1, int(x1 // size)) + 1)]
            yield pd.DataFrame(rows, columns=["to_y", "to_x", "ty", "tx"], dtype="int32")

    wanted = spark.range(n_x * n_y).mapInPandas(asks, "to_y int, to_x int, ty int, tx int")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        image, ty, tx = key
        top, left, h, w = shape(ty, tx)
        x, y = _surface(target, source, top, left, h, w)
        y0, x0 = int(pdf["ty"].min()) * size, int(pdf["tx"].min()) * size
        y1, x1 = (max(int(r.ty) * size + r.h for r in pdf.itertuples()), max(int(r.tx) * size + r.w for r in pdf.itertuples()))
        patch = np.full((y1 - y0, x1 - x0), np.nan)
        for r in pdf.itertuples():
            patch[r.ty * size - y0 : r.ty * size - y0 + r.h, r.tx * size - x0 : r.tx * size - x0 + r.w] = np.asarray(r.pixels, float).reshape(r.h, r.w)
        on = (x > -0.5) & (x < source.width - 0.5) & (y > -0.5) & (y < source.height - 0.5)
        out = np.where(on, im.resample(patch, x - x0, y - y0, order), np.nan)
        return pd.DataFrame([(image, ty, tx, h, w, out.ravel())], columns=["image", "ty", "tx", "h", "w", "pixels"])

    met = tiles.join(F.broadcast(wanted) if n_x * n_y <= 100_000 else wanted, ["ty", "tx"])
    done = met.groupBy("image", F.col("to_y"), F.col("to_x")).applyInPandas(run, TILE)
    # target tiles that no source tile reaches
    grid = tiles.select("image").distinct().select("image", F.explode(F.sequence(F.lit(0), F.lit(n_x * n_y - 1))).alias("k"))
    grid = grid.select("image", F.floor(F.col("k") / n_x).cast("int").alias("ty"), (F.col("k") % n_x).cast("int").alias("tx"))
    h, w = (F.least(F.lit(size), F.lit(int(n)) - F.col(t) * size) for n, t in ((target.height, "ty"), (target.width, "tx")))
    bare = grid.join(done.select("image", "ty", "tx"), ["image", "ty", "tx"], "left_anti").select("image", "ty", "tx", h.alias("h"), w.alias("w"), F.array_repeat(F.lit(None).cast("double"), h * w).alias("pixels"))
    return done.unionByName(bare)
