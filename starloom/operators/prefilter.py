"""What happens to a field's sources before it is solved: lines removed, order by brightness, even coverage, the first few kept.

All fields go through the chain at once: every step is an aggregate or a window by field, and a field has as many rows
as its image has sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.operators import tables as tb


def without_lines(sources: DataFrame, field: str, coordinates: list[str], cut: float = 100.0, width: float = 1.0) -> DataFrame:
    """Sources outside the over-full columns and rows of pixels of their field, one coordinate after the other.

    The statistic is that of ``lines.remove_axis_lines``, with the mean of each field.
    """
    for c in coordinates:
        at = F.floor((F.col(c) + width / 2) / width).cast("long")
        k = F.col("_k")
        bins = sources.groupBy(F.col(field).alias("_field"), at.alias("_bin")).agg((F.count("*") - 1).alias("_k")).where("_k > 0")
        bins = bins.withColumn("_mean", F.avg("_k").over(Window.partitionBy("_field")))
        bad = bins.where(k * F.log("_mean") - F.col("_mean") - k * (k - 1) / 2 < -cut).select("_field", "_bin")
        sources = sources.join(bad, F.col(field).eqNullSafe(F.col("_field")) & (at == F.col("_bin")), "left_anti")
    return sources


def boxes_by_field(sources: DataFrame, field: str, x: str, y: str, boxes: int) -> DataFrame:
    """Adds ``box``: each field's extent in about ``boxes`` boxes, as square as whole numbers allow (``uniformize.grid_shape`` for a column of fields)."""
    of_field = Window.partitionBy(field)
    low, size = ({k: f(F.col(c)) for k, c in (("x", x), ("y", y))} for f in (lambda c: F.min(c).over(of_field), lambda c: F.max(c).over(of_field) - F.min(c).over(of_field)))
    # a field without extent has null sides, and so one box
    some = lambda c: F.nullif(c.cast("double"), F.lit(0.0))
    t = sources.withColumns({"_x0": low["x"], "_y0": low["y"], "_w": some(size["x"]), "_h": some(size["y"])})
    wish = F.sqrt(F.lit(float(boxes)) * F.col("_w") / F.col("_h"))

    def shape(columns: Column) -> Column:
        rows = F.greatest(F.lit(1.0), F.floor(boxes / columns + 0.5).cast("double"))
        return F.struct(F.abs(F.log(F.col("_w") / columns) - F.log(F.col("_h") / rows)).alias("d"), columns.alias("nx"), rows.alias("ny"))

    near = [F.greatest(F.lit(1.0), f(wish).cast("double")) for f in (F.floor, F.ceil)]
    t = t.withColumn("_g", F.when(F.col("_w").isNotNull() & F.col("_h").isNotNull(), F.least(*[shape(c) for c in near])))
    cell = lambda c, k, n, s: F.least(F.floor((F.col(c) - F.col(f"_{k}0")) / F.col(s) * F.col(f"_g.{n}")), F.col(f"_g.{n}") - 1)
    box = cell(y, "y", "ny", "_h") * F.col("_g.nx") + cell(x, "x", "nx", "_w")
    return t.withColumn("box", F.coalesce(box, F.lit(0)).cast("int")).drop("_x0", "_y0", "_w", "_h", "_g")


def prefilter(sources: DataFrame, field: str = "field_id", key: str = "id", x: str = "x", y: str = "y", flux: str = "flux", background: str | None = None, cut: float | None = 100.0, boxes: int = 10, keep: int | None = None) -> DataFrame:
    """``sources`` that are left, with ``place`` from 0 in the order in which a solver takes them.

    ``cut`` is the threshold of line removal (None: none). With ``background`` the brightest by flux and by flux and
    background take turns. ``boxes`` takes turns over the field (0: not), and ``keep`` is the number that is kept.
    Sources without a position or flux go; equal ones are ordered by ``key``.
    """
    t = sources.where(" AND ".join(f"abs(`{c}`) < double('infinity')" for c in (x, y, flux)))
    if cut is not None:
        t = without_lines(t, field, [x, y], cut)
    bright = [F.col(flux).desc(), F.col(key)]
    if background is None:
        t = t.withColumn("place", F.row_number().over(Window.partitionBy(field).orderBy(*bright)) - 1)
    else:
        t = tb.interleave(t, bright, [(F.col(flux) + F.col(background)).desc(), F.col(key)], [field])
    if boxes:
        t = boxes_by_field(t, field, x, y, boxes).withColumn("_turn", F.row_number().over(Window.partitionBy(field, "box").orderBy("place")))
        t = t.withColumn("place", F.row_number().over(Window.partitionBy(field).orderBy("_turn", "box")) - 1).drop("_turn", "box")
    return t if keep is None else t.where(F.col("place") < keep)
