"""Table maintenance: cut, gather, merge, append, sort, head, zip join, histograms, permutations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def row_index(df: DataFrame, order: Sequence[str | Column], name: str = "_row") -> DataFrame:
    """Rows numbered from 0 in a total order without one global sort task.

    Rows are range-partitioned and numbered inside their partitions; the sizes of the partitions before, one small row
    each, are added.
    """
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    from starloom.operators.checkpoints import reliable

    parts = reliable(df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    return parts.join(F.broadcast(before), "_p").withColumn(name, F.col("_i") + F.col("_before")).drop("_p", "_i", "_before")


def gather(df: DataFrame, indexes: DataFrame, row: str = "_row", at: str = "at") -> DataFrame:
    """Rows at indexes, repeated and reordered as asked: ``indexes`` has (position, at)."""
    return indexes.join(df, F.col(at) == F.col(row)).drop(row)


def cut(df: DataFrame, mask: Column) -> DataFrame:
    return df.where(mask)


def assign(df: DataFrame, mask: Column, **values: Column) -> DataFrame:
    """Masked assignment."""
    return df.withColumns({c: F.when(mask, v).otherwise(F.col(c)) for c, v in values.items()})


def _zero(kind: T.DataType) -> Column:
    if isinstance(kind, T.NumericType):
        return F.lit(0).cast(kind)
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    if isinstance(kind, T.StringType):
        return F.lit("")
    return F.lit(None).cast(kind)


def merge(tables: Sequence[DataFrame | None], columns: str | Sequence[str] = "strict") -> DataFrame:
    """Union by name in the column order of the first table; None tables are skipped.

    strict: all column sets are equal; minimal: their intersection; fillzero: their union with zeros, not nulls; or a
    list of columns.
    """
    given = [t for t in tables if t is not None]
    if not given:
        raise ValueError("no table to merge")
    names = [list(t.columns) for t in given]
    if columns == "strict":
        if any(set(n) != set(names[0]) for n in names):
            raise ValueError("tables have different columns")
        keep = names[0]
    elif columns == "minimal":
        keep = [c for c in names[0] if all(c in n for n in names)]
    elif columns == "fillzero":
        keep = names[0] + [c for i, n in enumerate(names) for c in n if not any(c in m for m in names[:i])]
        keep = list(dict.fromkeys(keep))
    else:
        keep = list(columns)
    kinds = {f.name: f.dataType for t in reversed(given) for f in t.schema.fields}
    parts = [t.select(*[F.col(c) if c in n else _zero(kinds[c]).alias(c) for c in keep]) for t, n in zip(given, names, strict=True)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def append(df: DataFrame, more: DataFrame) -> DataFrame:
    """Rows of ``more`` on the columns of ``df``."""
    return df.unionByName(more.select(*df.columns))


def zip_join(left: DataFrame, right: DataFrame, row: str = "_row", suffix: str = "_2") -> DataFrame:
    """Column merge by row number; repeated names of the right side get a suffix."""
    renamed = right.select(*[F.col(c).alias(c if c == row or c not in left.columns else f"{c}{suffix}") for c in right.columns])
    return left.join(renamed, row)


def head_per_group(df: DataFrame, n: int, group: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def paginate(df: DataFrame, order: Sequence[str | Column], page: int, size: int) -> DataFrame:
    """A page of ``size`` rows, page numbers clamped to those that exist; top-k sorts, no global one."""
    total = df.count()
    last = max(1, -(-total // size))
    page = min(max(1, page), last)
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


# --- histograms -------------------------------------------------------------------------------------------------


def bin_clamped(value: Column, low: float, width: float, n: int) -> Column:
    """Bin number; values outside fall into the end bins."""
    return F.least(F.greatest(F.floor((value - low) / width).cast("int"), F.lit(0)), F.lit(n - 1))


def histogram(df: DataFrame, value: Column, low: float, high: float, nbins: int | None = None, binsize: float | None = None) -> DataFrame:
    """(bin, n) by number of bins, of width (high - low) / (n - 1), or by width, with ceil(range / width) + 1 bins."""
    import math

    if nbins is not None:
        width, n = (high - low) / (nbins - 1), nbins
    else:
        width, n = float(binsize), math.ceil((high - low) / binsize) + 1
    return df.select(bin_clamped(value, low, width, n).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def histogram_mean(hist: DataFrame, low: float, width: float) -> DataFrame:
    """Mean by left bin edges."""
    return hist.agg((low + F.sum(F.col("n") * F.col("bin") * width) / F.sum("n")).alias("mean"))


def histogram2d(df: DataFrame, x: Column, y: Column, xlim: tuple[float, float], ylim: tuple[float, float], nx: int, ny: int, edge_x: str = "truncate", edge_y: str = "truncate") -> DataFrame:
    """(bin_x, bin_y, n); values outside are clamped (truncate) or left out (discard), per axis."""
    raw = lambda v, lim, n: F.floor((v - lim[0]) / ((lim[1] - lim[0]) / n)).cast("int")
    b = df.select(raw(x, xlim, nx).alias("bin_x"), raw(y, ylim, ny).alias("bin_y"))
    for name, edge, n in (("bin_x", edge_x, nx), ("bin_y", edge_y, ny)):
        inside = (F.col(name) >= 0) & (F.col(name) < n)
        b = b.where(inside) if edge == "discard" else b.withColumn(name, F.least(F.greatest(F.col(name), F.lit(0)), F.lit(n - 1)))
    return b.groupBy("bin_x", "bin_y").agg(F.count("*").alias("n"))


# --- order ------------------------------------------------------------------------------------------------------


def interleave(df: DataFrame, order1: Sequence[Column], order2: Sequence[Column], partition: Sequence[str] = ()) -> DataFrame:
    """Adds ``place``: rows taken alternately from two orders, skipping those already taken."""
    r1, r2 = (F.row_number().over(Window.partitionBy(*partition).orderBy(*o)) for o in (order1, order2))
    keyed = df.withColumn("_k", F.least(2 * r1, 2 * r2 + 1))
    return keyed.withColumn("place", F.row_number().over(Window.partitionBy(*partition).orderBy("_k", *order1)) - 1).drop("_k")


def running_total(df: DataFrame, order: str, amount: str, name: str = "below") -> DataFrame:
    """Sum of ``amount`` over all rows with a smaller ``order`` (distinct values), by range partitions instead of one sorted task."""
    from starloom.operators.checkpoints import reliable

    parts = reliable(df.repartitionByRange(order).withColumn("_p", F.spark_partition_id()))
    own = F.sum(amount).over(Window.partitionBy("_p").orderBy(order)) - F.col(amount)
    # one row a partition
    sizes = parts.groupBy("_p").agg(F.sum(amount).alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    return parts.withColumn(name, own).join(F.broadcast(before), "_p").withColumn(name, F.col(name) + F.col("_before")).drop("_p", "_before")


def column_mode(df: DataFrame, column: str, low: float = 0.02, high: float = 0.98, bins: int = 64, share: float = 0.5) -> DataFrame:
    """(mode, bracketed): the most common value of a column, from a bell curve fitted to one histogram.

    Values between two exact quantiles are counted in ``bins`` bins. The logarithm of a bell curve is a parabola, so one is
    fitted to the logarithms of all counts of at least ``share`` of the largest, each weighted by its count, as counts
    scatter by their square root; its vertex is the mode. It is bracketed if the parabola opens downward and the vertex
    lies among the bins used. Nulls and NaN take no part; with fewer than three such bins, or without two distinct
    values between the quantiles, the mode is null and not bracketed.
    """
    from starloom.operators.selection import quantiles

    none = df.sparkSession.createDataFrame([(None, False)], "mode double, bracketed boolean")
    ends = quantiles(df, [], column, [low, high]).first()
    if ends is None or not ends["q0"] < ends["q1"]:
        return none
    a, b = ends["q0"], ends["q1"]
    v = F.col(column).cast("double")
    counts = df.where(v.between(a, b)).groupBy(F.least(F.floor((v - a) / (b - a) * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))
    x = (F.col("bin") + 0.5) * (2.0 / bins) - 1.0
    used = counts.select(x.alias("x"), F.col("n").cast("double").alias("w"), F.log("n").alias("y"), F.max("n").over(Window.partitionBy()).alias("top")).where(F.col("w") >= share * F.col("top"))
    power = lambda of, k: F.sum(F.col("w") * of * F.pow("x", F.lit(float(k))))
    sums = used.agg(*[power(F.lit(1.0), k).alias(f"s{k}") for k in range(5)], *[power(F.col("y"), k).alias(f"t{k}") for k in range(3)], F.count("*").alias("n"), F.min("x").alias("left"), F.max("x").alias("right"))
    # the slope and twice the bend at the middle, up to a common positive factor
    slope = F.expr("s0 * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s3 * s2) + s2 * (s1 * t2 - t1 * s2)")
    bend = F.expr("s0 * (s2 * t2 - t1 * s3) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s3 - s2 * s2)")
    vertex = sums.select("left", "right", F.when(F.col("n") >= 3, -slope / (2.0 * F.nullif(bend, F.lit(0.0)))).alias("t"), (bend < 0).alias("down"))
    mode = a + (F.col("t") + 1.0) / 2.0 * (b - a)
    return vertex.select(mode.alias("mode"), F.coalesce(F.col("down") & F.col("t").between(F.col("left"), F.col("right")), F.lit(False)).alias("bracketed"))


# --- linear algebra over rows -----------------------------------------------------------------------------------


def transpose_product(entries: DataFrame, vector: DataFrame) -> DataFrame:
    """(c, product): transpose of a sparse matrix (r, c, v) times a vector (r, value); columns without entries are left out.

    One equi-join on the row and one partial aggregate over columns; a null value counts as nothing.
    """
    return entries.join(vector, "r").groupBy("c").agg(F.sum(F.col("v") * F.col("value")).alias("product"))


def plane_fit(df: DataFrame, group: Column, x1: str, x2: str, targets: Sequence[str]) -> DataFrame:
    """Least squares of several right-hand sides on two regressors and a constant, a row for each group.

    One aggregate of moments about the means, whatever the number of right-hand sides: g, and for each target t the
    columns t_1, t_2 and t_0. Rows with a null in a column that is used are left out; where the regressors are
    linearly dependent, all coefficients are null.
    """
    used = df.select(group.alias("g"), *[F.col(c).cast("double").alias(c) for c in (x1, x2, *targets)]).na.drop(subset=[x1, x2, *targets])
    moments = {"xx": F.var_pop(x1), "yy": F.var_pop(x2), "xy": F.covar_pop(x1, x2), "mx": F.avg(x1), "my": F.avg(x2)}
    for i, t in enumerate(targets):
        moments |= {f"xt{i}": F.covar_pop(x1, t), f"yt{i}": F.covar_pop(x2, t), f"mt{i}": F.avg(t)}
    whole = F.col("xx") * F.col("yy")
    det = whole - F.col("xy") * F.col("xy")
    # rounding leaves a dependent pair with a tiny determinant rather than none
    m = used.groupBy("g").agg(*[v.alias(k) for k, v in moments.items()]).withColumn("det", F.when(det > 1e-12 * whole, det))
    out = [F.col("g")]
    for i, t in enumerate(targets):
        one = (F.col("yy") * F.col(f"xt{i}") - F.col("xy") * F.col(f"yt{i}")) / F.col("det")
        two = (F.col("xx") * F.col(f"yt{i}") - F.col("xy") * F.col(f"xt{i}")) / F.col("det")
        out += [one.alias(f"{t}_1"), two.alias(f"{t}_2"), (F.col(f"mt{i}") - one * F.col("mx") - two * F.col("my")).alias(f"{t}_0")]
    return m.select(*out)
