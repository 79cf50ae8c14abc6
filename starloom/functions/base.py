"""Small helpers of the Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str | float | int


def col(value: C) -> Column:
    """A column by name, a literal, or the column itself."""
    return value if isinstance(value, Column) else F.col(value) if isinstance(value, str) else F.lit(value)


def f64(value: C) -> Column:
    return F.lit(float(value)) if isinstance(value, int | float) else col(value).cast("double")


def clip(value: Column, low: Column | float, high: Column | float) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.least(F.greatest(value, as_col(low)), as_col(high))


def let(value: Column, use) -> Column:
    """``use`` applied to a value that is computed once, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)
