"""Exact order statistics of all groups at once, without the values of a group ever meeting.

Every wanted rank has an open interval that holds it. A round makes one equi-depth histogram for each interval (a
mergeable sketch of fixed size), takes the bins around the rank as a narrower interval, and counts exactly how many
values lie below, at and inside its ends, so that a sketch that is off only costs a further round. An interval shrinks
to a few thousandths of its values each time; a value that fills more than a bin is an end, and found by its count.
Once an interval holds at most ``last`` values they are looked at, and nothing else ever is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.operators.checkpoints import reliable

BINS = 1000


def _within(v: str = "_v") -> Column:
    x = F.col(v)
    return (F.col("lo").isNull() | (x > F.col("lo"))) & (F.col("hi").isNull() | (x < F.col("hi")))


def _small(df: DataFrame, most: int) -> DataFrame:
    """``df`` broadcast up to ``most`` rows of fixed size; beyond that a plain side of a join, whose hot groups are split at run time."""
    return F.broadcast(df) if df.count() <= most else df


def order_statistics(values: DataFrame, ranks: DataFrame, last: int = 1000, accuracy: int = 10_000, broadcast_rows: int = 100_000) -> DataFrame:
    """(g, rank, value): the value of each wanted rank (from 0) of a group; ``values`` has g and v, ``ranks`` g, rank and n, the group's size."""
    v = values.select(F.col("g").alias("_g"), F.col("v").alias("_v"))
    none, zero = F.lit(None).cast("double"), F.lit(0).cast("long")
    state = reliable(ranks.select("g", F.col("rank").cast("long").alias("rank")).distinct().join(ranks.select("g", "n").distinct(), "g").select("g", "rank", none.alias("lo"), none.alias("hi"), zero.alias("below"), F.col("n").alias("inside"), none.alias("value")))
    while True:
        wide = state.where(F.col("value").isNull() & (F.col("inside") > last))
        if not wide.take(1):
            break
        intervals = wide.select("g", "lo", "hi").distinct()
        splits = F.percentile_approx("_v", F.array(*[F.lit(i / BINS) for i in range(BINS + 1)]), F.lit(accuracy))
        sketched = v.join(_small(intervals, broadcast_rows), (F.col("_g") == F.col("g")) & _within()).groupBy("g", "lo", "hi").agg(splits.alias("s"))
        same = (F.col("w.g") == F.col("k.g")) & F.col("w.lo").eqNullSafe(F.col("k.lo")) & F.col("w.hi").eqNullSafe(F.col("k.hi"))
        at = F.floor((F.col("rank") - F.col("below")) / F.col("inside") * BINS).cast("int")
        picked = wide.alias("w").join(sketched.alias("k"), same).select("w.*", F.get("s", F.greatest(at - 1, F.lit(0))).alias("a"), F.get("s", F.least(at + 2, F.lit(BINS))).alias("b"))
        picked = reliable(picked)
        x, a, b = F.col("_v"), F.col("a"), F.col("b")
        counts = v.join(_small(picked.select("g", "lo", "hi", "a", "b").distinct(), broadcast_rows), (F.col("_g") == F.col("g")) & _within())
        counts = counts.groupBy("g", "lo", "hi", "a", "b").agg(F.count_if(x < a).alias("lt_a"), F.count_if(x <= a).alias("le_a"), F.count_if(x < b).alias("lt_b"), F.count_if(x <= b).alias("le_b"))
        same = same & (F.col("w.a") == F.col("k.a")) & (F.col("w.b") == F.col("k.b"))
        both = picked.alias("w").join(counts.alias("k"), same).select("w.*", "lt_a", "le_a", "lt_b", "le_b", (F.col("rank") - F.col("below")).alias("r"))
        step = lambda low, at_a, middle, at_b, high: F.when(F.col("r") < F.col("lt_a"), low).when(F.col("r") < F.col("le_a"), at_a).when(F.col("r") < F.col("lt_b"), middle).when(F.col("r") < F.col("le_b"), at_b).otherwise(high)
        lo, hi, below, inside = (F.col(c) for c in ("lo", "hi", "below", "inside"))
        narrowed = both.select(
            "g", "rank", step(lo, lo, a, lo, b).alias("lo"), step(a, hi, b, hi, hi).alias("hi"), step(below, below, below + F.col("le_a"), below, below + F.col("le_b")).alias("below"),
            step(F.col("lt_a"), inside, F.col("lt_b") - F.col("le_a"), inside, inside - F.col("le_b")).alias("inside"), step(none, a, none, b, none).alias("value"),
        )
        state = reliable(state.where(F.col("value").isNotNull() | (F.col("inside") <= last)).unionByName(narrowed))
    left = state.where(F.col("value").isNull())
    # at most ``last`` values each
    seen = v.join(_small(left.select("g", "lo", "hi").distinct(), broadcast_rows), (F.col("_g") == F.col("g")) & _within()).groupBy("g", "lo", "hi").agg(F.sort_array(F.collect_list("_v")).alias("s"))
    same = (F.col("w.g") == F.col("k.g")) & F.col("w.lo").eqNullSafe(F.col("k.lo")) & F.col("w.hi").eqNullSafe(F.col("k.hi"))
    ended = left.alias("w").join(seen.alias("k"), same).select("w.g", "rank", F.get("s", (F.col("rank") - F.col("below")).cast("int")).alias("value"))
    return state.where(F.col("value").isNotNull()).select("g", "rank", "value").unionByName(ended)


def quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], **options) -> DataFrame:
    """The columns ``by``, n, and q0, q1, ...: exact quantiles with linear interpolation, one row a group.

    Nulls and NaN take no part; groups without other values are left out.
    """
    if any(not 0.0 <= p <= 1.0 for p in probs):
        raise ValueError(f"not all between 0 and 1: {list(probs)}")
    key = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(1).alias("all"))
    v = df.select(key.alias("g"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    sizes = reliable(v.groupBy("g").agg(F.count("*").alias("n")))
    place = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(p)).cast("long"), F.ceil(place(p)).cast("long")) for p in probs])))
    found = order_statistics(v, sizes.select("g", "n", F.explode(wanted).alias("rank")), **options)
    per_group = found.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at")).join(sizes, "g")

    def between(p: float) -> Column:
        low, high = (F.col("at")[f(place(p)).cast("long")] for f in (F.floor, F.ceil))
        return low + (high - low) * (place(p) - F.floor(place(p)))

    return per_group.select(*[F.col(f"g.{c}").alias(c) for c in by], "n", *[between(p).alias(f"q{i}") for i, p in enumerate(probs)])
