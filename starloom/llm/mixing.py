"""Mixing sources to target weights by capped water-filling; DataFrame functions only.

Targets: every source gets ``weight * level`` words, clamped at ``max_epochs`` times its own size; the level is the one
at which the targets add up to the budget, found in closed form over the sources sorted by the level that would clamp
them. A target, rounded to words, is a number of whole repetitions of the source and a fractional one. For that one,
documents are sampled whole, in a seeded random order, until its words are reached; the document that crosses the end
gives only the words that are missing. So a source's taken words are its rounded target exactly, whatever its documents
and ids are, and no document exceeds ``max_epochs`` times its size.

The order is the hash of id and text, then the row for rows that repeat both. Where a source's sample ends is found by
narrowing: sizes are added up by the first three hexadecimal digits, then by the next three among the rows that share
those of the end, until few rows are left. That needs a few sums of at most 4,096 rows a source; documents are neither
sorted nor shuffled, and a source with a third of all rows, or a row repeated as often, is a sum like any other.

Edge cases: a null or blank text has size 0 and is taken 0 words; a null source is a source of its own, last in order;
a source of size 0 has target 0; repeated rows are mixed as separate rows; a null id hashes like the text "null"; an
empty table gives an empty result; very long texts are counted whole. Further columns of the input are ignored by
``mix`` and carried by ``repeat_rows``, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm.common import reliable, unused

SPACE = r"[\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 17


def n_words(text: Column) -> Column:
    """Number of maximal runs without ASCII white space; 0 for null."""
    return F.coalesce(F.size(F.array_remove(F.split(text, SPACE), "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size), one row per source.

    The two windows run over the table of sources in one task: rows are sources, which a pre-aggregation has made, not
    documents. Sums are whole numbers, so the level does not depend on the order of evaluation.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.select("source", "source_size", cycle.cast("long").alias("weight"))
    cap = (F.col("source_size") * max_epochs).alias("cap")
    ranked = ranked.select("*", cap, (cap / F.col("weight")).alias("clamps_at"))
    every = Window.partitionBy()
    upto = Window.orderBy("clamps_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = ranked.select(
        "*", F.sum("source_size").over(every).alias("budget"), F.sum("weight").over(every).alias("all_weight"), F.sum("cap").over(upto).alias("cap_upto"), F.sum("weight").over(upto).alias("weight_upto")
    )
    # clamped: at the level that clamps this source, all targets together still do not exceed the budget
    clamped = F.col("cap_upto") + F.col("clamps_at") * (F.col("all_weight") - F.col("weight_upto")) <= F.col("budget")
    filled = filled.withColumn("clamped", clamped)
    level = (F.col("budget") - F.sum(F.when(F.col("clamped"), F.col("cap")).otherwise(0)).over(every)) / F.sum(F.when(F.col("clamped"), 0).otherwise(F.col("weight"))).over(every)
    target = F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("level"))
    return filled.withColumn("level", level).select("source", "source_size", "weight", target.cast("double").alias("target"))


def uniform(doc_id: Column, seed: int = SEED) -> Column:
    """Seeded number in [0, 1) from the id, the same in any engine with md5."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f"|{seed}"))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def place(doc_id: Column, text: Column, row: Column, seed: int = SEED) -> Column:
    """31 hexadecimal digits that order the rows at random: 15 from id and text, then those of the row's number, last one first."""
    own = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f"|{seed}|"), F.md5(F.coalesce(text.cast("string"), F.lit("")))))
    return F.concat(F.substring(own, 1, HASHED), F.reverse(F.lpad(F.hex(row), 16, "0")))


HASHED, DIGITS, STEP, FEW = 15, 31, 3, 1_000


def _ends(sized: DataFrame, goal: DataFrame, side) -> DataFrame:
    """goal with last and cut: the fractional repetition takes the rows before ``last`` whole, and ``cut`` words of that one.

    ``sized`` has source, size and place. One pass over it for every three digits, mostly two or three in all; a window
    runs over the sums of one source by three digits, and in the end over at most ``FEW`` rows of it, or over rows that
    share all digits but the last.
    """
    edge = reliable(goal.where("part > 0").select("key", F.lit("").alias("prefix"), F.col("part").alias("left")))
    upto = Window.partitionBy("key").orderBy("next").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def crossing(rows: DataFrame) -> DataFrame:
        sums = rows.withColumn("before", F.sum("size").over(upto) - F.col("size"))
        return sums.where((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("size")))

    def inside(n: int) -> DataFrame:
        on = F.col("source").eqNullSafe(F.col("key")) if n == 0 else F.col("source").eqNullSafe(F.col("key")) & (F.substring("place", 1, n) == F.col("prefix"))
        return sized.where("size > 0").join(side(edge), on)

    for n in range(0, DIGITS, STEP):
        most = inside(n).groupBy("key").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= FEW:
            break
        sums = inside(n).groupBy("key", "prefix", "left", F.substring("place", n + 1, STEP).alias("next")).agg(F.sum("size").alias("size"))
        edge = reliable(crossing(sums).select("key", F.concat("prefix", "next").alias("prefix"), (F.col("left") - F.col("before")).alias("left")))
    else:
        n = DIGITS
    rows = inside(n).select("key", "left", "size", F.col("place").alias("next"))
    last = crossing(rows).select(F.col("key").alias("_k"), F.col("next").alias("last"), (F.col("left") - F.col("before")).alias("cut"))
    return goal.join(last, F.col("key").eqNullSafe(F.col("_k")), "left").drop("_k")


def _plan(sized: DataFrame, weights: Sequence[int], max_epochs: int, max_broadcast: int, key: str) -> DataFrame:
    """One row a source: its name under ``key``, source_size, target, whole repetitions, last and cut; broadcast if there are few."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sizes, weights, max_epochs)
    words = F.floor(F.col("target") + 0.5).cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = reliable(goal.select(F.col("source").alias("key"), "source_size", "target", whole.alias("whole"), (words - whole * F.col("source_size")).alias("part")))
    # more sources than that: plain joins, whose hot sources adaptive execution splits
    side = F.broadcast if goal.count() <= max_broadcast else lambda df: df
    return side(reliable(_ends(sized, goal, side).select(F.col("key").alias(key), "source_size", "target", "whole", "last", "cut")))


def _taken(at: str = "place", whole: str = "whole", last: str = "last", cut: str = "cut") -> Column:
    """Words that the mix takes of a document in its place."""
    part = F.when(F.col(at) < F.col(last), F.col("size")).when(F.col(at) == F.col(last), F.col(cut))
    return F.col(whole) * F.col("size") + F.coalesce(part, F.lit(0).cast("long"))


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), place(F.col("doc_id"), F.col("text"), F.monotonically_increasing_id(), seed).alias("place"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED, max_broadcast: int = 50_000) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: one row per row of ``docs``."""
    sized = reliable(_sized(docs, seed))
    plan = _plan(sized, weights, max_epochs, max_broadcast, "key")
    joined = sized.join(plan, F.col("source").eqNullSafe(F.col("key")))
    return joined.select("doc_id", "source", "size", "source_size", "target", _taken().alias("taken"))


def repeat_rows(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED, max_broadcast: int = 50_000) -> DataFrame:
    """The mixture itself: ``docs`` with a row for every repetition of a document that the mix takes.

    Adds, or replaces, size, source_size, target, taken, repetition (from 1) and words (of that repetition). Repetitions carry the
    text as it is; only the one document of a source that is cut carries the words that are missing, from a seeded
    starting point, wrapping round. Rows are told apart by their number, so ``docs`` has to be read the same way twice,
    as written tables are.
    """
    names = [c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "taken", "repetition", "words")]
    key, at, whole, last, cut = unused(docs, "key", "place", "whole", "last", "cut")
    plan = _plan(reliable(_sized(docs, seed).drop("doc_id")), weights, max_epochs, max_broadcast, key).withColumnsRenamed({"whole": whole, "last": last, "cut": cut})
    sized = docs.select(*names, n_words(F.col("text")).alias("size"), place(F.col("doc_id"), F.col("text"), F.monotonically_increasing_id(), seed).alias(at))
    taken = sized.join(plan, F.col("source").eqNullSafe(F.col(key))).withColumn("taken", _taken(at, whole, last, cut)).where("taken > 0")
    rows = taken.select("*", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))).alias("repetition"))
    words = F.least(F.col("size"), F.col("taken") - (F.col("repetition") - 1) * F.col("size"))
    rows = rows.withColumn("words", words)
    start = F.floor(uniform(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("/start")), seed) * F.col("size")).cast("int")
    all_words = F.array_remove(F.split("text", SPACE), "")
    piece = F.array_join(F.slice(F.concat(all_words, all_words), start + 1, F.col("words").cast("int")), " ")
    return rows.withColumn("text", F.when(F.col("words") < F.col("size"), piece).otherwise(F.col("text"))).select(*names, "size", "source_size", "target", "taken", "repetition", "words")
