"""Shared helpers of the training-data operators: tables, reliable checkpoints, sampling, Arrow maps."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.operators.checkpoints import ensure_checkpoint_dir, reliable

__all__ = ["ensure_checkpoint_dir", "fold_of", "fold_of_value", "frequent", "hashed_below", "map_arrow", "reliable", "table", "unused"]

PIECE = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """``mapInArrow`` with a per-task factory, so that a model is built or unpacked once a task and not once a batch.

    A batch is worked off in pieces of about ``PIECE`` bytes, which bounds the Python objects that are alive at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            rows = max(1, min(batch.num_rows, int(batch.num_rows * PIECE / max(1, batch.nbytes))))
            for lo in range(0, max(1, batch.num_rows), rows):
                out = step(batch.slice(lo, rows))
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def fold_of(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id's decimal text modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def fold_of_value(doc_id: int | None, folds: int = 5) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


def hashed_below(key: Column, share: Column | float, seed: int) -> Column:
    """True for a seeded pseudo-random ``share`` of the keys, the same on every run."""
    share = share if isinstance(share, Column) else F.lit(float(share))
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < share * float(1 << 30)


def frequent(rows: DataFrame, number: Column, most: int) -> Column:
    """A condition on ``number`` (1 or more) that at most ``most`` rows meet, and about as many as that allows.

    Numbers are counted by eighths of a power of two, so that the driver sees a few hundred rows at most.
    """
    eighth = F.floor(F.log2(number.cast("double")) * 8)
    left, floor = most, None
    for at, n in sorted(((r[0], r[1]) for r in rows.where(number > 0).groupBy(eighth.alias("e")).count().collect()), reverse=True):
        if n > left:
            break
        left, floor = left - n, at
    return F.lit(False) if floor is None else F.coalesce((number > 0) & (eighth >= floor), F.lit(False))


def unused(df: DataFrame, *stems: str) -> list[str]:
    """Column names from ``stems`` that ``df`` does not have, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    found = []
    for stem in stems:
        name = f"__{stem}"
        while name.lower() in taken:
            name = f"_{name}"
        found.append(name)
    return found
