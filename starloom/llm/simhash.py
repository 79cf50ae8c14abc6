"""Near-duplicate detection by SimHash with deletion-variant signatures.

Fingerprints of 64 bits are cut into two halves. If two fingerprints differ in at most three bits, one of the halves
differs in at most one bit, so the two share that half with one position struck out. Every distinct fingerprint is
indexed under its 64 one-wildcard halves, an equality shuffle brings candidates together and the full distance is
verified. A bucket with more than ``bucket`` members is split by the same rule on the bits that its key leaves open
(16-bit, then 8-bit pieces), after which at most 2**11 different fingerprints can meet: hot buckets are refined, never
capped. Exact copies collapse into one fingerprint before any of this, and buckets emit spanning edges, not pairs.

Edge cases: a null or blank text has fingerprint zero and is linked like any other; fewer words than a shingle make
one shingle of the whole sequence; rows with a null id take part, but only non-null ids name a component; repeated rows
fall into one component; an empty table gives an empty result; a very long text is read whole by one task, its shingles in
blocks. Further columns of the input are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from starloom.llm.common import map_arrow, reliable, unused
from starloom.operators.graph import components

MAX_BITS = 3
SHINGLE = 3
BLOCK = 1 << 15


def simhash64(text: str | None, shingle: int = SHINGLE, seed: int = 42) -> int:
    """Fingerprint of a text: a bit is set if it is set in over half the shingle hashes."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    if len(words) < shingle:
        shingles, n = iter([b" ".join(words)]), 1
    else:
        shingles, n = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)), len(words) - shingle + 1
    counts = np.zeros(64, np.int64)
    hashes = map(xxh64_intdigest, shingles, repeat(seed))
    while len(block := np.fromiter(islice(hashes, BLOCK), "<u8")):
        counts += np.add.reduce(np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): the 64-bit fingerprint of every row as a signed long."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = np.array([simhash64(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

        return step

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), make, "doc_id long, fp long")


def _spanning(fps: np.ndarray, max_bits: int) -> Iterator[tuple[int, int]]:
    """Edges (root, member) of a spanning forest over the fingerprints within ``max_bits`` of each other."""
    left = np.sort(np.unique(fps))
    while len(left) > 1:
        root, left = left[0], left[1:]
        frontier = np.array([root])
        while len(frontier) and len(left):
            near = np.zeros(len(left), bool)
            for lo in range(0, len(frontier), 256):
                near |= (np.bitwise_count(frontier[lo : lo + 256, None] ^ left[None, :]) <= max_bits).any(axis=0)
            frontier, left = left[near], left[~near]
            yield from zip(repeat(int(root)), frontier.tolist())


def _linker(max_bits: int, bucket: int | None):
    """Over rows sorted by key: spanning edges of each bucket; buckets beyond ``bucket`` rows come back as hot rows."""
    schema = pa.schema([("hot", pa.bool_()), ("key", pa.int64()), ("path", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said: set[tuple[int, int]] = set()
        keep = (np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64))  # the open bucket's rows
        overflowing: int | None = None

        def link(fps: np.ndarray) -> list[tuple[int, int]]:
            new = [e for e in _spanning(fps.view(np.uint64), max_bits) if e not in said]
            if len(said) > 500_000:
                said.clear()
            said.update(new)
            return new

        def rows(hot: bool, key, path, a, b) -> pa.RecordBatch:
            n = len(a)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, hot)), pa.array(key, pa.int64()), pa.array(path, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

        def edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
            e = np.array(found, np.uint64).view(np.int64)
            return rows(False, np.zeros(len(e), np.int64), np.zeros(len(e), np.int32), e[:, 0], e[:, 1])

        for batch in batches:
            key, path, fp = (np.concatenate([k, batch.column(i).to_numpy(zero_copy_only=False)]) for i, k in enumerate(keep))
            cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ends = np.append(cuts[1:], len(key))
            found: list[tuple[int, int]] = []
            for s, e in zip(cuts[:-1][ends[:-1] - cuts[:-1] > 1].tolist(), ends[:-1][ends[:-1] - cuts[:-1] > 1].tolist(), strict=True):
                if key[s] == overflowing or bucket and e - s > bucket:
                    yield rows(True, key[s:e], path[s:e], fp[s:e], fp[s:e])
                else:
                    found += link(fp[s:e])
            # a bucket that began as hot may end with a single row here
            if len(cuts) > 1 and overflowing is not None and key[0] == overflowing and ends[0] == 1:
                yield rows(True, key[:1], path[:1], fp[:1], fp[:1])
            s = int(cuts[-1])
            keep = (key[s:], path[s:], fp[s:])
            if overflowing is not None and key[s] != overflowing:
                overflowing = None
            if key[s] == overflowing or bucket and len(key) - s > bucket:
                overflowing = int(key[s])
                yield rows(True, *keep, keep[2])
                keep = (np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64))
            if found:
                yield edges(found)
        if len(keep[0]):
            if overflowing is not None and keep[0][0] == overflowing:
                yield rows(True, *keep, keep[2])
            elif len(keep[0]) > 1 and (found := link(keep[2])):
                yield edges(found)

    return run


def _first_keys(fps: DataFrame) -> DataFrame:
    """64 one-wildcard halves of each fingerprint; path tells which half is used."""
    i = F.col("i")
    half = F.when(i < 32, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32))
    masked = half.bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, i % 32)")))
    return fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).select(
        masked.bitwiseOR(F.expr("shiftleft(cast(i as long), 32)")).alias("key"), F.floor(i / 32).cast("int").alias("path"), "fp"
    )


def _finer_keys(hot: DataFrame, level: int) -> DataFrame:
    """One-wildcard pieces of the bits that the key so far leaves open: 16-bit pieces at level 2, 8-bit ones at level 3."""
    width = {2: 16, 3: 8}[level]
    if level == 2:  # path: the half in use; the other half is open
        open_bits = F.when(F.col("path") == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    else:  # path = half + 2 * (1 + piece in use): the other 16-bit piece of the open half is open
        open_half = F.when(F.col("path") % 2 == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
        open_bits = F.when(F.floor(F.col("path") / 2) == 1, F.shiftrightunsigned(open_half, 16)).otherwise(open_half.bitwiseAND(F.lit(0xFFFF)))
    spread = hot.select("key", "path", "fp", open_bits.alias("o"), F.explode(F.sequence(F.lit(0), F.lit(2 * width - 1))).alias("i"))
    piece = F.expr(f"(shiftrightunsigned(o, {width} * cast(floor(i / {width}) as int)) & {(1 << width) - 1}L) & ~shiftleft(1L, i % {width})")
    path = (F.col("path") + 2 * (1 + F.floor(F.col("i") / width))).cast("int") if level == 2 else F.col("path")
    return spread.select(F.xxhash64("key", "i", piece).alias("key"), path.alias("path"), "fp")


def links(fps: DataFrame, max_bits: int = MAX_BITS, bucket: int = 2048) -> DataFrame:
    """(a, b): edges that connect exactly the distinct fingerprints reachable over distances of at most ``max_bits`` (3 at most)."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments hold one wildcard each: at most three differing bits")
    out, keyed = None, _first_keys(fps)
    for level in (1, 2, 3):
        found = reliable(
            keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_linker(max_bits, bucket if level < 3 else None), "hot boolean, key long, path int, a long, b long")
        )
        edges = found.where(~F.col("hot")).select("a", "b")
        out = edges if out is None else out.unionByName(edges)
        hot = found.where("hot").select("key", "path", F.col("a").alias("fp"))
        if level == 3 or hot.isEmpty():
            return out
        keyed = _finer_keys(hot, level + 1)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS, bucket: int = 2048) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id, group_fp (one value per component)."""
    fps = reliable(fingerprints(docs, id_col, text_col, shingle))
    classes = reliable(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")))
    comp = components(links(classes.select("fp"), max_bits, bucket))
    named = comp.join(classes, comp["node"] == classes["fp"]).select("node", "root", "first_id")
    ids = named.groupBy("root").agg(F.min("first_id").alias("linked_id"))
    linked = reliable(named.join(ids, "root").select(F.col("node").alias("fp"), "root", "linked_id"))
    labels = reliable(classes.join(linked, "fp", "left").select("fp", "copies", F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("linked_id")).alias("component_id"), F.coalesce("root", "fp").alias("group_fp")))
    # fingerprints with more than a 2000th of all rows are 2000 at most: their labels are broadcast, so that no task gets all copies
    common = F.col("copies") > labels.agg(F.sum("copies")).first()[0] / 2000 if not labels.isEmpty() else F.lit(False)
    hot = F.broadcast(labels.where(common).drop("copies").select(F.col("fp").alias("hot_fp"), F.col("component_id").alias("hot_id"), F.col("group_fp").alias("hot_group")))
    rows = fps.join(hot, F.col("fp") == F.col("hot_fp"), "left")
    done = rows.where(F.col("hot_fp").isNotNull()).select("doc_id", "fp", F.col("hot_id").alias("component_id"), F.col("hot_group").alias("group_fp"))
    rest = rows.where(F.col("hot_fp").isNull()).select("doc_id", "fp").join(labels.where(~common).drop("copies"), "fp").select("doc_id", "fp", "component_id", "group_fp")
    return done.unionByName(rest).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group_fp")


def keep_one(docs: DataFrame, broadcast_rows: int = 200_000, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, **options) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, the one with the smallest id.

    Rows to drop are found on (id, fingerprint) alone and removed by an anti-join, so texts are shuffled only if more
    than ``broadcast_rows`` counted ids go. Rows that share an id, or have none, are told apart by their fingerprint;
    of several rows that qualify for one group the one with the smallest text stays.
    """
    _u, _fp, _c, _g, _n = unused(docs, "u", "fp", "c", "g", "n")
    labels = reliable(near_duplicates(docs, id_col, text_col, shingle, **options))
    unclear = reliable(labels.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias(_u)))
    drop = labels.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(_u)).where(F.col(_u).isNotNull()).unionByName(unclear).distinct()
    drop = reliable(drop)
    side = F.broadcast(drop) if drop.count() <= broadcast_rows else drop
    key = F.col(id_col).cast("long")
    clear = docs.join(side, key.eqNullSafe(F.col(_u)), "left_anti")
    if unclear.isEmpty():
        return clear
    print_of = F.pandas_udf(lambda texts: texts.map(lambda t: f"{simhash64(t, shingle):016x}"), "string")
    rows = docs.join(unclear, key.eqNullSafe(F.col(_u)), "left_semi").withColumn(_fp, print_of(F.col(text_col).cast("string")))
    groups = labels.select(F.col("fingerprint").alias(_fp), F.col("component_id").alias(_c), F.col("group_fp").alias(_g)).distinct()
    first = Window.partitionBy(_g).orderBy(F.col(text_col).asc_nulls_first())
    one = rows.join(groups, _fp).where(key.eqNullSafe(F.col(_c))).withColumn(_n, F.row_number().over(first)).where(F.col(_n) == 1)
    return clear.unionByName(one.select(docs.columns))
