"""Removal of lines that many documents share, through a sharded minimal perfect hash of line hashes.

A line's key (stripped of ASCII white space, A-Z lower-cased) is hashed to 128 bits. Tasks count the documents of every
key and its largest document id; partial counts are merged by a shuffle of hashes, never of lines, and keys of a single
document are dropped, as they cannot make a line go. The others are dealt to shards by their hash. A shard is a minimal
perfect hash (levels of bit maps: a key sits on the first level on which no other key left has its bit, and the number
of bits before it, over all levels, is its index), which needs about three bits a key and indexes compact arrays: the
half of the hash that did not choose the bit, as fingerprint; the number of documents; the largest id. Documents probe
those arrays where they are read. No line is joined.

All shards are broadcast if they have at most ``probe_keys`` keys, which is counted (some 25 bytes each). Beyond that,
only the most frequent keys (counted to be at most ``hot_keys``) are; the hashes of other lines, each of which is rare,
are sent to the shard that may hold them, and the positions of lines that go return to their documents by a join.

Edge cases: every row is a document, also if it repeats another's id; a null id is smaller than all others; a null or
empty text is one empty line; a document whose lines all go keeps the empty text; repeats of a line within a document
count once and stay or go together; lines with fewer than ``min_chars`` code points always stay; an empty table gives
an empty result; very long texts are one document in one task, whole. Further columns of the input are ignored by
``drop_lines`` and ``summary``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from starloom.llm.common import frequent, map_arrow, reliable

MIN_CHARS = 20
MIN_DOCS = 3
BLANK = b" \t\n\x0b\x0c\r"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: bits of a level per key that is left
ROOM = 2
SHARD_KEYS = 50_000


def line_hashes(text: str | None, min_chars: int) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a text, and the 16-byte hash of the key of each; None where the key is too short to count."""
    lines = (text or "").encode("utf-8", "replace").split(b"\n")
    hashes: list[bytes | None] = []
    for line in lines:
        key = line.strip(BLANK)
        if len(key) < min_chars or (not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars):
            hashes.append(None)
        else:
            hashes.append(xxh3_128_digest(key.translate(LOWER)))
    return lines, hashes


def halves(hashes: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(hashes), ">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _bit(high: np.ndarray, low: np.ndarray, level: int, bits: int) -> np.ndarray:
    """The bit of every key on a level: a mix of both halves that differs from level to level."""
    x = high + low * np.uint64(0x9E3779B97F4A7C15) + np.uint64((level + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) % np.uint64(bits)


class PerfectHash:
    """Minimal perfect hash of distinct 128-bit keys: 0 to n - 1 for the keys it was built of, anything for others."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words).astype(np.int64))))

    @classmethod
    def of(cls, high: np.ndarray, low: np.ndarray) -> PerfectHash:
        sizes, maps = [], []
        while len(high):
            bits = -(-ROOM * len(high) // 64) * 64
            at = _bit(high, low, len(sizes), bits)
            alone = np.bincount(at.astype(np.int64), minlength=bits) == 1
            maps.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(bits)
            left = ~alone[at.astype(np.int64)]
            high, low = high[left], low[left]
        return cls(np.array(sizes, np.int64), np.concatenate(maps) if maps else np.zeros(0, np.uint64))

    def index(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Index of every key; -1 for keys that have no bit on any level."""
        found, left = np.full(len(high), -1, np.int64), np.arange(len(high))
        for level, bits in enumerate(self.sizes):
            if not len(left):
                break
            at = (_bit(high[left], low[left], level, int(bits)) + np.uint64(self.starts[level])).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            here = (word >> bit) & np.uint64(1) == 1
            found[left[here]] = self.before[at[here] >> 6] + np.bitwise_count(word[here] & ((np.uint64(1) << bit[here]) - np.uint64(1)))
            left = left[~here]
        return found


class Shard:
    """Arrays of the keys of one shard behind their perfect hash."""

    FIELDS = "sizes binary, words binary, prints binary, counts binary, owners binary"

    def __init__(self, hashed: PerfectHash, prints: np.ndarray, counts: np.ndarray, owners: np.ndarray):
        self.hashed, self.prints, self.counts, self.owners = hashed, prints, counts, owners

    @classmethod
    def of(cls, high: np.ndarray, low: np.ndarray, counts: np.ndarray, owners: np.ndarray) -> Shard:
        hashed = PerfectHash.of(high, low)
        by = np.empty(len(high), np.int64)
        by[hashed.index(high, low)] = np.arange(len(high))
        return cls(hashed, low[by], counts[by], owners[by])

    def packed(self) -> tuple[bytes, ...]:
        return tuple(np.ascontiguousarray(a).tobytes() for a in (self.hashed.sizes, self.hashed.words, self.prints, self.counts, self.owners))

    @classmethod
    def unpacked(cls, sizes: bytes, words: bytes, prints: bytes, counts: bytes, owners: bytes) -> Shard:
        return cls(PerfectHash(np.frombuffer(sizes, np.int64), np.frombuffer(words, np.uint64)), np.frombuffer(prints, np.uint64), np.frombuffer(counts, np.int64), np.frombuffer(owners, np.int64))

    def probe(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of documents (0 for keys that are not here) and largest id of every key."""
        at = self.hashed.index(high, low)
        if not len(self.prints):
            return np.zeros(len(high), np.int64), np.zeros(len(high), np.int64)
        at = np.maximum(at, 0)
        return np.where(self.prints[at] == low, self.counts[at], 0), self.owners[at]


#: stands for a null id, which is smaller than all others but this one
NO_ID = np.iinfo(np.int64).min


def _shard_of(high: np.ndarray, shards: int) -> np.ndarray:
    return ((high >> np.uint64(17)) % np.uint64(shards)).astype(np.int64)


def line_counts(docs: DataFrame, min_chars: int = MIN_CHARS, held: int = 200_000) -> DataFrame:
    """(high, low, docs, owner): for every key that more than one document holds, how many do, and the largest id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list[int]] = {}

        def drain() -> pa.RecordBatch:
            high, low = halves(list(seen))
            counts, owners = np.array(list(seen.values()), np.int64).reshape(-1, 2).T
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), pa.array(counts), pa.array(owners)], names=["high", "low", "docs", "owner"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                owner = NO_ID if (i := doc_id.as_py()) is None else i
                for h in set(line_hashes(text.as_py(), min_chars)[1]) - {None}:
                    known = seen.get(h)
                    if known is None:
                        seen[h] = [1, owner]
                    else:
                        known[0] += 1
                        known[1] = max(known[1], owner)
                if len(seen) >= held:
                    yield drain()
        if seen:
            yield drain()

    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "high long, low long, docs long, owner long")
    return parts.groupBy("high", "low").agg(F.sum("docs").alias("docs"), F.max("owner").alias("owner")).where("docs > 1")


def build(keys: DataFrame, shards: int) -> DataFrame:
    """(shard, n, arrays): one row a shard from (high, low, docs, owner); a shard is small, whatever the number of keys."""

    def made(group: pd.DataFrame) -> pd.DataFrame:
        high, low = (group[c].to_numpy(np.int64).view(np.uint64) for c in ("high", "low"))
        shard = Shard.of(high, low, group["docs"].to_numpy(np.int64), group["owner"].to_numpy(np.int64))
        return pd.DataFrame([(int(group["shard"].iloc[0]), len(group), *shard.packed())], columns=["shard", "n", *(f.split()[0] for f in Shard.FIELDS.split(", "))])

    # the same as _shard_of, on the signed number
    at = F.shiftrightunsigned("high", 17) % shards
    return keys.withColumn("shard", at).groupBy("shard").applyInPandas(made, f"shard long, n long, {Shard.FIELDS}")


def _shards(keys: DataFrame, n: int) -> tuple[DataFrame, int]:
    shards = max(1, -(-n // SHARD_KEYS))
    return build(keys, shards), shards


def _owners(hashes: set[bytes], shards: dict[int, Shard], n_shards: int, min_docs: int) -> dict[bytes, int]:
    """The largest id of every line that enough documents hold, among ``hashes``."""
    asked = list(hashes)
    found: dict[bytes, int] = {}
    if not asked:
        return found
    high, low = halves(asked)
    at = _shard_of(high, n_shards)
    by = np.argsort(at, kind="stable")
    for mine in np.split(by, np.flatnonzero(np.diff(at[by])) + 1):
        if (shard := shards.get(int(at[mine[0]]))) is not None:
            counts, owners = shard.probe(high[mine], low[mine])
            known = counts >= min_docs
            found.update(zip((asked[i] for i in mine[known]), owners[known].tolist(), strict=True))
    return found


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, probe_keys: int = 2_000_000, hot_keys: int = 100_000) -> DataFrame:
    """doc_id, text (null for null), n_lines, n_dropped: one row per row of ``docs``; ``min_docs`` is 2 or more."""
    if min_docs < 2:
        raise ValueError("a line that goes is held by two documents at least")
    kind = docs.schema["doc_id"].dataType.simpleString()
    sc = docs.sparkSession.sparkContext
    read = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    keys = reliable(line_counts(docs, min_chars))
    n = keys.count()
    hot = F.lit(True) if n <= probe_keys else frequent(keys, F.col("docs"), hot_keys)
    n_hot = n if n <= probe_keys else keys.where(hot).count()
    built, n_shards = _shards(keys.where(hot), n_hot)
    packed = sc.broadcast([tuple(r) for r in built.collect()])
    if n > n_hot:
        gone = _routed(read, keys.where(~hot), n - n_hot, min_chars, min_docs)
        text_key = [F.xxhash64("text"), F.crc32(F.col("text").cast("binary"))]
        keyed = read.withColumn("t1", text_key[0]).withColumn("t2", text_key[1])
        same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & F.col("a.t1").eqNullSafe(F.col("b.t1")) & F.col("a.t2").eqNullSafe(F.col("b.t2"))
        read = keyed.alias("a").join(gone.alias("b"), same, "left").select("a.doc_id", "a.text", "b.gone")
    else:
        read = read.withColumn("gone", F.lit(None).cast("array<int>"))

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        shards = {int(r[0]): Shard.unpacked(*r[2:]) for r in packed.value}

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, totals, dropped = [], [], []
            cut = [line_hashes(text.as_py(), min_chars) for text in batch.column(1)]
            owners = _owners({h for _, hashes in cut for h in hashes} - {None}, shards, n_shards, min_docs)
            for doc_id, (lines, hashes), missing, gone in zip(batch.column(0).to_pylist(), cut, batch.column(1).is_null().to_pylist(), batch.column(2).to_pylist(), strict=True):
                own, far = NO_ID if doc_id is None else doc_id, set(gone or ())
                kept = [line for i, (line, h) in enumerate(zip(lines, hashes, strict=True)) if owners.get(h, own) <= own and i not in far]
                texts.append(None if missing else b"\n".join(kept))
                totals.append(len(lines))
                dropped.append(len(lines) - len(kept))
            columns = [batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(totals, pa.int64()), pa.array(dropped, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "n_lines", "n_dropped"])

        return step

    return map_arrow(read, make, f"doc_id {kind}, text string, n_lines long, n_dropped long")


def _routed(read: DataFrame, keys: DataFrame, n: int, min_chars: int, min_docs: int) -> DataFrame:
    """(doc_id, t1, t2, gone): positions of lines that go, for documents (by id and text) that lose any to rare keys."""
    kind = read.schema["doc_id"].dataType.simpleString()
    built, n_shards = _shards(keys, n)
    fields = f"doc_id {kind}, t1 long, t2 long"

    def hashed() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, at, hashes = [], [], []
            for i, text in enumerate(batch.column(3)):
                for p, h in enumerate(line_hashes(text.as_py(), min_chars)[1]):
                    if h is not None:
                        rows.append(i)
                        at.append(p)
                        hashes.append(h)
            high, low = halves(hashes)
            taken = [batch.column(c).take(pa.array(rows, pa.int64())) for c in range(3)]
            more = [pa.array(at, pa.int32()), pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), pa.array(_shard_of(high, n_shards))]
            return pa.RecordBatch.from_arrays([*taken, *more], names=["doc_id", "t1", "t2", "at", "high", "low", "shard"])

        return step

    def probed(asked: pd.DataFrame, arrays: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(arrays):
            return asked.iloc[:0][["doc_id", "t1", "t2", "at"]]
        shard = Shard.unpacked(*(arrays[f.split()[0]].iloc[0] for f in Shard.FIELDS.split(", ")))
        counts, owners = shard.probe(*(asked[c].to_numpy(np.int64).view(np.uint64) for c in ("high", "low")))
        ids = asked["doc_id"].fillna(NO_ID).to_numpy(np.int64)
        return asked.loc[(counts >= min_docs) & (owners > ids), ["doc_id", "t1", "t2", "at"]]

    keyed = read.select("doc_id", F.xxhash64("text").alias("t1"), F.crc32(F.col("text").cast("binary")).alias("t2"), "text")
    asked = map_arrow(keyed, hashed, f"{fields}, at int, high long, low long, shard long")
    # the id travels as text: a null among numbers would turn them into floating point
    text_id = asked.withColumn("doc_id", F.col("doc_id").cast("string"))
    lost = text_id.groupBy("shard").cogroup(built.groupBy("shard")).applyInPandas(probed, "doc_id string, t1 long, t2 long, at int")
    return lost.groupBy("doc_id", "t1", "t2").agg(F.collect_set("at").alias("gone")).withColumn("doc_id", F.col("doc_id").cast(kind))


def summary(kept: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 from ``drop_lines``."""
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
