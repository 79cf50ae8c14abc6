"""Periodic runs of words, found by the runs theorem.

Every run (a stretch with smallest period p, at least twice p long, that cannot be extended) has a root of length p
that is the longest Lyndon word at its place under one of the two orders of the alphabet. So the candidates are two
words a position, whatever the text: the longest Lyndon word at i ends before the next smaller value of the inverse
suffix array behind i, and under the opposite order before the next greater one. A candidate at i is extended to the
right by the longest common prefix of the suffixes i and i + p, the minimum of a stretch of the LCP array, which a
sparse table over blocks answers; candidates with the same period and end are roots of one run, and the leftmost is
extended to the left by halving the distance with the same table. Nothing is enumerated by period or by pair.

Documents are cut and numbered in pieces of some megabytes, and the arrays of a piece cover all its documents at once.
The suffix array comes from prefix doubling over those suffixes that are not yet told apart; the LCP array is compared
word by word only where it is not the neighbour's value less one. Documents in which no four consecutive words occur
three times cannot hold a run of exponent four or more and need no suffix array.

Work is one Arrow kernel without any shuffle. Memory grows with the piece: some 150 bytes a word of the largest
document or of ``PIECE_BYTES`` of texts, whichever is more; a very long text is one document in one task, whole.

Edge cases: a null text has no words, no run and the digests of nothing; so has an empty or blank one; a null id counts
as the empty text where it is hashed; repeated rows give the same result each; an empty table gives an empty result.
Further columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import map_arrow

MIN_LENGTH = 6
MIN_EXPONENT = 4
PIECE_BYTES = 2 << 20
BLOCK = 8


class Run(NamedTuple):
    """Words ``start`` to ``start + length - 1`` repeat with smallest period ``period``."""

    start: int
    length: int
    period: int


def looped(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with a periodic tail planted where the id's crc32 asks for one, else as they are."""
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


class Suffixes:
    """Suffix order, LCP and range minima of several sequences of whole numbers, compared within their sequence."""

    def __init__(self, w: np.ndarray, seq: np.ndarray, end: np.ndarray):
        self.w, self.end, self.n = w, end, len(w)
        self.order, self.rank = self._sorted(seq)
        self.lcp = self._lcp(seq)
        self.table = [np.minimum.reduceat(self.lcp, np.arange(0, self.n, BLOCK))]
        while len(self.table[-1]) > 1 << len(self.table) - 1:
            half = 1 << len(self.table) - 1
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))

    def _sorted(self, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Prefix doubling: a rank is the first slot of those that share it, so settled suffixes are never touched again."""
        n = self.n
        key = seq.astype(np.int64) * (int(self.w.max()) + 1) + self.w
        order = np.argsort(key, kind="stable")
        rank, slots, keys, k = np.empty(n, np.int64), np.arange(n), key[order], 1
        while len(slots):
            here = order[slots]
            head = np.concatenate(([True], keys[1:] != keys[:-1]))
            rank[here] = slots[np.maximum.accumulate(np.where(head, np.arange(len(slots)), 0))]
            alone = head & np.concatenate((head[1:], [True]))
            slots = slots[~alone]
            here = order[slots]
            ahead = here + k
            then = np.where(ahead < self.end[here], rank[np.minimum(ahead, n - 1)] + 1, 0)
            keys = rank[here] * (n + 1) + then
            by = np.argsort(keys, kind="stable")
            order[slots], keys, k = here[by], keys[by], 2 * k
        return order, rank

    def _lcp(self, seq: np.ndarray) -> np.ndarray:
        """lcp[s]: length of the common prefix of the suffixes in slots s - 1 and s, 0 where the sequence changes."""
        n, w, end = self.n, self.w, self.end
        before = np.full(n, -1)
        before[self.order[1:]] = self.order[:-1]
        before[(before >= 0) & (seq[before] != seq)] = -1
        i = np.arange(n)
        # where the words in front of both agree, and are the pair before, the value is the one before less one
        inner = (i > 0) & (before > 0)
        inner[1:] &= (seq[1:] == seq[:-1]) & (before[:-1] >= 0) & (before[1:] == before[:-1] + 1)
        inner &= w[i - 1] == w[np.maximum(before - 1, 0)]
        own = np.flatnonzero(~inner & (before >= 0))
        length = np.zeros(n, np.int64)
        length[own] = self._common(own, before[own])
        last = np.maximum.accumulate(np.where(inner, 0, i))
        plcp = np.where(inner, length[last] - (i - last), length)
        return plcp[self.order]

    def _common(self, a: np.ndarray, b: np.ndarray, steps: int = 32) -> np.ndarray:
        """Common prefix lengths by comparing words: a few for all pairs at once, then chunks for the pairs left."""
        w, room = self.w, np.minimum(self.end[a] - a, self.end[b] - b)
        found, left = np.zeros(len(a), np.int64), np.arange(len(a))
        for s in range(steps):
            left = left[room[left] > s]
            left = left[w[a[left] + s] == w[b[left] + s]]
            found[left] = s + 1
        for x in left:
            at, chunk, most = steps, 64, int(room[x])
            while at < most:
                differ = np.flatnonzero(w[a[x] + at : a[x] + min(most, at + chunk)] != w[b[x] + at : b[x] + min(most, at + chunk)])
                if len(differ):
                    at += int(differ[0])
                    break
                at, chunk = min(most, at + chunk), 2 * chunk
            found[x] = at
        return found

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common prefix of the suffixes i and j of one sequence, i < j: the least LCP between their slots."""
        lo, hi = np.minimum(self.rank[i], self.rank[j]) + 1, np.maximum(self.rank[i], self.rank[j])
        least = self.lcp[lo]
        for s in range(BLOCK):
            least = np.minimum(least, np.minimum(self.lcp[np.minimum(lo + s, hi)], self.lcp[np.maximum(hi - s, lo)]))
        first, after = -(-lo // BLOCK), (hi + 1) // BLOCK
        wide = np.flatnonzero(first < after)
        level = np.frexp(after[wide] - first[wide])[1] - 1
        for k in np.unique(level):
            at, row = wide[level == k], self.table[k]
            least[at] = np.minimum(least[at], np.minimum(row[first[at]], row[after[at] - (1 << k)]))
        return least


def lyndon_ends(rank: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the longest Lyndon word from each place ends (exclusive): under the order of ``rank``, and under its opposite."""
    values, ends = rank.tolist(), end.tolist()
    smaller, greater = list(ends), list(ends)
    below: list[int] = []
    above: list[int] = []
    for i, v in enumerate(values):
        if i and ends[i] != ends[i - 1]:
            below.clear()
            above.clear()
        while below and values[below[-1]] > v:
            smaller[below.pop()] = i
        while above and values[above[-1]] < v:
            greater[above.pop()] = i
        below.append(i)
        above.append(i)
    return np.array(smaller), np.array(greater)


def _hopeful(w: np.ndarray, seq: np.ndarray, end: np.ndarray, n_seq: int) -> np.ndarray:
    """Which sequences hold some four consecutive words three times; equal hashes of others only keep too many."""
    i = np.flatnonzero(np.arange(len(w)) + 4 <= end)
    if not len(i):
        return np.zeros(n_seq, bool)
    h = seq[i].astype(np.uint64)
    for s in range(4):
        h = (h ^ w[i + s].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    by = np.argsort(h)
    thrice = h[by[2:]] == h[by[:-2]]
    return np.bincount(seq[i[by[2:][thrice]]], minlength=n_seq) > 0


def find_runs(sequences: list[np.ndarray], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[list[Run]]:
    """Runs of every sequence of word numbers, at least ``min_length`` and ``min_exponent`` (2 or more) periods long, by start and period."""
    if min_exponent < 2:
        raise ValueError("a run is at least twice as long as its period")
    found: list[list[Run]] = [[] for _ in sequences]
    sizes = np.array([len(s) for s in sequences], np.int64)
    if not sizes.sum():
        return found
    w, seq = np.concatenate(sequences), np.repeat(np.arange(len(sizes)), sizes)
    end = np.cumsum(sizes)[seq]
    if min_exponent >= 4 and min_length >= 6:
        keep = _hopeful(w, seq, end, len(sizes))[seq]
        w, seq = w[keep], seq[keep]
        if not len(w):
            return found
        end = np.cumsum(np.bincount(seq, minlength=len(sizes)))[seq]
    suffixes = Suffixes(w, seq, end)
    start = end - sizes[seq]
    place = np.arange(len(w))
    root, period = [], []
    for stop in lyndon_ends(suffixes.rank, end):
        p = stop - place
        # the leftmost root of a run that is long enough is followed by (min_exponent - 2) p + 1 words that repeat
        fits = place + (min_exponent - 1) * p < end
        i = place[fits]
        for k in range(min_exponent - 1):
            i = i[w[i + k * p[i]] == w[i + (k + 1) * p[i]]]
        root.append(i)
        period.append(p[i])
    i, p = np.concatenate(root), np.concatenate(period)
    if not len(i):
        return found
    right = suffixes.common(i, i + p)
    long = right >= (min_exponent - 2) * p + 1
    i, p, right = i[long], p[long], right[long]
    stop = i + p + right
    by = np.lexsort((i, p, stop))
    first = np.concatenate(([True], (stop[by][1:] != stop[by][:-1]) | (p[by][1:] != p[by][:-1]))) if len(by) else np.zeros(0, bool)
    i, p, stop = i[by][first], p[by][first], stop[by][first]
    # the largest d under p for which the words from i - d on still repeat up to the same end
    low, high = np.zeros(len(i), np.int64), np.minimum(p - 1, i - start[i])
    while len(open_ := np.flatnonzero(low < high)):
        d = (low[open_] + high[open_] + 1) // 2
        at = i[open_] - d
        good = suffixes.common(at, at + p[open_]) == stop[open_] - p[open_] - at
        low[open_] = np.where(good, d, low[open_])
        high[open_] = np.where(good, high[open_], d - 1)
    i = i - low
    whole = (stop - i >= min_length) & (stop - i >= min_exponent * p)
    for a, b, q, s in sorted(zip(i[whole].tolist(), stop[whole].tolist(), p[whole].tolist(), seq[i[whole]].tolist(), strict=True), key=lambda r: (r[0], r[2])):
        found[s].append(Run(a - int(start[a]), b - a, q))
    return found


def most_repeated(runs: Iterable[Run]) -> Run | None:
    """The run of the greatest length in periods, compared exactly; ties go to the smallest start, then period."""
    best: Run | None = None
    for r in sorted(runs, key=lambda r: (r.start, r.period)):
        if best is None or r.length * best.period > best.length * r.period:
            best = r
    return best


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run repeats after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for r in runs:
        depth[r.start + r.period] += 1
        depth[r.start + r.length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]


def _pieces(texts: Iterable[tuple[int | None, str | None]], rewrite: Callable[[list[bytes], int | None], list[bytes]] | None) -> Iterator[list[list[bytes]]]:
    """Words of the documents, in groups of about ``PIECE_BYTES`` of text."""
    held: list[list[bytes]] = []
    size = 0
    for doc_id, text in texts:
        raw = (text or "").encode("utf-8", "replace")
        if held and size + len(raw) > PIECE_BYTES:
            yield held
            held, size = [], 0
        held.append(rewrite(raw.split(), doc_id) if rewrite else raw.split())
        size += len(raw)
    if held:
        yield held


def detect(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, rewrite: Callable[[list[bytes], int | None], list[bytes]] | None = None) -> DataFrame:
    """doc_id, runs (start, length, period by start and period) and text without what they repeat: one row per row of ``docs``.

    Words are runs without ASCII white space; ``rewrite(words, doc_id)`` may change them before runs are looked for.
    """
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        runs: list[list[Run]] = []
        kept: list[bytes] = []
        for docs_words in _pieces(zip(batch.column(0).to_pylist(), (t.as_py() for t in batch.column(1)), strict=True), rewrite):
            numbers = pa.array([x for words in docs_words for x in words], pa.large_binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = np.cumsum([0, *map(len, docs_words)])
            here = find_runs([numbers[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], min_length, min_exponent)
            runs += here
            kept += [b" ".join(collapsed(words, found)) for words, found in zip(docs_words, here, strict=True)]
        rows = [[dict(r._asdict()) for r in found] for found in runs]
        text = pa.array(kept, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(run)), text], names=["doc_id", "runs", "text"])

    read = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(read, lambda: step, f"doc_id {kind}, runs array<struct<start:long,length:long,period:long>>, text string")


def summary(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the most repeated run and the digests of all runs and of the collapsed text, from ``detect``."""
    r = F.col("runs")
    # sorted by start and period, so the first of those that no other run exceeds is the wanted one; exact in whole numbers
    best = F.aggregate(r, F.get(r, F.lit(0)), lambda b, x: F.when(x["length"] * b["period"] > b["length"] * x["period"], x).otherwise(b))
    lines = F.array_join(F.transform(r, lambda x: F.concat(F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")), F.lit("\n"))), "")
    out = found.select("doc_id", F.size(r).cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
    milli = F.floor(1000 * F.col("b.length") / F.col("b.period")).cast("long")
    return out.select("doc_id", "n_runs", F.col("b.start").alias("start"), F.col("b.length").alias("length"), F.col("b.period").alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
