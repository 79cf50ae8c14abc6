"""Approximate nearest neighbours with a forest of random-projection trees and one priority queue across the trees.

Trees are grown on a seeded sample of at most about ``sample_rows`` vectors: every inner node projects on a random
direction and splits at the sample's median, down to leaves of about ``leaf_rows`` vectors of the sample, so the trees
deepen with the table until the sample is at its bound, and the forest that is sent to the executors has a fixed size
bound. Every vector is then filed in one leaf of each tree. A query opens the leaves of all trees through a shared
queue, ordered by the squared distances to the splits crossed so far; the vectors in those leaves are ranked by their
exact inner product in double precision.

How deep the trees are used and how many leaves a query opens is measured on the sample: for some of its vectors the
exact neighbours within it are looked up, and of several depths the cheapest is taken at which the least number of
leaves gives ``recall`` of them. In a larger table neighbours are nearer than in its sample, so that this errs to the
side of more. Vectors with structure need few leaves; those without any need many, whatever the index.

Leaves are joined, not collected: vectors and queries meet per leaf in groups that are split again (``block_rows``) when
the table grows, every group returns the best ``k + 1`` of each of its queries, and those are merged. The sample goes
along with the queries: what scores less than the ``k + 1``-th best vector of the sample in a query's open leaves is not
among the nearest found, and leaves do not return it. For inner products
of vectors of unequal length the trees see one more coordinate that completes every vector to the largest norm, which
turns the search into one by angle; scores are taken on the original vectors.

Equal vectors are one class, searched once and filed once; a class keeps its ``k + 1`` smallest ids, which is all that
any answer can name. So a hot vector costs the search no more than another; rows meet their class in plain shuffle joins,
which adaptive execution splits where one vector holds many rows.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows with a
null id or with a number of components other than the most frequent one (the smaller of equally frequent ones); rows
that repeat both id and vector count once; an id with several vectors is a query for each, and is never its own
neighbour; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm.common import hashed_below, map_arrow, reliable

K = 20
LEAF_COST = 256


@dataclass
class Forest:
    """normals: trees x inner nodes x dim; cuts: trees x inner nodes; nodes in heap order."""

    normals: np.ndarray
    cuts: np.ndarray
    depth: int
    norm: float

    @property
    def leaves(self) -> int:
        return 1 << self.depth

    def cut(self, depth: int) -> Forest:
        """The same trees, used down to a depth."""
        inner = (1 << depth) - 1
        return Forest(self.normals[:, :inner], self.cuts[:, :inner], depth, self.norm)

    def completed(self, x: np.ndarray) -> np.ndarray:
        """Vectors of equal length: one more coordinate lifts each to the largest norm."""
        return np.column_stack([x, np.sqrt(np.maximum(0.0, self.norm**2 - (x * x).sum(axis=1)))])

    def file(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree (trees x vectors)."""
        x = self.completed(x)
        out = np.zeros((len(self.normals), len(x)), np.int64)
        for t, (normals, cuts) in enumerate(zip(self.normals, self.cuts, strict=True)):
            at = out[t]
            for _ in range(self.depth):
                at[:] = 2 * at + 1 + (np.einsum("ij,ij->i", x, normals[at]) > cuts[at])
            at -= self.leaves - 1
        return out

    def open(self, q: np.ndarray, visits: int) -> list[int]:
        """The first ``visits`` leaves, as tree * leaves + leaf, in the order of one queue over all trees."""
        q = np.append(q, 0.0)
        margins = [(normals @ q - cuts).tolist() for normals, cuts in zip(self.normals, self.cuts, strict=True)]
        queue = [(0.0, t, 0) for t in range(len(margins))]
        found: list[int] = []
        inner = self.leaves - 1
        while queue and len(found) < visits:
            far, t, node = heapq.heappop(queue)
            while node < inner:
                m = margins[t][node]
                heapq.heappush(queue, (far + m * m, t, 2 * node + 2 - (m > 0)))
                node = 2 * node + 1 + (m > 0)
            found.append(t * self.leaves + node - inner)
        return found


def grow(sample: np.ndarray, trees: int, depth: int, norm: float, seed: int) -> Forest:
    rng = np.random.default_rng(seed)
    dim, inner = sample.shape[1] + 1, (1 << depth) - 1
    forest = Forest(np.zeros((trees, inner, dim)), np.zeros((trees, inner)), depth, norm)
    x = forest.completed(sample)
    for t in range(trees):
        rows = {0: np.arange(len(x))}
        for node in range(inner):
            own = rows.pop(node)
            v = rng.normal(size=dim)
            v /= np.linalg.norm(v)
            p = x[own] @ v
            cut = float(np.median(p)) if len(p) else 0.0
            forest.normals[t, node], forest.cuts[t, node] = v, cut
            if 2 * node + 2 < inner:
                rows[2 * node + 1], rows[2 * node + 2] = own[p <= cut], own[p > cut]
    return forest


def calibrate(forest: Forest, sample: np.ndarray, rows: int, k: int, recall: float, seed: int, queries: int = 192) -> tuple[int, int]:
    """(depth, visits): the cheapest use of the forest that finds ``recall`` of the sample's own ``k`` neighbours."""
    rng = np.random.default_rng(seed)
    asked = rng.choice(len(sample), min(queries, len(sample)), replace=False)
    s = sample[asked] @ sample.T
    s[np.arange(len(asked)), asked] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1 or not forest.depth:
        return 0, 1
    near = np.argpartition(-s, k - 1, axis=1)[:, :k]
    leaf = forest.file(sample)
    best = (math.inf, 0, 1)
    for depth in sorted({*range(4, forest.depth, 2), forest.depth}):
        used = forest.cut(depth)
        own = (leaf >> (forest.depth - depth)) + np.arange(len(leaf))[:, None] * used.leaves
        place = np.empty(len(leaf) * used.leaves, int)
        needed = []
        for q, found in zip(asked, near, strict=True):
            place[used.open(sample[q], len(place))] = np.arange(len(place))
            needed.append(place[own[:, found]].min(axis=0))
        visits = int(np.sort(np.concatenate(needed))[math.ceil(recall * len(asked) * k) - 1]) + 1
        # a query costs the vectors that it ranks and, for every leaf, about as much as ``LEAF_COST`` of them
        cost = visits / used.leaves * rows + LEAF_COST * visits
        best = min(best, (cost, depth, visits))
    return best[1:]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    v = F.col("embedding")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(~F.exists(v, bad) & F.exists(v, lambda x: x != 0))
    dims = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.where(F.size("embedding") == (dims["d"] if dims else 0))


def sample_bounds(q: np.ndarray, opened: list[list[int]], sample: np.ndarray, leaf: np.ndarray, leaves: int, k: int) -> np.ndarray:
    """Score of the ``k``-th best vector of the sample in the opened leaves of each query, less what rounding may do; none if they hold fewer.

    ``leaf`` is the sample's leaf in each tree, as tree * leaves + leaf.
    """
    out = np.full(len(q), -np.inf)
    size = np.sqrt((sample**2).sum(axis=1).max(initial=0.0))
    for i, own in enumerate(opened):
        is_open = np.zeros(len(leaf) * leaves, bool)
        is_open[own] = True
        s = sample[is_open[leaf].any(axis=0)] @ q[i]
        if len(s) >= k:
            out[i] = np.partition(s, len(s) - k)[len(s) - k] - 1e-9 * size * math.sqrt(float((q[i] ** 2).sum()))
    return out


def _rank_leaf(k: int):
    """All queries of a leaf against its vectors: the best k classes of each, ties to the smaller id."""
    schema = pa.schema([("q", pa.int64()), ("c", pa.int64()), ("first_id", pa.int64()), ("score", pa.float64())])

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return schema.empty_table()
        x = _matrix(vectors.column("embedding").combine_chunks()).astype(np.float64)
        c, first = vectors.column("c").to_numpy(), vectors.column("first_id").to_numpy()
        q, qs, bound = queries.column("q").to_numpy(), queries.column("embedding").combine_chunks(), queries.column("bound").to_numpy()
        parts = []
        for lo in range(0, len(q), 256):
            s = _matrix(qs.slice(lo, 256)).astype(np.float64) @ x.T
            least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] > k else np.full(len(s), -np.inf)
            row, col = np.nonzero(s >= np.maximum(least, bound[lo : lo + 256])[:, None])
            score = s[row, col]
            order = np.lexsort((first[col], -score, row))
            row, col, score = row[order], col[order], score[order]
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            keep = nth < k
            parts.append((q[lo + row[keep]], c[col[keep]], first[col[keep]], score[keep]))
        return pa.Table.from_arrays([pa.array(np.concatenate(p)) for p in zip(*parts, strict=True)], schema=schema)

    return run


def nearest(
    vectors: DataFrame, every: int = 20, k: int = K, trees: int = 4, leaf_rows: int = 32, recall: float = 0.96, share: float | None = None, sample_rows: int = 16_384, block_rows: int = 20_000, seed: int = 29, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: up to ``k`` neighbours of every row whose id is divisible by ``every``.

    ``share`` opens that part of all leaves of the full depth instead of what ``recall`` needs.
    """
    rows = valid(vectors, id_col, vec_col)
    top = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.withColumn("n", F.dense_rank().over(top)).where(F.col("n") <= k + 1)
    classes = few.groupBy("embedding").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    classes = reliable(classes.select(F.monotonically_increasing_id().alias("c"), F.col("ids")[0].alias("first_id"), "ids", "embedding"))
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).distinct().join(classes.select("c", "embedding"), "embedding").select("vec_id", F.col("c").alias("q"))
    asked = reliable(asked)
    n, norm2 = classes.agg(F.count("*"), F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).first()
    n_asked = asked.select("q").distinct().count()
    seen = min(n, sample_rows)
    depth = int(math.log2(seen / leaf_rows)) if seen >= leaf_rows else 0
    sample = classes.where(hashed_below(F.col("c"), min(1.0, sample_rows / max(1, n)), seed)).select("embedding").toArrow().column(0).combine_chunks() if n else None
    if sample is None or not len(sample):
        depth, grown, x = 0, Forest(np.zeros((1, 0, 1)), np.zeros((1, 0)), 0, math.sqrt(norm2 or 0.0)), np.zeros((0, 0))
    else:
        x = _matrix(sample).astype(np.float64)
        grown = grow(x, trees if depth else 1, depth, math.sqrt(norm2), seed)
        if share is None:
            depth, visits = calibrate(grown, x, n, k, recall, seed)
            grown = grown.cut(depth)
    n_trees, leaves = len(grown.normals), grown.leaves
    if share is not None or not depth:
        visits = math.ceil((share or 1.0) * n_trees * leaves) if depth else 1
    blocks = max(1, math.ceil(n / leaves / block_rows))
    query_blocks = max(1, math.ceil(n_asked * visits / (n_trees * leaves) / block_rows))
    shared = classes.sparkSession.sparkContext.broadcast((grown, x))
    vector_type = classes.schema["embedding"].dataType.simpleString()

    def filing():
        forest, _ = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = forest.file(_matrix(batch.column(2)).astype(np.float64)) if batch.num_rows else np.zeros((n_trees, 0), np.int64)
            again = np.tile(np.arange(batch.num_rows), n_trees)
            buckets = (got + np.arange(n_trees)[:, None] * leaves).ravel()
            columns = [batch.column(i).take(pa.array(again)) for i in range(3)]
            return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), *columns], names=["bucket", "c", "first_id", "embedding"])

        return step

    def opening():
        forest, seen = shared.value
        seen_leaf = (forest.file(seen) + np.arange(n_trees)[:, None] * leaves) if len(seen) else np.zeros((n_trees, 0), np.int64)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            asked = _matrix(batch.column(1)).astype(np.float64)
            got = [forest.open(q, visits) for q in asked]
            again = np.repeat(np.arange(batch.num_rows), [len(g) for g in got])
            buckets, bound = np.array([b for g in got for b in g], np.int64), sample_bounds(asked, got, seen, seen_leaf, leaves, k + 1) if len(seen) else np.full(len(got), -np.inf)
            columns = [batch.column(i).take(pa.array(again)) for i in range(2)]
            return pa.RecordBatch.from_arrays([pa.array(buckets), *columns, pa.array(bound[again], pa.float64())], names=["bucket", "q", "embedding", "bound"])

        return step

    filed = map_arrow(classes.select("c", "first_id", "embedding"), filing, f"bucket long, c long, first_id long, embedding {vector_type}")
    filed = filed.withColumn("block", F.pmod(F.xxhash64("c"), F.lit(blocks))).withColumn("query_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))))
    searchers = classes.join(asked.select("q").distinct(), F.col("c") == F.col("q"), "left_semi").select(F.col("c").alias("q"), "embedding")
    opened = map_arrow(searchers, opening, f"bucket long, q long, embedding {vector_type}, bound double")
    opened = opened.withColumn("query_block", F.pmod(F.xxhash64("q"), F.lit(query_blocks))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    keys = ("bucket", "block", "query_block")
    ranked = filed.groupBy(*keys).cogroup(opened.groupBy(*keys)).applyInArrow(_rank_leaf(k + 1), "q long, c long, first_id long, score double")

    best = Window.partitionBy("q").orderBy(F.desc("score"), "first_id")
    merged = ranked.groupBy("q", "c", "first_id").agg(F.max("score").alias("score")).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    named = merged.join(classes.select("c", "ids"), "c").groupBy("q").agg(F.collect_list(F.struct("score", "ids")).alias("found"))
    pairs = F.flatten(F.transform("found", lambda e: F.transform(e["ids"], lambda i: F.struct((-e["score"]).alias("s"), i.alias("i")))))
    lists = named.select("q", F.slice(F.array_sort(pairs), 1, k + 1).alias("found"))
    own = asked.join(lists, "q").select(F.col("vec_id").alias("query_id"), F.slice(F.filter("found", lambda e: e["i"] != F.col("vec_id")), 1, k).alias("found"))
    return own.select("query_id", F.posexplode("found").alias("at", "e")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("e.i").alias("vec_id"), (-F.col("e.s")).alias("score"))
