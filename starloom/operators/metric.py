"""Distance joins in any metric, by bounds between nodes.

A few pivots give every row its distances from them. By the triangle inequality two rows are at least as far apart as
any of those coordinates differ, so rows are cut into nodes along the coordinates (medians of a sample, one coordinate
after another), a node keeps the least and the greatest value of each, and two nodes whose intervals leave a gap of more
than the radius in any coordinate never meet. Only pairs of nodes that may hold a pair are joined: every left row is
sent to the block of its node, and a right row once to every left block that may hold a partner. A block holds a
bounded number of left rows, and right rows stream past it in batches, so neither side is ever held whole, whatever a
node's size; a node that one vector fills is dealt to several blocks. The right rows that a block meets are dealt to
segments, each with the block's left rows, so that a few blocks are many tasks.

``metric_nearest`` keeps the best partner of each left row while right rows stream past, so its output grows with the
rows and not with the pairs. Without structure in the vectors the distances themselves are still all pairs.

The metric is given by name or as a function of two matrices that returns the matrix of distances and obeys the triangle
inequality. Distances of pairs that come out are exact in double precision.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.operators.checkpoints import reliable

Metric = Callable[[np.ndarray, np.ndarray], np.ndarray]


def euclidean(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differences, not the expanded square, where it matters: near pairs are exact."""
    d2 = (x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1)[None] - 2 * x @ y.T
    size = (x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1)[None]
    close = np.nonzero(d2 < 1e-6 * size)
    if len(close[0]):
        d2[close] = ((x[close[0]] - y[close[1]]) ** 2).sum(axis=1)
    return np.sqrt(np.maximum(d2, 0.0))


def angular(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Angle between directions in degrees; that of a zero vector with anything is not a number, so it never joins."""
    with np.errstate(invalid="ignore", divide="ignore"):
        u, v = x / np.linalg.norm(x, axis=1)[:, None], y / np.linalg.norm(y, axis=1)[:, None]
    return np.degrees(2.0 * np.arcsin(np.minimum(euclidean(u, v) / 2.0, 1.0)))


def manhattan(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(y)))
    for i, p in enumerate(x):
        out[i] = np.abs(y - p).sum(axis=1)
    return out


METRICS: dict[str, Metric] = {"euclidean": euclidean, "angular": angular, "manhattan": manhattan}


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column as a matrix of doubles; rows that are null or hold a null become NaN."""
    values = column.flatten()
    if len(column) and not column.null_count and not values.null_count:
        lengths = np.diff(column.offsets.to_numpy())
        if (lengths == lengths[0]).all():
            return values.to_numpy(zero_copy_only=False).astype(float).reshape(len(column), lengths[0])
    rows = column.to_pylist()
    width = max((len(r) for r in rows if r is not None), default=0)
    return np.array([[np.nan if v is None else v for v in r] if r is not None and len(r) == width else [np.nan] * width for r in rows], float).reshape(len(rows), width)


class Tree:
    """Pivots, and cuts by the medians of their coordinates in a sample: coordinates and node of a row."""

    def __init__(self, pivots: np.ndarray, distance: Metric, sample: np.ndarray, depth: int):
        self.pivots, self.distance, self.depth = pivots, distance, depth
        self.cuts = np.full((1 << depth) - 1, np.inf)
        at, node = self.coordinates(sample), np.zeros(len(sample), np.int64)
        for level in range(depth):
            first = (1 << level) - 1
            value = at[:, level % len(pivots)]
            for n in range(1 << level):
                own = value[node == first + n]
                if len(own):
                    self.cuts[first + n] = np.median(own)
            node = 2 * node + 1 + (value > self.cuts[node])

    def coordinates(self, rows: np.ndarray) -> np.ndarray:
        return self.distance(rows, self.pivots)

    def nodes(self, at: np.ndarray) -> np.ndarray:
        node = np.zeros(len(at), np.int64)
        for level in range(self.depth):
            node = 2 * node + 1 + (at[:, level % len(self.pivots)] > self.cuts[node])
        return node - ((1 << self.depth) - 1)


def plant(left: DataFrame, right: DataFrame, left_pos: str, right_pos: str, distance: Metric, node_rows: int, n_pivots: int, sample_rows: int) -> Tree | None:
    """Pivots far from each other and the tree, from at most ``sample_rows`` rows of either side; None if a side is empty."""
    sizes, drawn = [], []
    for df, pos in ((left, left_pos), (right, right_pos)):
        n = df.where(F.col(pos).isNotNull()).count()
        sizes.append(n)
        share = min(1.0, 2.0 * sample_rows / max(1, n))
        some = df.where(F.col(pos).isNotNull()).select(F.col(pos).cast("array<double>").alias("v")).where(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < share * (1 << 20))
        drawn += [r["v"] for r in some.take(sample_rows)]
    lengths = Counter(map(len, drawn))
    rows = np.array([v for v in drawn if None not in v and len(v) == max(lengths, key=lambda n: (lengths[n], n))], float)
    rows = rows[np.isfinite(rows).all(axis=1)] if len(rows) else rows
    if not len(rows) or not min(sizes):
        return None
    # farthest first, from the row that is farthest from the mean
    at = int(np.nan_to_num(distance(rows, rows.mean(axis=0)[None])[:, 0], nan=-1.0).argmax())
    chosen, least = [at], distance(rows, rows[[at]])[:, 0]
    while len(chosen) < min(n_pivots, len(rows)):
        at = int(np.nan_to_num(least, nan=-1.0).argmax())
        if not least[at] > 0:
            break
        chosen.append(at)
        least = np.minimum(least, distance(rows, rows[[at]])[:, 0])
    # as deep as the rows ask for and the sample can tell
    depth = int(np.ceil(np.log2(max(1.0, min(max(sizes) / node_rows, len(rows) / 8)))))
    return Tree(rows[chosen], distance, rows, depth)


def _placed(df: DataFrame, pos: str, tree: Tree) -> DataFrame:
    """``df`` with its node and coordinates; rows without a proper vector go."""
    names = list(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(names.index(pos)))
            if v.shape[1] != tree.pivots.shape[1]:
                v = np.full((len(v), tree.pivots.shape[1]), np.nan)
            at = tree.coordinates(v)
            good = np.flatnonzero(np.isfinite(at).all(axis=1))
            node = tree.nodes(at[good])
            kept = batch.take(pa.array(good))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(node), pa.ListArray.from_arrays(np.arange(len(good) + 1, dtype=np.int32) * at.shape[1], at[good].ravel())], names=[*names, "_node", "_at"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, _node long, _at array<double>")


def node_bounds(placed: DataFrame, n_pivots: int) -> DataFrame:
    """(node, n, low, high): the intervals of the coordinates of every node, one row a node."""
    low, high = (F.array(*[f(F.col("_at")[i]) for i in range(n_pivots)]) for f in (F.min, F.max))
    return placed.groupBy(F.col("_node").alias("node")).agg(F.count("*").alias("n"), low.alias("low"), high.alias("high"))


def node_pairs(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """(l_node, r_node, nearest, farthest): pairs of nodes that may hold rows within ``radius``, with bounds of their distance.

    An interval join: nodes meet by the buckets that their first coordinate overlaps, the gaps of all decide.
    """
    reach = radius * (1 + 1e-9) + 1e-9
    ends = left.unionByName(right).agg(F.min(F.col("low")[0]), F.max(F.col("high")[0])).first()
    width = max(reach, ((ends[1] or 0.0) - (ends[0] or 0.0)) / 256, 1e-300)
    over = lambda df, p, more: df.select(*[F.col(c).alias(f"{p}_{c}") for c in ("node", "low", "high")], F.explode(F.sequence(F.floor((F.col("low")[0] - more) / width), F.floor((F.col("high")[0] + more) / width))).alias("_b"))
    met = over(left, "l", reach).join(over(right, "r", 0.0), "_b").drop("_b")
    gaps = F.zip_with(F.arrays_zip("l_low", "l_high"), F.arrays_zip("r_low", "r_high"), lambda a, b: F.greatest(a["l_low"] - b["r_high"], b["r_low"] - a["l_high"], F.lit(0.0)))
    far = F.array_min(F.zip_with("l_high", "r_high", lambda a, b: a + b))
    return met.select("l_node", "r_node", F.array_max(gaps).alias("nearest"), far.alias("farthest")).where(F.col("nearest") <= reach).dropDuplicates(["l_node", "r_node"])


def _met(left: DataFrame, right: DataFrame, radius: float, left_pos: str, right_pos: str, distance: Metric, node_rows: int, segment_rows: int, n_pivots: int, sample_rows: int, broadcast_rows: int, once: bool = False) -> DataFrame | None:
    """(_to, _block, _segment, _side, l, r): the left rows of every block and segment, then the right rows that may be near; None if a side is empty.

    If ``once``, two nodes meet once, the left one before the right one, and ``_side`` is 2 for right rows of another node.
    """
    ours, theirs = list(left.columns), list(right.columns)
    tree = plant(left, right, left_pos, right_pos, distance, node_rows, n_pivots, sample_rows)
    if tree is None:
        return None
    a, b = _placed(left, left_pos, tree), _placed(right, right_pos, tree)
    own, other = reliable(node_bounds(a, len(tree.pivots))), reliable(node_bounds(b, len(tree.pivots)))
    pairs = reliable(node_pairs(own, other, radius).where("l_node <= r_node" if once else "true"))
    load = pairs.join(other.select(F.col("node").alias("r_node"), F.col("n").alias("_load")), "r_node").groupBy(F.col("l_node").alias("node")).agg(F.ceil(F.sum("_load") / segment_rows).cast("long").alias("_segments"))
    blocks = reliable(own.join(load, "node").select(F.col("node").alias("_node"), F.ceil(F.col("n") / node_rows).cast("long").alias("_blocks"), "_segments"))
    targets = pairs.join(blocks, F.col("l_node") == F.col("_node")).select(F.col("r_node").alias("_node"), F.col("l_node").alias("_to"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_block"), "_segments")
    small = lambda df: F.broadcast(df) if df.count() <= broadcast_rows else df
    payload = lambda df, names: F.struct(*[F.col(c) for c in names])
    hashed = lambda df: F.xxhash64(*[F.col(c).cast("string") if "map" in t else F.col(c) for c, t in df.dtypes])
    block = F.pmod(hashed(left), F.col("_blocks"))
    standing = a.join(small(blocks), "_node").select(F.col("_node").alias("_to"), block.alias("_block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_segments") - 1)).alias("_segment"), F.lit(0).alias("_side"), payload(a, ours).alias("l"), F.lit(None).alias("r"))
    passing = b.join(small(targets), "_node").select("_to", "_block", F.pmod(hashed(right), F.col("_segments")).alias("_segment"), (F.when(F.col("_node") != F.col("_to"), 2).otherwise(1) if once else F.lit(1)).alias("_side"), F.lit(None).alias("l"), payload(b, theirs).alias("r"))
    kinds = {c: df.schema[c].dataType for df, cs in ((left, ours), (right, theirs)) for c in cs}
    shape = lambda names: "struct<" + ", ".join(f"`{c}`: {kinds[c].simpleString()}" for c in names) + ">"
    both = standing.withColumn("r", F.col("r").cast(shape(theirs))).unionByName(passing.withColumn("l", F.col("l").cast(shape(ours))))
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(tasks, "_to", "_block", "_segment").sortWithinPartitions("_to", "_block", "_segment", "_side")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int, int], int, int, int]]:
    """(block and segment, side, from, to) of the stretches of a sorted batch."""
    keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)], axis=1)
    ends = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1).tolist(), len(keys)]
    for lo, hi in zip(ends, ends[1:], strict=False):
        if lo < hi:
            yield tuple(keys[lo, :3].tolist()), int(keys[lo, 3]), lo, hi


def _finder(x: np.ndarray, radius: float, distance: Metric) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A function of rows ``y``: the places i in ``x`` and j in ``y`` of the pairs within ``radius``, and their distances.

    Angles are told from a product in single precision first, with more room than its error; only what passes is measured.
    """
    if distance is not angular:

        def measured(y: np.ndarray):
            gap = distance(x, y)
            i, j = np.nonzero(gap <= radius)
            return i, j, gap[i, j]

        return measured
    along = lambda v: v / np.linalg.norm(v, axis=1)[:, None]
    u = along(x)
    single = u.astype(np.float32)
    least = np.float32(np.cos(np.radians(min(radius, 180.0))) - (16 + x.shape[1]) * 1.2e-7)

    def turned(y: np.ndarray):
        v = along(y)
        i, j = np.divmod(np.flatnonzero(single @ v.astype(np.float32).T >= least), max(1, len(v)))
        chord = [np.sqrt(((u[i[k : k + 65_536]] - v[j[k : k + 65_536]]) ** 2).sum(axis=1)) for k in range(0, len(i), 65_536)]
        d = np.degrees(2.0 * np.arcsin(np.minimum(np.concatenate([np.zeros(0), *chord]) / 2.0, 1.0)))
        ok = d <= radius
        return i[ok], j[ok], d[ok]

    return turned


def metric_join(
    left: DataFrame, right: DataFrame, radius: float, left_pos: str, right_pos: str, metric: str | Metric = "euclidean", dist: str = "dist", node_rows: int = 8_192, segment_rows: int = 32_768, n_pivots: int = 12, sample_rows: int = 4_000, broadcast_rows: int = 1_000_000,
    once: tuple[str, str] | None = None, columns: list[str] | None = None,
) -> DataFrame:
    """All pairs of rows within ``radius`` (inclusive): the columns of both sides, which must differ in name, and the distance.

    Null vectors, vectors with nulls or of another length than most, and those whose distances are no numbers take no part.
    ``once`` names a left and a right column of longs, for two sides that are the same rows and columns but for the names:
    only the pairs whose left value is the smaller are returned, and nodes meet once instead of both ways.
    ``columns`` are those that are returned besides the distance, if not all.
    """
    distance = METRICS[metric] if isinstance(metric, str) else metric
    ours, theirs = list(left.columns), list(right.columns)
    kept = [c for c in (*ours, *theirs) if columns is None or c in columns]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for df in (left, right) for f in df.schema.fields if f.name in kept], f"`{dist}` double"])
    if once:
        left, right = left.where(F.col(once[0]).isNotNull()), right.where(F.col(once[1]).isNotNull())
    dealt = _met(left, right, radius, left_pos, right_pos, distance, node_rows, segment_rows, n_pivots, sample_rows, broadcast_rows, once is not None)
    if dealt is None:
        return left.sparkSession.createDataFrame([], schema)
    li, ri = ours.index(left_pos), theirs.index(right_pos)
    mine, other = ([k for k, c in enumerate(names) if c in kept] for names in (ours, theirs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: tuple[int, int, int] | None = None
        held: list[pa.StructArray] = []
        find, ids = None, None
        for batch in batches:
            for place, side, lo, hi in _runs(batch):
                if here != place:
                    here, held, find = place, [], None
                if side == 0:
                    held.append(batch.column(4).slice(lo, hi - lo))
                    continue
                if not held:
                    continue
                if find is None:
                    held = [pa.concat_arrays(held)]
                    find = _finder(_matrix(held[0].field(li)), radius, distance)
                    ids = held[0].field(ours.index(once[0])).to_numpy() if once else None
                rows = batch.column(5).slice(lo, hi - lo)
                y, its = _matrix(rows.field(ri)), rows.field(theirs.index(once[1])).to_numpy() if once else None
                for at in range(0, len(y), 256):
                    i, j, gap = find(y[at : at + 256])
                    j = j + at
                    turns = [(i, j, gap, held[0], rows)]
                    if once:
                        up, down = ids[i] < its[j], (ids[i] > its[j]) & (side == 2)
                        turns = [(i[up], j[up], gap[up], held[0], rows), (j[down], i[down], gap[down], rows, held[0])]
                    for a, b, d, p, q in turns:
                        if len(a):
                            yield pa.RecordBatch.from_arrays([*[p.field(k).take(pa.array(a)) for k in mine], *[q.field(k).take(pa.array(b)) for k in other], pa.array(d)], names=[*kept, dist])

    return dealt.mapInArrow(run, schema)


class Best:
    """The nearest partner of each held row so far, ties to the smaller id; partners with the row's own id do not count if ``differ``."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, radius: float, distance: Metric, differ: bool):
        self.x, self.ids, self.distance, self.differ = x, ids, distance, differ
        self.order = np.argsort(ids, kind="stable")
        self.dist, self.other = np.full(len(x), radius), np.full(len(x), np.iinfo(np.int64).max)
        self.found = np.zeros(len(x), bool)
        self.size = (x**2).sum(axis=1)
        self.wide = np.concatenate([-x, np.ones((len(x), 1))], axis=1)

    def meet(self, y: np.ndarray, ids: np.ndarray) -> None:
        if self.distance is euclidean:
            # half the squared distance without the row's own part, in one product; whoever may be the best is measured again
            half = (y**2).sum(axis=1) / 2
            gap = self.wide @ np.concatenate([y, half[:, None]], axis=1).T
            slack = 1e-11 * (self.size + 2 * half.max())
            top = (self.dist**2 - self.size) / 2 + slack
        else:
            gap = self.distance(self.x, y)
            slack, top = np.zeros(len(gap)), self.dist
            gap[np.isnan(gap)] = np.inf
        if self.differ:
            own = self.ids[self.order]
            low, high = np.searchsorted(own, ids, "left"), np.searchsorted(own, ids, "right")
            for j in np.flatnonzero(high > low).tolist():
                gap[self.order[low[j] : high[j]], j] = np.inf
        least = gap.min(axis=1)
        rows = np.flatnonzero(least <= top)
        if not len(rows):
            return
        i, j = np.nonzero(gap[rows] <= np.minimum(top, least + 2 * slack)[rows, None])
        i = rows[i]
        if self.distance is euclidean:
            d = np.sqrt(np.concatenate([((self.x[i[at : at + 65_536]] - y[j[at : at + 65_536]]) ** 2).sum(axis=1) for at in range(0, len(i), 65_536)]))
        else:
            d = gap[i, j]
        better = (d < self.dist[i]) | ((d == self.dist[i]) & (ids[j] < self.other[i]))
        i, j, d = i[better], j[better], d[better]
        turn = np.lexsort((ids[j], d, i))
        i, j, d = i[turn], j[turn], d[turn]
        first = np.flatnonzero(np.diff(i, prepend=-1))
        self.dist[i[first]], self.other[i[first]], self.found[i[first]] = d[first], ids[j[first]], True


def metric_nearest(
    left: DataFrame, right: DataFrame, radius: float, left_pos: str, right_pos: str, left_id: str, right_id: str, metric: str | Metric = "euclidean", dist: str = "dist", differ: bool = True, node_rows: int = 32_768, segment_rows: int = 16_384, n_pivots: int = 12, sample_rows: int = 4_000, broadcast_rows: int = 1_000_000
) -> DataFrame:
    """(left_id, right_id, dist): the nearest right row within ``radius`` of every left id that has one, ties to the smaller id.

    Ids are longs; with ``differ`` rows of the same id are no partners. Rows that take no part are those of ``metric_join``.
    """
    distance = METRICS[metric] if isinstance(metric, str) else metric
    schema = f"`{left_id}` long, `{right_id}` long, `{dist}` double"
    sides = [df.where(F.col(i).isNotNull()).select(F.col(i).cast("long").alias(i), pos) for df, i, pos in ((left, left_id, left_pos), (right, right_id, right_pos))]
    dealt = _met(*sides, radius, left_pos, right_pos, distance, node_rows, segment_rows, n_pivots, sample_rows, broadcast_rows)
    if dealt is None:
        return left.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: tuple[int, int, int] | None = None
        held: list[pa.StructArray] = []
        best: Best | None = None

        def told() -> Iterator[pa.RecordBatch]:
            if best is not None and best.found.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[best.found]) for c in (best.ids, best.other, best.dist)], names=[left_id, right_id, dist])

        for batch in batches:
            for place, side, lo, hi in _runs(batch):
                if here != place:
                    yield from told()
                    here, held, best = place, [], None
                rows = batch.column(4 + side).slice(lo, hi - lo)
                if side == 0:
                    held.append(rows)
                    continue
                if not held:
                    continue
                if best is None:
                    mine = pa.concat_arrays(held)
                    best = Best(_matrix(mine.field(1)), mine.field(0).to_numpy(), radius, distance, differ)
                y, ids = _matrix(rows.field(1)), rows.field(0).to_numpy()
                for at in range(0, len(y), 256):
                    best.meet(y[at : at + 256], ids[at : at + 256])
        yield from told()

    return dealt.mapInArrow(run, schema).groupBy(left_id).agg(F.min(F.struct(dist, right_id)).alias("_b")).select(left_id, F.col(f"_b.{right_id}").alias(right_id), F.col(f"_b.{dist}").alias(dist))
