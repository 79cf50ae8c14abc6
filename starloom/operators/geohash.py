"""Geometric hashing: quads of stars, their codes, the index and its search.

A quad is four stars, the widest pair A and B as a frame with A at (0, 0) and B at (1, 1), the two others inside the
circle over AB; its code is their coordinates in that frame, which shift, rotation and scale leave alone.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions import healpix as hp
from starloom.functions.base import let
from starloom.functions.sphere import radec_to_xyz
from starloom.operators.checkpoints import reliable, spread
from starloom.operators.spatial import range_join, sky_join

Xyz = Sequence[Column]

# --- codes ------------------------------------------------------------------------------------------------------


def _plane(s: Xyz, r: Xyz) -> tuple[Column, Column]:
    """Tangent-plane coordinates of s about the direction r."""
    h = F.sqrt(r[0] * r[0] + r[1] * r[1])
    ex, ey = -r[1] / h, r[0] / h
    nx, ny, nz = -r[2] * ey, r[2] * ex, r[0] * ey - r[1] * ex
    along = s[0] * r[0] + s[1] * r[1] + s[2] * r[2]
    return (s[0] * ex + s[1] * ey) / along, (s[0] * nx + s[1] * ny + s[2] * nz) / along


def code(a: Xyz, b: Xyz, other: Xyz) -> Column:
    """(x, y) of a star in the frame of A and B, unit vectors all."""
    mid = [p + q for p, q in zip(a, b, strict=True)]
    size = F.sqrt(sum((m * m for m in mid), F.lit(0.0)))

    def place(r: Column) -> Column:
        d = [r[i] for i in range(3)]
        (ay, ax), (by, bx), (sy, sx) = _plane(a, d), _plane(b, d), _plane(other, d)
        return F.struct(ax.alias("ax"), ay.alias("ay"), (bx - ax).alias("bx"), (by - ay).alias("by"), (sx - ax).alias("sx"), (sy - ay).alias("sy"))

    def turn(p: Column) -> Column:
        scale = p["bx"] * p["bx"] + p["by"] * p["by"]
        cos, sin = (p["by"] + p["bx"]) / scale, (p["by"] - p["bx"]) / scale
        return F.struct((p["sx"] * cos + p["sy"] * sin).alias("x"), (p["sy"] * cos - p["sx"] * sin).alias("y"))

    return let(let(F.array(*[m / size for m in mid]), place), turn)


def np_code(p: np.ndarray) -> np.ndarray:
    """Codes of quads in a plane, (n, k, 2) to (n, 2 (k - 2)): the first two points are A and B."""
    ab = p[:, 1] - p[:, 0]
    scale = (ab * ab).sum(axis=1)
    cos, sin = (ab[:, 1] + ab[:, 0]) / scale, (ab[:, 1] - ab[:, 0]) / scale
    d = p[:, 2:] - p[:, :1]
    x, y = d[..., 0] * cos[:, None] + d[..., 1] * sin[:, None], d[..., 1] * cos[:, None] - d[..., 0] * sin[:, None]
    return np.stack([x, y], axis=-1).reshape(len(p), -1)


def np_sky_code(v: np.ndarray) -> np.ndarray:
    """Codes of quads of unit vectors, (n, k, 3)."""
    r = v[:, 0] + v[:, 1]
    r /= np.linalg.norm(r, axis=1)[:, None]
    e = np.stack([-r[:, 1], r[:, 0], np.zeros(len(r))], axis=1)
    e /= np.linalg.norm(e, axis=1)[:, None]
    n = np.cross(r, e)
    along = np.einsum("nki,ni->nk", v, r)
    first, second = np.einsum("nki,ni->nk", v, e) / along, np.einsum("nki,ni->nk", v, n) / along
    return np_code(np.stack([second, first], axis=-1))


def inside(x: Column, y: Column) -> Column:
    """Within the circle whose diameter is AB."""
    return x * x - x + y * y - y <= 0


def enforce(stars: list[int], c: list[float]) -> tuple[list[int], list[float]]:
    """Invariants: mean x of the inner stars at most a half (else A and B change places), x ascending."""
    n = len(c) // 2
    if sum(c[::2]) / n > 0.5:
        stars, c = [stars[1], stars[0], *stars[2:]], [1.0 - v for v in c]
    order = sorted(range(n), key=lambda i: c[2 * i])
    return stars[:2] + [stars[2 + i] for i in order], [c[2 * i + k] for i in order for k in (0, 1)]


def obeys(c: list[float]) -> bool:
    x = c[::2]
    return sum(x) / len(x) <= 0.5 and all(p <= q for p, q in itertools.pairwise(x))


# --- index build ------------------------------------------------------------------------------------------------


def all_quads(stars: DataFrame, low_deg: float, high_deg: float, by: str) -> DataFrame:
    """Every valid quad (by, a, b, c, d, code) with AB between two separations: joins only, no driver loop.

    Stars meet within their own list ``by`` only, so the output grows with the number of lists.
    """
    s = stars.select("id", "ra", "dec", by)
    cols = lambda p: [F.col(f"{p}{i}") for i in range(3)]
    named = lambda v, p: [c.alias(f"{p}{i}") for i, c in enumerate(v)]
    ab = sky_join(s, s, high_deg, low_deg, by).where("l_id < r_id")
    ab = ab.select(F.col(f"l_{by}").alias(by), F.col("l_id").alias("a"), F.col("r_id").alias("b"), *named(radec_to_xyz("l_ra", "l_dec"), "a"), *named(radec_to_xyz("r_ra", "r_dec"), "b"))
    mid = [p + q for p, q in zip(cols("a"), cols("b"), strict=True)]
    ab = ab.select("*", *named([m / F.sqrt(sum((k * k for k in mid), F.lit(0.0))) for m in mid], "m"))
    (ay, ax), (by_, bx) = _plane(cols("a"), cols("m")), _plane(cols("b"), cols("m"))
    frame = ab.select(by, "a", "b", "m0", "m1", "m2", ax.alias("ax"), ay.alias("ay"), (bx - ax).alias("fx"), (by_ - ay).alias("fy"))
    pts = s.select(F.col(by).alias("_list"), F.col("id").alias("s"), *named(radec_to_xyz("ra", "dec"), "p"))
    reach = 2 * math.sin(math.radians(high_deg / 2) / 2) * 1.05
    near = range_join(frame, pts, reach, ["m0", "m1", "m2"], ["p0", "p1", "p2"], by=(by, "_list")).where("s <> a AND s <> b")
    sy, sx = _plane(cols("p"), cols("m"))
    near = near.select(by, "a", "b", "s", "fx", "fy", (sx - F.col("ax")).alias("sx"), (sy - F.col("ay")).alias("sy"))
    x, y = (F.expr(e) for e in ("(sx * (fy + fx) + sy * (fy - fx)) / (fx * fx + fy * fy)", "(sy * (fy + fx) - sx * (fy - fx)) / (fx * fx + fy * fy)"))
    placed = near.select(by, "a", "b", "s", x.alias("x"), y.alias("y"))
    # the inner stars of one AB are as many as a list has within its circle
    inner = placed.groupBy(by, "a", "b").agg(F.sort_array(F.collect_list(F.when(inside(F.col("x"), F.col("y")), F.struct("x", "s", "y")))).alias("inner"))
    one = inner.select(by, "a", "b", "inner", F.posexplode("inner").alias("i", "p"))
    both = one.select(by, "a", "b", "p", F.explode(F.slice("inner", F.col("i") + 2, F.size("inner"))).alias("q"))
    flip = F.col("p.x") + F.col("q.x") > 1.0
    pick = lambda yes, no: F.when(flip, yes).otherwise(no)
    return both.select(
        by, pick(F.col("b"), F.col("a")).alias("a"), pick(F.col("a"), F.col("b")).alias("b"), pick(F.col("q.s"), F.col("p.s")).alias("c"), pick(F.col("p.s"), F.col("q.s")).alias("d"),
        pick(F.array(1 - F.col("q.x"), 1 - F.col("q.y"), 1 - F.col("p.x"), 1 - F.col("p.y")), F.array("p.x", "p.y", "q.x", "q.y")).alias("code"),
    )


def first_quads(cells: np.ndarray, starts: np.ndarray, ids: np.ndarray, v: np.ndarray, known: list[set[tuple[int, ...]]], nside: int, lo2: float, hi2: float, step: int = 12) -> list[tuple[int, list[int], list[float]]]:
    """The first quad of every cell that is not known there: (place of the cell, stars, code).

    The stars of cell i are ``ids[starts[i]:starts[i + 1]]``, unit vectors ``v``, brightest first. Pairs are tried in the
    order in which their fainter star comes in, those of all cells together: first the pairs of the ``step`` brightest
    stars, then twice as many, and of those with their midpoint in the cell one a cell, then two, four and so on.
    """
    size, found, b0, b1 = np.diff(starts), [], 1, step
    open_ = np.flatnonzero(size >= 4)
    while len(open_):
        top = np.minimum(size[open_], b1)
        n = np.maximum((top * (top - 1) - b0 * (b0 - 1)) // 2, 0)
        of = np.repeat(open_, n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + b0 * (b0 - 1) // 2
        b = ((1 + np.sqrt(8.0 * k + 1)) / 2).astype(np.int64)  # pair number k is b (b - 1) / 2 + a
        a = k - b * (b - 1) // 2
        va, vb = v[starts[of] + a], v[starts[of] + b]
        d2 = ((va - vb) ** 2).sum(axis=1)
        wide = np.flatnonzero((d2 >= lo2) & (d2 <= hi2))
        mid = va[wide] + vb[wide]
        own = wide[hp.np_xyz_to_cell(mid / np.linalg.norm(mid, axis=1)[:, None], nside) == cells[of[wide]]] if len(wide) else wide
        of, a, b, many, done = of[own], a[own], b[own], 1, np.zeros(len(size), bool)
        while len(of):
            first = np.searchsorted(of, of)
            now = np.arange(len(of)) - first < many
            pc, pa, pb = of[now], a[now], b[now]
            around = size[pc] - 2
            pair = np.repeat(np.arange(len(pc)), around)
            s = np.arange(around.sum()) - np.repeat(np.cumsum(around) - around, around)
            s = s + (s >= pa[pair])
            s = s + (s >= pb[pair])
            at = starts[pc][pair]
            c = np_sky_code(np.stack([v[at + pa[pair]], v[at + pb[pair]], v[at + s]], axis=1))
            ok = np.flatnonzero(c[:, 0] ** 2 - c[:, 0] + c[:, 1] ** 2 - c[:, 1] <= 0)
            ends = np.searchsorted(pair[ok], np.arange(len(pc) + 1))
            for i in np.flatnonzero(np.diff(ends) >= 2).tolist():
                cell = int(pc[i])
                if done[cell]:
                    continue
                use, at0 = ok[ends[i] : ends[i + 1]], int(starts[cell])
                ab = ids[[at0 + pa[i], at0 + pb[i]]].tolist()
                for (one, ci), (two, cj) in itertools.combinations(zip(ids[at0 + s[use]].tolist(), c[use].tolist(), strict=True), 2):
                    stars_, code_ = enforce([*ab, one, two], [*ci, *cj])
                    if tuple(sorted(stars_)) not in known[cell]:
                        found.append((cell, stars_, code_))
                        done[cell] = True
                        break
            rest = ~now & ~done[of]
            of, a, b, many = of[rest], a[rest], b[rest], 2 * many
        open_ = open_[~done[open_] & (size[open_] > b1)]
        b0, b1 = b1, 2 * b1
    return found


def build_quads(stars: DataFrame, nside: int, low_deg: float, high_deg: float, passes: int = 3, reuse: int = 8, loosen: int = 0, mag: str = "mag") -> DataFrame:
    """One quad a cell a pass: (quad_id, stars, code).

    Stars are dealt to the cells whose centre they are near, once, as one list a cell; within a cell they are tried
    brightest first, the first valid AB whose midpoint is in the cell and the first valid inner pair make the quad. A star
    leaves after ``reuse`` quads, and no quad is built twice. Counts are joined back between passes, so the cells of one
    pass see those of the passes before. Cells that had stars but no quad are tried again with up to ``loosen`` uses.
    """
    side = math.radians(hp.side_length_arcmin(nside) / 60)
    reach = 1.01 * (side * math.sqrt(0.5) + 0.5 * 2 * math.sin(math.radians(high_deg) / 2))
    spark = stars.sparkSession
    cells = spark.range(12 * nside * nside)

    def centres(batches):
        for pdf in batches:
            v = hp.np_cell_to_xyz(pdf["id"].to_numpy(), nside)
            yield pd.DataFrame({"cell": pdf["id"], "cx": v[:, 0], "cy": v[:, 1], "cz": v[:, 2]})

    c = cells.mapInPandas(centres, "cell long, cx double, cy double, cz double")
    xyz = [F.cos(F.radians("dec")) * F.cos(F.radians("ra")), F.cos(F.radians("dec")) * F.sin(F.radians("ra")), F.sin(F.radians("dec"))]
    pts = stars.select(F.col("id").cast("long").alias("id"), F.coalesce(F.col(mag).cast("double"), F.lit(math.nan)).alias("mag"), *[v.alias(n) for v, n in zip(xyz, "xyz", strict=True)])
    # the side with fewer rows is the one that is copied to the buckets around
    sides = (pts, c, reach, ["x", "y", "z"], ["cx", "cy", "cz"]) if 12 * nside * nside <= stars.count() else (c, pts, reach, ["cx", "cy", "cz"], ["x", "y", "z"])
    near = spread(range_join(*sides).select("cell", "id", "mag", "x", "y", "z"), "cell")
    held = reliable(near.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("mag", "id", "x", "y", "z"))).alias("s")))
    lo2, hi2 = ((2 * math.sin(math.radians(s) / 2)) ** 2 for s in (low_deg, high_deg))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                lists, flat = batch.column(1), batch.column(1).flatten()
                size = np.diff(lists.offsets.to_numpy())
                ids, v = flat.field(1).to_numpy(), np.stack([flat.field(i).to_numpy() for i in (2, 3, 4)], axis=1)
                gone, known = batch.column(2), [{tuple(k) for k in ks or ()} for ks in batch.column(3).to_pylist()]
                if gone.null_count < len(gone):
                    keep, starts = np.ones(len(ids), bool), np.concatenate([[0], np.cumsum(size)])
                    for i in np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False)).tolist():
                        keep[starts[i] : starts[i + 1]] = ~np.isin(ids[starts[i] : starts[i + 1]], gone[i].values.to_numpy())
                        size[i] = keep[starts[i] : starts[i + 1]].sum()
                    ids, v = ids[keep], v[keep]
                cell = batch.column(0).to_numpy()
                made = first_quads(cell, np.concatenate([[0], np.cumsum(size)]), ids, v, known, nside, lo2, hi2)
                yield pa.RecordBatch.from_arrays([pa.array([int(cell[m[0]]) for m in made], pa.int64()), pa.array([m[1] for m in made], pa.list_(pa.int64())), pa.array([m[2] for m in made], pa.list_(pa.float64()))], names=["cell", "stars", "code"])

    quads = None
    for turn in range(passes + (loosen > 0)):
        last = turn == passes
        if quads is None:
            pool = held.select("cell", "s", F.lit(None).cast("array<bigint>").alias("gone"), F.lit(None).cast("array<array<bigint>>").alias("known"))
        else:
            used = reliable(quads.select(F.explode("stars").alias("id")).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= (loosen if last else reuse)).select("id"))
            known = quads.groupBy("cell").agg(F.collect_list("k").alias("known"))
            pool = held.join(known, "cell", "left_anti").withColumn("known", F.lit(None).cast("array<array<bigint>>")) if last else held.join(known, "cell", "left")
            n_used = used.count()
            if n_used:
                here = held.select("cell", F.explode("s.id").alias("id")).distinct().join(F.broadcast(used) if n_used <= 100_000 else used, "id", "left_semi")
                pool = pool.join(here.groupBy("cell").agg(F.collect_list("id").alias("gone")), "cell", "left").select("cell", "s", "gone", "known")
            else:
                pool = pool.select("cell", "s", F.lit(None).cast("array<bigint>").alias("gone"), "known")
        made = pool.mapInArrow(run, "cell long, stars array<bigint>, code array<double>").withColumn("turn", F.lit(turn)).withColumn("k", F.array_sort("stars"))
        every = made if quads is None else quads.unionByName(made)
        # a quad that cells found twice stays where it came first
        quads = reliable(every.groupBy("k").agg(F.min(F.struct("turn", "cell", "stars", "code")).alias("q")).select("q.cell", "q.stars", "q.code", "q.turn", "k"))
    return quads.withColumn("quad_id", F.xxhash64("k")).select("quad_id", "cell", "turn", "stars", "code")


def star_to_quads(quads: DataFrame) -> DataFrame:
    """The inverted index: star id with the sorted array of its quads."""
    return quads.select("quad_id", F.explode("stars").alias("star")).groupBy("star").agg(F.sort_array(F.collect_list("quad_id")).alias("quads"))


def dereference(matches: DataFrame, stars: DataFrame, ids: str = "stars") -> DataFrame:
    """Quad ids with the ordered array of their stars' records."""
    p = matches.select("*", F.posexplode(ids).alias("pos", "_star")).join(stars, F.col("_star") == F.col("id"))
    keep = [c for c in matches.columns if c != ids]
    return p.groupBy(*keep).agg(F.sort_array(F.collect_list(F.struct("pos", "id", "ra", "dec"))).alias("star_list"))


# --- search -----------------------------------------------------------------------------------------------------


def field_quads(sources: DataFrame, low_px: float, high_px: float, depth: int = 30, newest: int = 0, margin: float = 0.015) -> DataFrame:
    """Candidate quads of every field (field_id, rank, x, y), the ``depth`` brightest sources each, with all codes.

    Only quads that hold a source from rank ``newest`` on are given, so that a deeper search adds to a shallower one.
    Both labellings of A and B and both parities are written out where a code is within ``margin`` of the edges of the
    invariants, where noise may have chosen the other form, so each has an index-side partner; the kernel works on one
    field's bounded list.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        xy, ranks, out = pdf[["x", "y"]].to_numpy(), pdf["rank"].tolist(), []
        fid = pdf["field_id"].iloc[0]
        for b in range(1, len(xy)):
            for a in range(b):
                if not low_px <= np.hypot(*(xy[a] - xy[b])) <= high_px:
                    continue
                others = np.array([i for i in range(len(xy)) if i not in (a, b)], int)
                if len(others) < 2:
                    continue
                for flip in (False, True):
                    pts = xy[:, ::-1] if flip else xy
                    codes = np_code(np.stack([np.broadcast_to(pts[a], (len(others), 2)), np.broadcast_to(pts[b], (len(others), 2)), pts[others]], axis=1))
                    ok = codes[:, 0] ** 2 - codes[:, 0] + codes[:, 1] ** 2 - codes[:, 1] <= 0.02
                    for (i, ci), (j, cj) in itertools.combinations(zip(others[ok].tolist(), codes[ok].tolist(), strict=True), 2):
                        if max(ranks[b], ranks[i], ranks[j]) < newest:
                            continue
                        q, k = enforce([ranks[a], ranks[b], ranks[i], ranks[j]], [*ci, *cj])
                        out.append((fid, q, k, flip))
                        if abs((k[0] + k[2]) / 2 - 0.5) < margin:
                            out.append((fid, [q[1], q[0], q[3], q[2]], [1 - k[2], 1 - k[3], 1 - k[0], 1 - k[1]], flip))
                        if abs(k[0] - k[2]) < margin:
                            out.append((fid, [q[0], q[1], q[3], q[2]], [k[2], k[3], k[0], k[1]], flip))
        return pd.DataFrame(out, columns=["field_id", "field_stars", "field_code", "flipped"])

    kind = sources.schema["field_id"].dataType.simpleString()
    top = sources.where(F.col("rank") < depth)
    return spread(top, "field_id").groupBy("field_id").applyInPandas(run, f"field_id {kind}, field_stars array<bigint>, field_code array<double>, flipped boolean")


def match_codes(field: DataFrame, quads: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Similarity join in code space."""
    return range_join(quads.select("quad_id", "stars", "code"), field, tolerance, "code", "field_code", dist="code_err", dims=4)


__all__ = ["all_quads", "build_quads", "code", "dereference", "enforce", "field_quads", "inside", "match_codes", "np_code", "np_sky_code", "obeys", "star_to_quads"]
