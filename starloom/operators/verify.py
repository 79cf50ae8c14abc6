"""Hypotheses, their Bayesian verification, refits, and the solve loop."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.functions import healpix as hp
from starloom.functions.wcs import Wcs, fit_sip, fit_tan
from starloom.operators.checkpoints import reliable, spread
from starloom.operators.geohash import field_quads, match_codes


@dataclass
class Fold:
    """Result of a verification: log-odds of the best prefix and the match of each test star (-1 distractor, -2 conflict)."""

    logodds: float
    worst: float
    best_at: int
    theta: np.ndarray

    @property
    def counts(self) -> tuple[int, int, int]:
        t = self.theta[: self.best_at + 1]
        return int((t >= 0).sum()), int((t == -1).sum()), int((t == -2).sum())


def verify(test: np.ndarray, refs: np.ndarray, area: float, sigma2: np.ndarray, distractors: float = 0.25, bail: float = math.log(1e-100), stop: float = math.inf) -> Fold:
    """Test stars in order of brightness against reference stars in the same pixels.

    Each test star is explained by its nearest reference star within five sigma or as a distractor, whose density rises
    with the matches made so far. When a reference star is wanted twice, the old match is kept unless handing it over,
    with the distractors in between priced for one match less, explains the sequence better. The running sum of
    log-likelihood ratios against an even background is the log-odds; its best prefix counts.
    """
    n_ref, log_bg = len(refs), -math.log(area)
    theta = np.full(len(test), -1)
    terms = np.zeros(len(test))
    matched = np.zeros(len(test), int)  # matches before each test star
    owner: dict[int, int] = {}
    distractor = lambda mu: math.log(distractors + (1 - distractors) * mu / n_ref) + log_bg
    total, best, worst, best_at, mu, best_theta = 0.0, -math.inf, math.inf, -1, 0, theta[:0]
    for i, p in enumerate(test):
        matched[i] = mu
        lone = distractor(mu)
        d2 = ((refs - p) ** 2).sum(axis=1) if n_ref else np.zeros(0)
        j = int(d2.argmin()) if n_ref else -1
        value = lone
        if j >= 0 and d2[j] < 25 * sigma2[i]:
            hit = math.log((1 - distractors) / (2 * math.pi * sigma2[i] * n_ref)) - d2[j] / (2 * sigma2[i])
            if hit > lone:
                if j not in owner:
                    owner[j], theta[i], value = i, j, hit
                    mu += 1
                else:
                    old = owner[j]
                    between = [k for k in range(old + 1, i) if theta[k] < 0]
                    keep = terms[old] + sum(terms[k] for k in between) + lone
                    moved = {k: distractor(matched[k] - 1) for k in between}
                    give = distractor(matched[old]) + sum(moved.values()) + hit
                    if give > keep:
                        total += distractor(matched[old]) - terms[old] + sum(v - terms[k] for k, v in moved.items())
                        terms[old], theta[old] = distractor(matched[old]), -2
                        for k, v in moved.items():
                            terms[k] = v
                        matched[old + 1 : i + 1] -= 1
                        owner[j], theta[i], value = i, j, hit
                    else:
                        theta[i] = -2
        terms[i] = value
        total += value - log_bg
        worst = min(worst, total)
        if total > best:
            best, best_at, best_theta = total, i, theta[: i + 1].copy()
        if total < bail or total > stop:
            break
    theta[: best_at + 1] = best_theta  # a later hand-over is no part of the best prefix
    return Fold(best if best_at >= 0 else total, worst, best_at, theta)


def relevance_radius2(quad_r2: float, area: float, n_ref: int, pix2: float, distractors: float = 0.25) -> float:
    """Squared radius within which a match still says more than the background."""
    return quad_r2 * max(1.0, area * (1 - distractors) / (4 * math.pi * n_ref * pix2) - 1.0)


def dedup_sources(xy: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Indexes kept, brightest first, when sources within the ``radius`` of a kept one go; a grid finds the neighbours."""
    if not len(xy):
        return np.zeros(0, int)
    size = max(float(radius.max()), 1e-9)
    cells: dict[tuple[int, int], list[int]] = {}
    at = np.floor(xy / size).astype(int)
    for i, c in enumerate(map(tuple, at.tolist())):
        cells.setdefault(c, []).append(i)
    gone = np.zeros(len(xy), bool)
    for i, (cx, cy) in enumerate(at.tolist()):
        if gone[i]:
            continue
        near = np.array([j for dx in (-1, 0, 1) for dy in (-1, 0, 1) for j in cells.get((cx + dx, cy + dy), ()) if j > i], int)
        if len(near):
            gone[near[((xy[near] - xy[i]) ** 2).sum(axis=1) <= radius[i] ** 2]] = True
    return np.flatnonzero(~gone)


@dataclass(frozen=True)
class Rules:
    """Parameters of verification and decision; thresholds are log-odds."""

    pix_err: float = 1.0
    distractors: float = 0.25
    tune: float = math.log(1e6)
    keep: float = math.log(1e9)
    solve: float = math.log(1e9)
    bail: float = math.log(1e-100)
    bin_arcmin: float | None = None  # side of the bins that spread the test stars evenly
    tweak_order: int = 2


def test_bins(xy: np.ndarray, width: float, height: float, nx: int, ny: int) -> np.ndarray:
    """Bin of each position, row by row."""
    bx, by = (np.clip((xy[:, i] / size * n).astype(int), 0, n - 1) for i, size, n in ((0, width, nx), (1, height, ny)))
    return by * nx + bx


def in_turns(bins: np.ndarray) -> np.ndarray:
    """Order that takes the first of every bin, then the second of every bin, and so on."""
    by_bin = np.argsort(bins, kind="stable")
    own = bins[by_bin]
    turn = np.arange(len(own)) - np.searchsorted(own, own)
    return by_bin[np.lexsort((own, turn))]


def verify_header(wcs: Wcs, xy: np.ndarray, ra: np.ndarray, dec: np.ndarray, rules: Rules, quad: list[int] | None = None) -> tuple[Fold, np.ndarray, np.ndarray]:
    """Verification of a header: the fold, the test stars' positions in its order, and the reference stars' pixels.

    With a matched ``quad`` (its A and B first) errors grow away from its centre, duplicates of brighter test stars go
    and then the quad's own stars; test stars take turns over bins, and only the bins within the radius of relevance
    count. A header from elsewhere is verified over the whole field with one error.
    """
    width, height = wcs.width, wcs.height
    px, py = wcs.np_radec_to_pixel(ra, dec)
    ref = np.stack([px, py], axis=1)
    with np.errstate(invalid="ignore"):
        ref = ref[(px >= 0.5) & (px <= width + 0.5) & (py >= 0.5) & (py <= height + 0.5)]
    pix2, area = rules.pix_err**2, width * height
    s2 = np.full(len(xy), pix2)
    if quad is not None:
        centre, q2 = (xy[quad[0]] + xy[quad[1]]) / 2, max(((xy[quad[0]] - xy[quad[1]]) ** 2).sum() / 4, 1e-9)
        s2 = pix2 * (1 + ((xy - centre) ** 2).sum(axis=1) / q2)
    order = dedup_sources(xy, np.sqrt(s2))
    if quad is not None:
        order = order[~np.isin(order, quad)]
    side = rules.bin_arcmin and rules.bin_arcmin * 60 / wcs.pixel_scale
    nx, ny = (max(1, round(n / side)) for n in (width, height)) if side else (1, 1)
    if nx * ny > 1:
        order = order[in_turns(test_bins(xy[order], width, height, nx, ny))]
        if quad is not None and len(ref):
            reach2 = relevance_radius2(q2, area, len(ref), pix2, rules.distractors)
            mid = np.stack([(np.arange(nx * ny) % nx + 0.5) * width / nx, (np.arange(nx * ny) // nx + 0.5) * height / ny], axis=1)
            good = ((mid - centre) ** 2).sum(axis=1) <= reach2
            if good.any():
                order = order[good[test_bins(xy[order], width, height, nx, ny)]]
                ref = ref[good[test_bins(ref, width, height, nx, ny)]]
                area *= good.mean()
    return verify(xy[order], ref, area, s2[order], rules.distractors, rules.bail), xy[order], ref


def decide(wcs: Wcs, xy: np.ndarray, ra: np.ndarray, dec: np.ndarray, rules: Rules, quad: list[int] | None) -> tuple[Fold, Wcs, bool, float] | None:
    """The fold, header, whether it was refitted, and rms in arcsec of a header that is kept; one that is nearly good is refitted first."""
    fold, test, ref = verify_header(wcs, xy, ra, dec, rules, quad)
    tuned = False
    if fold.logodds < rules.tune:
        return None
    if fold.logodds < rules.keep:
        better = tweak(wcs, xy, ra, dec, rules.tweak_order, rules.pix_err)
        again = verify_header(better, xy, ra, dec, rules)
        if again[0].logodds > fold.logodds:
            (fold, test, ref), wcs, tuned = again, better, True
    if fold.logodds < rules.keep:
        return None
    hit = np.flatnonzero(fold.theta[: fold.best_at + 1] >= 0)
    rms = math.sqrt(((test[hit] - ref[fold.theta[hit]]) ** 2).sum(axis=1).mean()) * wcs.pixel_scale if len(hit) else math.nan
    return fold, wcs, tuned, rms


def logodds_to_weight(logodds: np.ndarray) -> np.ndarray:
    return np.where(logodds > 40, 1.0, np.where(logodds < -700, 0.0, 1 / (1 + np.exp(-np.clip(logodds, -700, 40)))))


def tweak(wcs: Wcs, xy: np.ndarray, ra: np.ndarray, dec: np.ndarray, order: int = 2, jitter: float = 1.0, rounds: int = 20) -> Wcs:
    """Refit with SIP terms by annealed, softly weighted least squares over nearest pairs."""
    for step in range(rounds):
        gamma = 0.8**step if step < rounds - 1 else 0.0
        px, py = wcs.np_radec_to_pixel(ra, dec)
        ref = np.stack([px, py], axis=1)
        ok = np.isfinite(ref).all(axis=1)
        d2 = ((xy[:, None] - np.where(ok[:, None], ref, 1e9)[None]) ** 2).sum(axis=2)
        j = d2.argmin(axis=1)
        near = d2[np.arange(len(xy)), j]
        sigma2 = jitter**2 * (1 + 100 * gamma)
        w = logodds_to_weight(6 - near / (2 * sigma2))
        use = (near < 25 * sigma2) & (w > 1e-3)
        terms = (order + 1) * (order + 2) // 2
        if use.sum() < max(4, terms + 2):
            break
        wcs = fit_sip(xy[use, 0], xy[use, 1], ra[j[use]], dec[j[use]], wcs, order if step >= rounds // 2 else 1, weights=w[use])
    return wcs


WCS_FIELDS = "crval0 double, crval1 double, crpix0 double, crpix1 double, cd00 double, cd01 double, cd10 double, cd11 double"


def header_values(w: Wcs) -> tuple[float, ...]:
    return (*w.crval, *w.crpix, *w.cd[0], *w.cd[1])


def header_of(values, width: float, height: float) -> Wcs:
    v = [float(x) for x in values]
    return Wcs((v[0], v[1]), (v[2], v[3]), ((v[4], v[5]), (v[6], v[7])), width, height)


def hypotheses(found: DataFrame, sources: DataFrame, stars: DataFrame, width: float, height: float, scale: tuple[float, float], within: tuple[float, float, float] | None = None) -> DataFrame:
    """A plane for every code match whose pixel scale is in bounds: (hyp, field_id, code_err, quad, header).

    ``within`` is a cone (ra, dec, degrees) that all stars of the matched quad have to be in.
    """
    found = reliable(found.withColumn("hyp", F.monotonically_increasing_id()))
    pos = found.select("hyp", "field_id", "code_err", F.posexplode(F.arrays_zip(F.col("stars"), F.col("field_stars"))).alias("k", "s")).select("hyp", "field_id", "code_err", "k", F.col("s.stars").alias("star"), F.col("s.field_stars").alias("rank"))
    pairs = pos.join(stars.select(F.col("id").alias("star"), "ra", "dec"), "star").join(sources.select("field_id", "rank", "x", "y"), ["field_id", "rank"])
    four = pairs.groupBy("hyp", "field_id", "code_err").agg(F.sort_array(F.collect_list(F.struct("k", "rank", "x", "y", "ra", "dec"))).alias("p"))
    if within is not None:
        from starloom.functions.sphere import within_radius

        four = four.where(F.forall("p", lambda q: within_radius(q["ra"], q["dec"], *within)))
    kind = sources.schema["field_id"].dataType.simpleString()

    def fit(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                v = [np.array([q[c] for q in r.p]) for c in ("x", "y", "ra", "dec")]
                w = fit_tan(*v, crpix=(0.5 + width / 2, 0.5 + height / 2))
                if scale[0] <= w.pixel_scale <= scale[1]:
                    rows.append((r.hyp, r.field_id, r.code_err, [int(q["rank"]) for q in r.p], *header_values(w)))
            yield pd.DataFrame(rows, columns=["hyp", "field_id", "code_err", "quad", *(f.split()[0] for f in WCS_FIELDS.split(", "))])

    return reliable(four.mapInPandas(fit, f"hyp long, field_id {kind}, code_err double, quad array<bigint>, {WCS_FIELDS}"))


def best_hypotheses(hyps: DataFrame, sources: DataFrame, stars: DataFrame, width: float, height: float, largest_scale: float, rules: Rules) -> DataFrame:
    """The best kept hypothesis of every field.

    Hypotheses meet their reference stars by the cell that the field's centre is in: the stars of a cell and of the
    field's radius around it come by one distance join and are shipped once for all hypotheses of a field in that cell.
    Those are verified in the order of their code errors, up to the first that reaches ``rules.solve``.
    """
    from starloom.operators.spatial import sky_join

    radius = largest_scale / 3600 * math.hypot(width, height) / 2 * 1.05
    nside = max(1, int(hp.side_length_arcmin(1) / 60 / radius))
    side = hp.side_length_arcmin(nside) / 60
    names = list(hyps.columns)

    def placed(batches):
        for pdf in batches:
            yield pdf.assign(cell=hp.np_xyz_to_cell(hp.np_radec_to_xyz(pdf["crval0"].to_numpy(), pdf["crval1"].to_numpy()), nside))

    # the cell's expression is long, and generated code of it would stay in the driver
    hyps = hyps.mapInPandas(placed, ", ".join(f"`{c}` {hyps.schema[c].dataType.simpleString()}" for c in names) + ", cell long")

    def centres(batches):
        for pdf in batches:
            v = hp.np_cell_to_xyz(pdf["cell"].to_numpy(), nside)
            yield pd.DataFrame({"cell": pdf["cell"], "ra": np.degrees(np.arctan2(v[:, 1], v[:, 0])) % 360.0, "dec": np.degrees(np.arcsin(v[:, 2]))})

    middle = hyps.select("cell").distinct().mapInPandas(centres, "cell long, ra double, dec double")
    near = sky_join(stars.select("id", "ra", "dec"), middle, radius + side)
    refs = near.groupBy(F.col("r_cell").alias("cell")).agg(F.sort_array(F.collect_list(F.struct(F.col("l_id").alias("id"), F.col("l_ra").alias("ra"), F.col("l_dec").alias("dec")))).alias("refs"))
    tests = sources.groupBy("field_id").agg(F.sort_array(F.collect_list(F.struct("rank", "x", "y"))).alias("tests"))
    header = [f.split()[0] for f in WCS_FIELDS.split(", ")]
    tried = hyps.groupBy("field_id", "cell").agg(F.sort_array(F.collect_list(F.struct("code_err", "hyp", "quad", F.array(*header).alias("header")))).alias("tried"))
    kind = sources.schema["field_id"].dataType.simpleString()
    out = f"field_id {kind}, logodds double, n_match int, n_distract int, n_conflict int, rms double, tuned boolean, scale double, {WCS_FIELDS}, n_tried int"

    def check(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                ra, dec = (np.array([s[c] for s in r.refs]) for c in ("ra", "dec"))
                xy = np.array([(t["x"], t["y"]) for t in r.tests])
                place = {int(t["rank"]): i for i, t in enumerate(r.tests)}
                best = None
                for n, h in enumerate(r.tried, 1):
                    got = decide(header_of(h["header"], width, height), xy, ra, dec, rules, [place[int(q)] for q in h["quad"]])
                    if got and (best is None or got[0].logodds > best[0].logodds):
                        best = (*got, n)
                    if best and best[0].logodds >= rules.solve:
                        break
                if best:
                    fold, w, tuned, rms, n = best
                    rows.append((r.field_id, fold.logodds, *fold.counts, rms, tuned, w.pixel_scale, *header_values(w), n))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in out.split(", ")])

    kept = spread(tried.join(refs, "cell").join(tests, "field_id"), "field_id", "cell").mapInPandas(check, out)
    names = [c.split()[0] for c in out.split(", ")][1:]
    return kept.groupBy("field_id").agg(F.max(F.struct(*names)).alias("b")).select("field_id", *[f"b.{c}" for c in names])


def solve(sources: DataFrame, stars: DataFrame, quads: DataFrame, width: float, height: float, scale: tuple[float, float], quad_deg: tuple[float, float], depths: Sequence[int] = (12, 25), tolerance: float = 0.01, rules: Rules | None = None, within: tuple[float, float, float] | None = None) -> DataFrame:
    """Best solution of every field (field_id, rank, x, y): log-odds, counts, rms, pixel scale and header.

    Fields are tried with their brightest sources first: a stage adds the quads whose faintest star is new, code matches
    are a similarity join, a plane is fitted to each, and the hypotheses are verified. Fields that a stage solves are
    left out of the next one by an anti-join; the number of stages is a parameter.
    """
    rules = rules or Rules()
    low_px, high_px = quad_deg[0] * 3600 / scale[1] * 0.9, quad_deg[1] * 3600 / scale[0] * 1.1
    done: DataFrame | None = None
    for newest, depth in itertools.pairwise((0, *depths)):
        # written once: it is read three times, and the dealing of fields to tasks would be taken for that of the anti-join, which is merged
        left = sources if done is None else reliable(sources.join(done.where(F.col("logodds") >= rules.solve).select("field_id"), "field_id", "left_anti"))
        found = match_codes(field_quads(left, low_px, high_px, depth, newest, 1.5 * tolerance), quads, tolerance)
        got = reliable(best_hypotheses(hypotheses(found, left, stars, width, height, scale, within), left, stars, width, height, scale[1], rules).withColumn("depth", F.lit(depth)))
        done = got if done is None else done.unionByName(got)
    names = [c for c in done.columns if c != "field_id"]
    return done.groupBy("field_id").agg(F.max(F.struct(*names)).alias("b")).select("field_id", *[f"b.{c}" for c in names])


def correspondences(sources: DataFrame, stars: DataFrame, wcs: Wcs, radius_px: float) -> DataFrame:
    """field_x, field_y, field_ra, field_dec, index_x, index_y, index_ra, index_dec, index_id, field_id, dist."""
    from starloom.operators.spatial import range_join

    px, py = wcs.radec_to_pixel("ra", "dec")
    ref = stars.where(wcs.contains("ra", "dec")).select(F.col("id").alias("index_id"), F.col("ra").alias("index_ra"), F.col("dec").alias("index_dec"), px.alias("index_x"), py.alias("index_y"))
    ra, dec = wcs.pixel_to_radec("x", "y")
    src = sources.select(F.col("rank").alias("field_id"), F.col("x").alias("field_x"), F.col("y").alias("field_y"), ra.alias("field_ra"), dec.alias("field_dec"))
    return range_join(src, ref, radius_px, ["field_x", "field_y"], ["index_x", "index_y"])
