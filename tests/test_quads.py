"""Quads of many cells at once against plain loops, and passes of the index build against each other."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.functions import healpix as hp
from starloom.operators import geohash as gh
from starloom.operators import verify as vf
from starloom.plans import catalogue, solving

LOW2, HIGH2 = ((2 * math.sin(math.radians(s) / 2)) ** 2 for s in (0.8, 1.8))


def plain(cell, ids, v, known):
    """The first quad of one cell, pair by pair."""
    for q in range(1, len(v)):
        for p in range(q):
            mid = v[p] + v[q]
            if not LOW2 <= ((v[p] - v[q]) ** 2).sum() <= HIGH2 or hp.np_xyz_to_cell((mid / np.linalg.norm(mid))[None], 30)[0] != cell:
                continue
            others = [i for i in range(len(v)) if i not in (p, q)]
            codes = {i: gh.np_sky_code(np.stack([v[p], v[q], v[i]])[None])[0].tolist() for i in others}
            held = [i for i in others if codes[i][0] ** 2 - codes[i][0] + codes[i][1] ** 2 - codes[i][1] <= 0]
            for i, j in itertools.combinations(held, 2):
                stars, code = gh.enforce([int(ids[k]) for k in (p, q, i, j)], [*codes[i], *codes[j]])
                if tuple(sorted(stars)) not in known:
                    return stars, code
    return None


@pytest.mark.parametrize("step", [2, 12, 1000])
def test_cells_at_once_are_cells_one_by_one(step):
    rng = np.random.default_rng(11)
    cells, lists = [], []
    for n in (0, 3, 4, 6, 9, 14, 30, 60, 60, 80):
        c = int(rng.integers(0, 12 * 30 * 30))
        middle = hp.np_cell_to_xyz(np.array([c]), 30)[0]
        v = middle + rng.normal(0, math.radians(0.9), (n, 3))
        cells.append(c)
        lists.append(v / np.linalg.norm(v, axis=1)[:, None])
    starts = np.concatenate([[0], np.cumsum([len(v) for v in lists])])
    ids = rng.permutation(starts[-1])
    known = [set() for _ in cells]
    made = 0
    for _ in range(4):
        got = {c: (s, k) for c, s, k in gh.first_quads(np.array(cells), starts, ids, np.concatenate(lists), known, 30, LOW2, HIGH2, step)}
        for i, v in enumerate(lists):
            want = plain(cells[i], ids[starts[i] : starts[i + 1]], v, known[i])
            assert (want is None) == (i not in got)
            if want:
                assert got[i][0] == want[0] and np.allclose(got[i][1], want[1], atol=1e-12)
                known[i].add(tuple(sorted(want[0])))
                made += 1
    assert made >= 15


def test_uses_are_counted_between_passes(spark):
    rng = np.random.default_rng(12)
    stars = spark.createDataFrame([(i, float(r), float(d), None if i % 50 == 0 else float(i % 97)) for i, (r, d) in enumerate(zip(180 + rng.uniform(-5, 5, 260), rng.uniform(-5, 5, 260), strict=True))], "id long, ra double, dec double, mag double")
    rows = gh.build_quads(stars, 30, 0.8, 1.8, passes=3, reuse=2).collect()
    used, before = {}, set()
    for turn in range(3):
        now = [r for r in rows if r.turn == turn]
        assert now and all(used.get(s, 0) < 2 for r in now for s in r.stars)
        assert len({r.cell for r in now}) == len(now) and not before & {tuple(sorted(r.stars)) for r in now}
        before |= {tuple(sorted(r.stars)) for r in now}
        for r in now:
            for s in r.stars:
                used[s] = used.get(s, 0) + 1


def test_sky_and_fields_are_made_once_and_a_stage_deals_its_fields_out(spark, tmp_path, monkeypatch):
    spark.range(1, 1501).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    asked, tasks = [], []
    for name in ("patches", "local_sky", "made_up_fields"):
        plain_one = getattr(solving, name)
        monkeypatch.setattr(solving, name, lambda *a, _f=plain_one, _n=name, **k: asked.append(_n) or _f(*a, **k))

    def seen(sources, *a, **k):
        plan = gh.field_quads(sources, *a, **k)
        tasks.append(plan.rdd.getNumPartitions())
        return plan

    monkeypatch.setattr(vf, "field_quads", seen)
    got = catalogue.QUERIES["solved_fields"](spark, str(tmp_path))
    assert sorted(asked) == ["local_sky", "made_up_fields", "patches"]
    assert tasks == [int(spark.conf.get("spark.sql.shuffle.partitions"))] * 2
    centres = {2 * p + h: solving.patch_header(p, h, 1).crval for p in range(3) for h in (1, 2)}
    rows = got.collect()
    assert len(rows) >= 4 and all(abs(r.dec - centres[r.field_id][1]) < 0.05 and r.logodds > math.log(1e9) for r in rows)
