"""Dense skies against brute force: totals, lists, nearest in growing radii, counts by cells."""

import numpy as np
import pytest

from starloom.functions.healpix import np_radec_to_xyz
from starloom.operators import blocks as bl
from starloom.operators import spatial as sj

RADIUS = 7.0


@pytest.fixture(scope="module")
def skies(spark):
    rng = np.random.default_rng(3)
    out = []
    for n in (500, 12_000):
        ra, dec = rng.uniform(0, 360, n), np.degrees(np.arcsin(rng.uniform(-1, 1, n)))
        # a crowd of copies and neighbours, the poles and both sides of RA 0
        ra[:150], dec[:150] = 40.0 + rng.integers(0, 5, 150) * 0.01, 10.0
        ra[150:152], dec[150:154] = (0.001, 359.999), (5.0, 5.0, 90.0, -90.0)
        rows = [(i * 3 % n, float(a), float(b)) for i, (a, b) in enumerate(zip(ra, dec, strict=True))]
        df = spark.createDataFrame([*rows, (n + 1, None, None), (n + 2, float("nan"), 1.0)], "id long, ra double, dec double")
        out.append((df, np.array([r[0] for r in rows]), np_radec_to_xyz(ra, dec)))
    return out


@pytest.fixture(scope="module")
def near(skies):
    (_, ids, p), (_, other, q) = skies
    gap = np.linalg.norm(p[:, None] - q, axis=-1)
    sep = np.degrees(2 * np.arcsin(np.minimum(gap / 2, 1)))
    want = {}
    for i, j in zip(*np.nonzero(gap <= 2 * np.sin(np.radians(RADIUS / 2))), strict=True):
        want.setdefault(int(ids[i]), []).append((round(float(sep[i, j]), 9), int(other[j])))
    return {k: sorted(v) for k, v in want.items()}


def test_lists_and_totals(skies, near, monkeypatch):
    monkeypatch.setattr(bl, "LEFT", 16)
    monkeypatch.setattr(bl, "RIGHT", 33)
    monkeypatch.setattr(bl, "AT_ONCE", 100)
    got = {r.l_id: list(r.ids) for r in bl.sky_lists(skies[0][0], skies[1][0], RADIUS).collect()}
    assert got == {k: sorted(r for _, r in v) for k, v in near.items()}
    below = [s for k, v in near.items() for s, r in v if k < r]
    row = bl.sky_pair_totals(skies[0][0], skies[1][0], RADIUS).first()
    assert row.n == len(below) and abs(row.total - sum(below)) < 1e-5
    none = bl.sky_pair_totals(skies[0][0].limit(0), skies[1][0], RADIUS).first()
    assert none.n == 0 and none.total is None


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_in_growing_radii(skies, near, k):
    assert len(sj._cell_sizes(skies[1][0], 0.12, k)) > 1
    best = (lambda pairs: sj.nearest(pairs)) if k == 1 else lambda pairs: sj.k_nearest(pairs, k)
    got = {}
    for r in sj.k_nearest_within(skies[0][0], skies[1][0], RADIUS, k, best).collect():
        got.setdefault(r.l_id, []).append((round(r.sep, 9), r.r_id))
    assert got.keys() == near.keys()
    for i, v in got.items():
        assert [s for s, _ in sorted(v)] == [s for s, _ in near[i][:k]]
    same = [i for i, v in got.items() if sorted(v) == near[i][:k]]
    assert len(same) > len(got) * 0.95  # the others differ in ties of rounded distances only


def test_counts_by_cells(skies, near):
    for parts in (3, 32):
        got = {r.l_id: r.n for r in sj.count_within(skies[0][0], skies[1][0], RADIUS, parts).collect()}
        assert got == {k: len(v) for k, v in near.items()}


@pytest.mark.parametrize("radius", [0.5, 2.5, 3.5, 20.0])
def test_friends_of_friends_by_cells(spark, radius):
    """Clusters of a chain, a crowd and scattered points are those of all pairs; cells that touch only just are measured."""
    rng = np.random.default_rng(int(radius))
    ra, dec = rng.uniform(0, 360, 300), np.degrees(np.arcsin(rng.uniform(-1, 1, 300)))
    ra[:120], dec[:120] = 100 + rng.normal(0, 0.3, 120), 20 + rng.normal(0, 0.3, 120)
    ra[120:150], dec[120:150] = 200 + 1.001 * np.arange(30) * radius, 0.0
    ids = rng.permutation(300) + 5
    df = spark.createDataFrame([(int(i), float(a), float(b)) for i, a, b in zip(ids, ra, dec, strict=True)], "id long, ra double, dec double")
    p = np_radec_to_xyz(ra, dec)
    near = np.linalg.norm(p[:, None] - p, axis=-1) <= 2 * np.sin(np.radians(radius / 2))
    root = ids.copy()
    while True:
        new = np.array([root[n].min() for n in near])
        if (new == root).all():
            break
        root = new
    want = {int(i): int(r) for i, r, n in zip(ids, root, near, strict=True) if n.sum() > 1}
    assert {r.id: r.cluster for r in sj.friends_of_friends(df, radius).collect()} == want
    everyone = {r.id: r.cluster for r in sj.friends_of_friends(df, radius, singles=True).collect()}
    assert everyone == {int(i): int(r) for i, r in zip(ids, root, strict=True)}


@pytest.mark.parametrize("together", [1000, 1 << 20])
def test_pairs_in_the_order_of_distance(skies, monkeypatch, together):
    """All pairs of small blocks, of rings and without equal ids, however many are sorted together."""
    monkeypatch.setattr(bl, "LEFT", 16)
    monkeypatch.setattr(bl, "RIGHT", 33)
    monkeypatch.setattr(bl, "AT_ONCE", 100)
    monkeypatch.setattr(bl, "SORTED", together)
    monkeypatch.setattr(bl, "CODE", 7 if together == 1000 else 17)
    (left, ids, p), (right, other, q) = skies
    gap = np.linalg.norm(p[:, None] - q, axis=-1)
    sep = np.degrees(2 * np.arcsin(np.minimum(gap / 2, 1)))
    for low, differ in ((None, False), (None, True), (3.0, False)):
        at = np.nonzero((sep <= RADIUS) & (sep >= (low or 0.0)) & ((ids[:, None] != other) | (not differ)))
        want = sorted(zip(ids[at[0]].tolist(), other[at[1]].tolist(), sep[at].tolist(), strict=True))
        rows = sorted(map(tuple, bl.sky_pairs(left, right, RADIUS, low, differ).collect()))
        assert [r[:2] for r in rows] == [w[:2] for w in want]
        assert all(abs(r[2] - w[2]) < 1e-6 and r[2] == round(r[2], 6) for r, w in zip(rows, want, strict=True))
    assert bl.sky_pairs(left.limit(0), right, RADIUS).count() == 0


def dense_stretch(spark, folder, name, key, n, every=1):
    """``n`` rows of a table whose keys lie side by side on the sky, as dense as 900,000 of them, or every so manieth."""
    k = np.arange(900_000)
    k = k[np.abs(k * 0.6180339887498949 % 1.0 - 0.46) < n / 1_800_000][::every]
    spark.createDataFrame([(int(i),) for i in k], f"{key} long").repartition(1).write.parquet(f"{folder}/{name}.parquet")


def bytes_a_row(spark, name, folder):
    from starloom.plans import catalogue

    catalogue.QUERIES[name](spark, str(folder)).write.parquet(f"{folder}/out")
    return sum(f.stat().st_size for f in (folder / "out").glob("*.parquet")) / spark.read.parquet(f"{folder}/out").count()


def test_pairs_with_oneself_take_little_disk(spark, tmp_path):
    dense_stretch(spark, tmp_path, "customer", "c_custkey", 4_000)
    assert bytes_a_row(spark, "xmatch_notself", tmp_path) < 7


def test_pairs_of_two_skies_take_little_disk(spark, tmp_path):
    dense_stretch(spark, tmp_path, "customer", "c_custkey", 12_000)
    dense_stretch(spark, tmp_path, "supplier", "s_suppkey", 1_500)
    assert bytes_a_row(spark, "xmatch_radec", tmp_path) < 7


def test_pairs_of_a_ring_take_little_disk(spark, tmp_path):
    dense_stretch(spark, tmp_path, "customer", "c_custkey", 40_000, 8)
    dense_stretch(spark, tmp_path, "supplier", "s_suppkey", 40_000, 8)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert bytes_a_row(spark, "xmatch_annulus", tmp_path) < 7
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_lists_of_all_rows(spark, skies, near, monkeypatch):
    """Every left row has its list, those without position or partner a null one; ids that occur twice get what both find."""
    monkeypatch.setattr(bl, "LEFT", 16)
    monkeypatch.setattr(bl, "RIGHT", 33)
    (left, ids, _), (right, _, _) = skies
    want = {int(i): sorted(r for _, r in near[int(i)]) if int(i) in near else None for i in ids} | {501: None, 502: None}
    rows = bl.all_sky_lists(left, right, RADIUS).collect()
    assert len(rows) == 502 and {r.l_id: r.ids for r in rows} == want
    alone = bl.all_sky_lists(left, right.limit(0), RADIUS).collect()
    assert len(alone) == 502 and all(r.ids is None for r in alone)
    twice = bl.all_sky_lists(left.unionByName(left), right, RADIUS).collect()
    assert len(twice) == 1004 and all(r.ids == (want[r.l_id] and sorted(want[r.l_id] * 2)) for r in twice)


def test_lists_are_not_shuffled(spark, sf):
    """No exchange lies above the kernel that makes the lists."""
    from starloom.plans import catalogue

    plan = catalogue.QUERIES["xmatch_list"](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert not [line for line in plan[: plan.index("MapInArrow run")].splitlines() if "Exchange" in line or "Join" in line or "Aggregate" in line]


@pytest.mark.parametrize("name", ["nearby_images", "nearby_images_by_level"])
def test_images_meet_a_crowded_cell_in_parts(spark, tmp_path, name):
    """The partners of an image come in short lists, which come again for the next image."""
    from starloom.plans import catalogue

    k = np.arange(900_000)
    k = k[(np.abs(k * 0.6180339887498949 % 1.0 - 0.46) < 0.0003) & (k % 3 == 2)]
    spark.createDataFrame([(int(i),) for i in k], "c_custkey long").repartition(1).write.parquet(f"{tmp_path}/customer.parquet")
    ids = np.array([r.id for r in catalogue.QUERIES[name](spark, str(tmp_path)).select("id").collect()])
    runs = np.diff(np.flatnonzero(np.diff(ids, prepend=-1, append=-1)))
    assert len(ids) > len(k) * 80 and runs.max() < 0.4 * np.bincount(ids).max()
