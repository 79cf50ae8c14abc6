"""The saved star index: pruned reading, bounds, merging."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.sources import starindex as si


@pytest.fixture(scope="module")
def stars():
    rng = np.random.default_rng(4)
    n = 3000
    ra, dec = rng.uniform(0, 360, n), np.degrees(np.arcsin(rng.uniform(-1, 1, n)))
    dec[:2] = 90.0, -90.0
    ra[2:4], dec[2:4] = (0.0, 359.9999), 0.0
    return [(i, float(a), float(d), float(i % 17), f"n{i}") for i, (a, d) in enumerate(zip(ra, dec, strict=True))]


SCHEMA = "id long, ra double, dec double, mag double, name string"


@pytest.fixture(scope="module")
def index(spark, stars, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "a")
    odd = [*stars, (9000, None, 1.0, 0.0, None), (9001, 1.0, None, 0.0, None)]
    si.save(spark.createDataFrame(odd, SCHEMA), path, rows_per_file=100, nside=64)
    return si.open_index(spark, path)


def plain(stars, ra, dec, radius):
    p = np.array(si.unit(ra, dec))
    return {s[0] for s in stars if np.linalg.norm(np.array(si.unit(s[1], s[2])) - p) <= si.chord(radius)}


@pytest.mark.parametrize("cone", [(72.0, 37.0, 4.0), (10.0, 90.0, 6.0), (0.0, 0.0, 3.0), (180.0, -90.0, 2.0), (33.0, 12.0, 170.0), (33.0, 12.0, 1e-9)])
def test_cones(index, stars, cone):
    got = index.cone(*cone).collect()
    assert {r.id for r in got} == plain(stars, *cone) and len(got) == len({r.id for r in got})
    assert all(r.sep <= cone[2] + 1e-9 for r in got)


def test_only_the_needed_files_are_opened(index, stars):
    whole = set(index.read().inputFiles())
    assert len(whole) == 30
    opened = set(index.cone(72.0, 37.0, 4.0, ["mag"]).inputFiles())
    assert 0 < len(opened) <= 6
    held = {r.file: r for r in index.manifest.collect()}
    p = si.unit(72.0, 37.0)
    for file, r in held.items():
        gap = math.sqrt(sum(max(r[f"min_{a}"] - v, v - r[f"max_{a}"], 0.0) ** 2 for a, v in zip("xyz", p, strict=True)))
        assert (gap <= si.chord(4.0)) == any(o.split("/")[-1] == file.split("/")[-1] for o in opened)


def test_the_scan_reads_few_columns_and_gets_the_box(spark, index):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = index.cone(72.0, 37.0, 4.0, ["mag"])._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    schema = plan[plan.index("ReadSchema") :].split(">")[0]
    assert "mag" in schema and "name" not in schema
    assert "GreaterThanOrEqual(x," in plan and "LessThanOrEqual(z," in plan


@pytest.mark.parametrize(("at", "k", "within"), [((200.0, -60.0), 12, 180.0), ((0.0, 90.0), 1, 180.0), ((5.0, 5.0), 50, 3.0), ((5.0, 5.0), 9999, 180.0)])
def test_nearest(index, stars, at, k, within):
    p = np.array(si.unit(*at))
    sep = {s[0]: math.degrees(2 * math.asin(min(1.0, np.linalg.norm(np.array(si.unit(s[1], s[2])) - p) / 2))) for s in stars}
    want = [i for i, v in sorted(sep.items(), key=lambda v: (v[1], v[0])) if v <= within][:k]
    assert [r.id for r in index.nearest(*at, k, within=within).collect()] == want


def test_bounds_hold_for_every_star(index):
    nodes = {r.file: (r.nearest, r.farthest, r.n) for r in index.nodes(72.0, 37.0).collect()}
    p = np.array(si.unit(72.0, 37.0))
    for r in index.read().select("x", "y", "z", F.col("_metadata.file_path").alias("file")).collect():
        low, high, _ = nodes[r.file]
        assert low - 1e-12 <= np.linalg.norm(np.array([r.x, r.y, r.z]) - p) <= high + 1e-12
    assert sum(v[2] for v in nodes.values()) == index.n == 3000


def test_places_follow_the_curve(index):
    rows = index.permutation().orderBy("star").collect()
    assert [r.star for r in rows] == list(range(3000)) and {r.id for r in rows} == set(range(3000))
    firsts = [r.first_star for r in index.manifest.orderBy("first_star").collect()]
    assert firsts[0] == 0 and firsts == sorted(firsts)


def test_merged_by_manifest(spark, index, stars, tmp_path):
    other = spark.createDataFrame([(i, 72.0 + i / 10, 37.0, 1.0) for i in range(40)], "id long, ra double, dec double, bright double")
    si.save(other, str(tmp_path / "b"), rows_per_file=10)
    both = si.merge(spark, [index.path, str(tmp_path / "b")], str(tmp_path / "ab"))
    again = si.merge(spark, [str(tmp_path / "ab"), str(tmp_path / "b")], str(tmp_path / "abb"))
    assert both.n == 3040 and again.n == 3080
    got = {(r.part, r.id) for r in again.cone(72.0, 37.0, 2.0).collect()}
    near = {r.id for r in other.collect() if (r.ra - 72.0) * math.cos(math.radians(37.0)) <= 2.0}
    assert got == {(0, i) for i in plain(stars, 72.0, 37.0, 2.0)} | {(p, i) for p in (1, 2) for i in near}
    seen = both.cone(72.0, 37.0, 2.0)
    assert "bright" not in seen.columns and not any("/ab/" in f for f in seen.inputFiles())


def test_odd_indexes(spark, index, tmp_path):
    assert index.cones([]).count() == 0
    empty = si.save(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"))
    assert empty.n == 0 and empty.cone(1.0, 2.0, 3.0, ["mag"]).count() == 0
    with pytest.raises(ValueError, match="itself"):
        si.save(spark.createDataFrame([(1, 1.0, 2.0, 3.0)], "id long, ra double, dec double, X double"), str(tmp_path / "x"))


def test_a_save_that_did_not_end_is_no_index(spark, index, tmp_path):
    index.read().drop("part").write.parquet(str(tmp_path / "half" / "stars"))
    with pytest.raises(Exception, match="manifest"):
        si.open_index(spark, str(tmp_path / "half")).n  # noqa: B018
