"""Queries that once left rows out, on small tables and against brute force over all rows."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.functions import healpix as hp
from starloom.operators import geohash as gh
from starloom.operators import tables as tb
from starloom.operators.uniformize import grid_shape, round_robin
from starloom.plans import catalogue, solving
from starloom.sources import sinks


@pytest.fixture
def stars(spark, tmp_path):
    """Sixty suppliers in three lists: (folder, vectors by list and id)."""
    keys = list(range(1, 61))
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    lists = {}
    for k in keys:
        ra, dec = (np.radians(low + (k * k * m + k * n) % 1_000_003 * 24 / 1_000_003) for low, m, n in ((168, 31, 7919), (-12, 57, 104729)))
        lists.setdefault((k - 1) // 25, {})[k] = np.array([np.cos(dec) * np.cos(ra), np.cos(dec) * np.sin(ra), np.sin(dec)])
    return str(tmp_path), lists


def brute_quads(lists, low=8.0, high=13.0):
    """Every quad of every list with its code by trying all pairs and all inner stars."""
    out = {}
    for stars in lists.values():
        out |= brute_list(stars, low, high)
    return out


def brute_list(stars, low, high):
    out = {}
    for a, b in itertools.combinations(sorted(stars), 2):
        if not low <= np.degrees(2 * np.arcsin(np.linalg.norm(stars[a] - stars[b]) / 2)) <= high:
            continue
        mid = (stars[a] + stars[b]) / np.linalg.norm(stars[a] + stars[b])
        front = [s for s in stars if s not in (a, b) and stars[s] @ mid > 0.9]
        codes = {s: gh.np_sky_code(np.array([[stars[a], stars[b], stars[s]]]))[0].tolist() for s in front}
        inner = [s for s, (x, y) in codes.items() if x * x - x + y * y - y <= 0]
        for c, d in itertools.combinations(inner, 2):
            q, k = gh.enforce([a, b, c, d], codes[c] + codes[d])
            out[tuple(q)] = k
    return out


def test_quads_use_every_star(spark, stars):
    folder, v = stars
    want = brute_quads(v)
    got = {(r.a, r.b, r.c, r.d): r.code for r in catalogue.QUERIES["quad_codes"](spark, folder).collect()}
    assert len(want) > 100 and got.keys() == want.keys()
    assert all(np.allclose(got[q], want[q], atol=1e-5) for q in want)
    per_star = {r.star: r.n for r in catalogue.QUERIES["quads_per_star"](spark, folder).collect()}
    assert per_star == {s: sum(s in q for q in want) for s in {s for q in want for s in q}}


def test_every_order_is_deduplicated(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").collect()
    want = set()
    for field in {r.o_custkey // 10 for r in orders}:
        kept = []
        for r in sorted((r for r in orders if r.o_custkey // 10 == field), key=lambda r: (-r.o_totalprice, r.o_orderkey)):
            x, y = r.o_orderkey * 7919 % 211, r.o_orderkey * 104729 % 199
            if all((x - p) ** 2 + (y - q) ** 2 > 144 for p, q in kept):
                kept.append((x, y))
                want.add((field, r.o_orderkey))
    got = [(r.field, r.id) for r in catalogue.QUERIES["deduplicated_sources"](spark, sf).collect()]
    assert len(got) == len(want) < len(orders) and set(got) == want
    assert {f for f, _ in got} == {r.o_custkey // 10 for r in orders}


def test_job_info_joins_every_order(spark, sf):
    lines = {}
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").collect():
        lines.setdefault(r.l_orderkey, []).append(r.l_linenumber)
    owner = {r.c_custkey: (r.c_name, r.c_nationkey) for r in spark.read.parquet(f"{sf}/customer.parquet").collect()}
    place = {r.n_nationkey: r.n_name for r in spark.read.parquet(f"{sf}/nation.parquet").collect()}
    orders = spark.read.parquet(f"{sf}/orders.parquet").collect()
    want = {r.o_orderkey: (owner[r.o_custkey][0], place[owner[r.o_custkey][1]], sorted(lines[r.o_orderkey])) for r in orders if r.o_custkey in owner and r.o_orderkey in lines}
    got = catalogue.QUERIES["job_info"](spark, sf).collect()
    assert max(want) >= 200 and len(got) == len(want)
    assert {r.job: (r.owner, r.place, r.objects) for r in got} == want


def test_image_arithmetic_takes_every_pixel(spark, sf):
    want = {}
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").collect()
    for r in sorted(rows, key=lambda r: (r.l_orderkey, r.l_partkey, r.l_linenumber, r.l_shipdate, r.l_quantity, r.l_tax)):
        want.setdefault(r.l_suppkey, []).append(r.l_quantity * 2 - r.l_tax)
    got = {r.id: r.pixels for r in catalogue.QUERIES["image_arithmetic"](spark, sf).collect()}
    assert sum(map(len, got.values())) == len(rows) and got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], atol=1e-6) for k in want)


@pytest.mark.parametrize("n", [1500, 200_000])
def test_every_customer_takes_part_in_the_patches(spark, tmp_path, n):
    spark.range(1, n + 1).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    sky = solving.local_sky(spark, str(tmp_path)).toPandas()
    last, count, zoom = solving.patches(spark, str(tmp_path))
    assert sorted(sky["id"]) == list(range(1, n + 1)) and zoom == (1 if n < 10_000 else 2)
    assert sky["patch"].nunique() == count and sky.groupby("patch").size().max() <= 700
    v = hp.np_xyz_to_cell(np.stack([np.cos(np.radians(sky["dec"])) * np.cos(np.radians(sky["ra"])), np.cos(np.radians(sky["dec"])) * np.sin(np.radians(sky["ra"])), np.sin(np.radians(sky["dec"]))], axis=1), 8 * zoom)
    assert np.bincount(v).max() < 600 and not sky.duplicated(["ra", "dec"]).any()


def test_fields_of_all_patches(spark, tmp_path):
    spark.range(1, 1501).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    d = str(tmp_path)
    stars, sources = solving.local_sky(spark, d).cache(), solving.made_up_fields(spark, d).cache()
    got = {f: set() for f in range(1, 7)}
    for r in catalogue.QUERIES["field_index_correspondences"](spark, d).collect():
        got[r.field].add((r.field_id, r.index_id, r.dist))
    counts = dict.fromkeys(("rdls", "index_xyls", "index_rdls", "corr"), 0)
    for f in got:
        w = solving.patch_header((f - 1) // 2, (f - 1) % 2 + 1, 1)
        tables = sinks.field_tables(sources.where(f"field_id = {f}"), stars, w, 3.0)
        pairs = {(r.field_id, r.index_id, round(r.dist, 4)) for r in tables["corr"].collect()}
        assert len(pairs) > 20 and {p[:2] for p in pairs} == {p[:2] for p in got[f]}
        for name, t in tables.items():
            counts[name] += t.count()
    assert counts == {r.name: r.n for r in catalogue.QUERIES["field_solution_tables"](spark, d).collect()}
    fits = catalogue.QUERIES["plane_fits"](spark, d).collect()
    assert sorted(r.field_id for r in fits) == list(got) and all(r.sip_ok for r in fits)
    seen = {(r.field_id, r.header): r.logodds > 20.7 and r.n_match > 20 for r in catalogue.QUERIES["verified_headers"](spark, d).collect()}
    assert seen == {(f, h): f == h for p in range(3) for f in (2 * p + 1, 2 * p + 2) for h in (2 * p + 1, 2 * p + 2)}
    used = {s for r in catalogue.QUERIES["index_quads"](spark, d).collect() for s in r.stars}
    assert {r.patch for r in stars.collect() if r.id in used} == {0, 1, 2}


def test_every_quad_gets_its_matches(spark, stars):
    folder, v = stars
    want = brute_quads(v)
    codes = np.array(list(want.values()))
    near = [int((np.linalg.norm(codes - c, axis=1) <= 0.02).sum()) for c in codes]
    got = {(r.ga, r.gb, r.gc, r.gd): r.n for r in catalogue.QUERIES["code_range_match"](spark, folder).collect()}
    assert any(sum(q) % 4 for q in want) and got == dict(zip(want, near, strict=True))


def test_shell_words_split_whole_sources(spark, tmp_path):
    sources = ["src1", "src10", "src19", "", "rr", None]
    spark.createDataFrame([(i, s, "it's") for i, s in enumerate(sources)], "doc_id long, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.parts for r in catalogue.QUERIES["shell_words"](spark, str(tmp_path)).collect()}
    assert got == {i: None if s is None else s.replace("r", "|") for i, s in enumerate(sources)}


def test_mode_against_numpy(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(50, 5, 4000), rng.uniform(0, 200, 800)])
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "v double")
    got = tb.column_mode(df, "v").first()
    a, b = np.quantile(v, [0.02, 0.98])
    n, edges = np.histogram(v[(v >= a) & (v <= b)], bins=64, range=(a, b))
    mid = (edges[1:] + edges[:-1]) / 2
    use = n >= 0.5 * n.max()
    c = np.polyfit(mid[use], np.log(n[use]), 2, w=np.sqrt(n[use]))
    assert abs(got["mode"] + c[1] / (2 * c[0])) < 1e-6 and abs(got["mode"] - 50) < 1 and got["bracketed"]
    for odd in ([], [3.0] * 9, [1.0, 2.0]):
        row = tb.column_mode(spark.createDataFrame([(x,) for x in odd], "v double"), "v").first()
        assert (row["mode"], row["bracketed"]) == (None, False)


@pytest.mark.parametrize(("width", "height", "boxes", "want"), [(10, 10, 100, (10, 10)), (400, 1, 9, (60, 1)), (1, 400, 9, (1, 9)), (3, 1, 12, (6, 2)), (1, 3, 12, (2, 6)), (7, 5, 1, (1, 1)), (2048, 1024, 50, (10, 5))])
def test_shape_of_even_grids(width, height, boxes, want):
    columns, rows = grid_shape(width, height, boxes)
    assert (columns, rows) == want
    best = min(abs(np.log(width / c) - np.log(height / max(1, round(boxes / c)))) for c in range(1, boxes * 10) if max(1, boxes / c) * c <= 1.5 * boxes)
    assert width / height > boxes or height / width > boxes or abs(np.log(width / columns) - np.log(height / rows)) <= best + 0.5


def test_sources_in_turns(spark):
    rng = np.random.default_rng(8)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 100, (300, 2)))] + [(900, None, 1.0), (901, float("nan"), 1.0), (902, float("inf"), 2.0)]
    got = sorted(round_robin(spark.createDataFrame(pts, "id long, x double, y double"), "x", "y", "id", 25).collect(), key=lambda r: r.place)
    assert [r.place for r in got] == list(range(300)) and [(r.turn, r.box) for r in got] == sorted((r.turn, r.box) for r in got)
    xs, ys = ([p[k] for p in pts[:300]] for k in (1, 2))
    box = lambda v, all_v: min(int((v - min(all_v)) / (max(all_v) - min(all_v)) * 5), 4)
    assert all(r.box == box(r.y, ys) * 5 + box(r.x, xs) for r in got)
    line = spark.createDataFrame([(1, 2.0, 1.0), (2, 2.0, 5.0)], "id long, x double, y double")
    assert sorted((r.id, r.box, r.place) for r in round_robin(line, "x", "y", "id", 9).collect()) == [(1, 0, 0), (2, 0, 1)]


def test_nearby_images_by_level(spark, sf):
    rows = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey").collect()
    image = {}
    for k in (r[0] for r in rows):
        dec, ra = math.asin(2 * (k * 0.6180339887498949 % 1) - 1), math.radians(k * 137.50776405003785 % 360)
        n = (8, 16, 32)[k % 3]
        image[k] = (n, int(hp.np_xyz_to_cell(np.array([[math.cos(dec) * math.cos(ra), math.cos(dec) * math.sin(ra), math.sin(dec)]]), n)[0]))
    split = lambda n, c: (c // (n * n), c % (n * n) // n, c % n)
    join = lambda n, b, x, y: b * n * n + x * n + y
    want = set()
    for k, (n, c) in image.items():
        b, x, y = split(n, c)
        stages = [{(n, c)}, {(n, m) for m in hp.np_neighbours(c, n)}, {(n // 2, join(n // 2, b, x // 2, y // 2))} | {(2 * n, m) for i in (0, 1) for j in (0, 1) for m in hp.np_neighbours(join(2 * n, b, 2 * x + i, 2 * y + j), 2 * n)}]
        found = set()
        for stage, cells in enumerate(stages):
            found |= {(k, o, stage) for o, at in image.items() if at in cells}
            if len(found) > 6:
                break
        want |= {f for f in found if f[1] != k}
    got = [tuple(r) for r in catalogue.QUERIES["nearby_images_by_level"](spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_fits_with_nulls_and_dependent_regressors(spark):
    rows = [(1, x, y, 2.0 * x - 3.0 * y + 5.0, x + 1.0) for x in range(4) for y in range(3)] + [(1, None, 1, 9.0, 9.0)] + [(2, x, 3 * x + 1, 1.0 * x, 0.0) for x in range(5)] + [(3, 1, 1, None, 1.0)]
    t = spark.createDataFrame(rows, "k int, x int, y int, a double, b double")
    got = {r["g"]: [None if v is None else round(v, 9) + 0.0 for v in r[1:]] for r in tb.plane_fit(t, F.col("k"), "x", "y", ["a", "b"]).collect()}
    assert got == {1: [2.0, -3.0, 5.0, 1.0, 0.0, 1.0], 2: [None] * 6}
    assert tb.plane_fit(t.limit(0), F.col("k"), "x", "y", ["a"]).count() == 0


def test_transpose_product(spark):
    entries = spark.createDataFrame([(1, 7, 2.0), (2, 7, 3.0), (2, 8, 1.0), (3, 9, None), (4, 9, 5.0)], "r int, c int, v double")
    vector = spark.createDataFrame([(1, 10.0), (2, 1.0), (3, 1.0)], "r int, value double")
    assert {r["c"]: r["product"] for r in tb.transpose_product(entries, vector).collect()} == {7: 23.0, 8: 1.0, 9: None}
