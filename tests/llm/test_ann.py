import numpy as np
import pytest

from starloom.llm import ann


def exact(rows, every, k):
    """rows: (id, vector) -> {query id: ids of the k nearest, nearest first, ties to the smaller id}."""
    x = np.array([v for _, v in rows], float)
    ids = np.array([i for i, _ in rows])
    out = {}
    for i, v in rows:
        if i % every == 0:
            s = x @ np.array(v, float)
            order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != i]
            out[i] = [(int(ids[j]), s[j]) for j in order[:k]]
    return out


def answers(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    return got


@pytest.mark.parametrize("table", ["sf0.001", "sf0.1"])
def test_recall_on_the_table(spark, table):
    df = spark.read.parquet(f"/root/testdata/{table}/embeddings.parquet")
    want = exact([(r.vec_id, r.embedding) for r in df.collect()], 20, 20)
    got = answers(ann.nearest(df))
    assert got.keys() == want.keys()
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want])
    assert recall >= 0.9, recall
    best = {q: dict(v) for q, v in want.items()}
    for q, found in got.items():
        assert len(found) == 20 and [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        assert all(abs(best[q][i] - s) < 1e-12 for i, s in found if i in best[q])


def test_all_leaves_is_exact_with_hot_vectors_and_unequal_norms(spark):
    rng = np.random.default_rng(1)
    hot = rng.normal(size=8).round(2).tolist()
    rows = [(i, hot if i % 3 == 0 else (rng.normal(size=8) * rng.uniform(0.1, 3)).round(2).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = answers(ann.nearest(df, every=10, share=1.0, block_rows=20)), exact(rows, 10, 20)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0]), (None, [9.0, 9.0]), (20, [2.0, 0.0]), (20, [0.0, -1.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, q string, score int")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df).collect())
    assert [g for g in got if g[0] == 0] == [(0, 1, 20, 2.0), (0, 2, 1, 0.5), (0, 3, 20, 0.0)]
    assert sorted(g[2:] for g in got if g[0] == 20) == [(0, 0.0), (0, 2.0), (1, -0.5), (1, 1.0)]
    assert ann.nearest(df.limit(0)).count() == 0 and ann.nearest(df.where("vec_id = 0")).count() == 0
