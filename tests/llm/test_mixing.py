import pytest
from pyspark.sql import functions as F

from starloom.llm import mixing


def slow_targets(sizes, weights=(5, 2, 1), cap=3):
    """Water-filling by rounds: clamp what exceeds its cap, share the excess by weight among the rest."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, clamped = sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in clamped]
        left = total - sum(cap * sizes[s] for s in clamped)
        level = left / sum(w[s] for s in open_) if open_ else 0
        over = [s for s in open_ if level * w[s] > cap * sizes[s]]
        if not over:
            return {s: cap * sizes[s] if s in clamped else level * w[s] for s in names}
        clamped |= set(over)


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1000, "c": 5, None: 7}, {"a": 0, "b": 3}, {"é": 5, "z": 900, "Z": 1, "a": 2, "b": 30}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(slow_targets(sizes))


def test_mix_and_odd_rows(spark):
    rows = [(i, "w " * (i % 7), "hot" if i % 3 else f"s{i % 5}") for i in range(300)] + [(None, None, None), (1, "a b", "hot"), (1, "a b", "hot"), (5, "x " * 50_000, "long"), (6, "", "none"), (7, " \t\n\x0b\x0c\r", "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("weight", F.lit(9))
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    totals = {}
    for i, t, s in rows:
        totals[s] = totals.get(s, 0) + len((t or "").split())
    goal, taken, n = slow_targets(totals), {}, {}
    for r in got:
        assert r.source_size == totals[r.source] and r.target == pytest.approx(goal[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source], n[r.source] = taken.get(r.source, 0) + r.taken, n.get(r.source, 0) + 1
    assert all(abs(taken[s] - goal[s]) <= 0.5 for s in goal)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, mixing.mix(docs, max_broadcast=0).collect()))
    rep = mixing.repeat_rows(docs)
    assert "weight" in rep.columns and rep.agg(F.sum("words")).first()[0] == sum(r.taken for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.repeat_rows(docs.limit(0)).count() == 0


@pytest.mark.parametrize("few", [1_000, 3])
def test_null_and_repeated_ids_in_bulk(spark, monkeypatch, few):
    """Sources of rows without an id, of one row repeated, of three ids, of one id with many texts, and of one very long text."""
    monkeypatch.setattr(mixing, "FEW", few)
    rows = [(None, "word", "a")] * 500 + [(i % 3, "word", "b") for i in range(900)] + [(7, f"w{i} x", "c") for i in range(400)] + [(None, f"v{i} " * (i % 9), "d") for i in range(700)] + [(8, "z " * 5000, "e"), (9, "z", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    totals, taken = {}, {}
    for _, t, s in rows:
        totals[s] = totals.get(s, 0) + len(t.split())
    goal = slow_targets(totals)
    got = mixing.mix(docs).collect()
    cut = {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 3 * r.size
        if r.size and r.taken % r.size:
            cut[r.source] = cut.get(r.source, 0) + 1
    assert len(got) == len(rows) and all(abs(taken[s] - goal[s]) <= 0.5 for s in goal)
    # whole documents are sampled; at most one a source is cut
    assert all(v == 1 for v in cut.values())
    repetitions = {s: {r.taken // r.size for r in got if r.source == s and r.size} for s in goal}
    assert all(max(v) - min(v) <= 1 for v in repetitions.values())


def test_the_sample_depends_on_the_seed_and_not_on_the_order_of_rows(spark):
    rows = [(i, f"w{i} " * (1 + i % 5), "ab"[i % 2]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = lambda df, **o: sorted((r.doc_id, r.taken) for r in mixing.mix(df, **o).collect())
    assert taken(docs) == taken(docs.orderBy(F.desc("doc_id"))) == taken(docs.repartition(7)) != taken(docs, seed=18)
