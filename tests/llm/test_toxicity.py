import math
import random

import numpy as np

from starloom.llm import toxicity as tx
from starloom.llm.common import fold_of_value


def slow_segments(scores):
    """Maximal segments by definition: take the best segment, then search left and right of it."""

    def go(lo, hi):
        best = max(((sum(scores[a : b + 1]), -(b - a), -a, a, b) for a in range(lo, hi) for b in range(a, hi)), default=None)
        if best is None or best[0] <= 0:
            return []
        *_, a, b = best
        return go(lo, a) + [(best[0], a, b)] + go(b + 1, hi)

    return go(0, len(scores))


def test_maximal_segments():
    rng = random.Random(4)
    for _ in range(300):
        scores = [float(rng.choice([-7, -5, -3, -2, 2, 3, 5, 11]) * rng.random()) for _ in range(rng.randint(0, 14))]
        got = tx.maximal_segments(scores, [(i, i) for i in range(len(scores))])
        want = slow_segments(scores)
        assert [(a, b) for _, a, b in got] == [(a, b) for _, a, b in want]
        assert np.allclose([s for s, *_ in got], [s for s, *_ in want])


def test_decay_solves_the_background_equation():
    for p, s, d in ((0.001, 6.0, 0.05), (0.005, 3.0, 0.05), (1e-5, 8.0, 0.1)):
        x = tx._decay(p, s, d)
        assert x > 0 and abs(p * math.exp(x * (s - d)) + (1 - p) * math.exp(-x * d) - 1) < 1e-6


def test_held_out(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = tx.detect(docs, labels).collect()
    assert len(rows) == docs.count() and all(r.held_out == (fold_of_value(r.doc_id) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([t == p for t, p in held]) > 0.97
    assert np.mean([p for t, p in held if t]) > 0.85 and np.mean([p for t, p in held if not t]) < 0.01


def test_odd_rows(spark):
    rows = [(i, "you utter scumbag scumbag indeed" if i % 3 == 0 else "a nice day for a walk", i % 3 == 0) for i in range(90)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(200, None), (201, ""), (202, "nice " * 100_000), (203, "?!"), (None, "scumbag"), (0, rows[0][1])], "doc_id long, text string").selectExpr("*", "1 as toxic", "'x' as score")
    labels = spark.createDataFrame([(r[0], int(r[2])) for r in rows] + [(0, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in tx.detect(docs, labels).collect()}
    assert got[200].score == got[201].score == got[202].score == got[203].score < 0.5
    assert all(got[i].predicted == int(t) for i, _, t in rows)
    assert tx.detect(docs.limit(0), labels).count() == 0
    assert {r.score for r in tx.detect(docs, labels.limit(0)).collect()} == {0.5}


def test_scores_do_not_move_with_the_caps(spark):
    text = lambda i, toxic: "you utter scumbag indeed" if (i // 5) % 20 < (12 if toxic else 1) else "a nice day for a walk"
    rows = [(i, text(i, i % 5 == 0), int(i % 5 == 0)) for i in range(4000)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    whole, capped = tx.train(docs, labels), tx.train(docs, labels, max_clean=400)
    for words in ("a nice day for a walk", "you utter scumbag indeed"):
        share = np.mean([t for i, x, t in rows if x == words and fold_of_value(i)])
        assert abs(whole.score(words) - share) < 0.02 and abs(capped.score(words) - share) < 0.06


def test_every_candidate_is_counted_and_tested(spark):
    sample = spark.createDataFrame([("bad bad worse", True), ("bad worse", True), ("one two three four", False), (None, False)], "text string, toxic boolean")
    rows, length = tx._count_tokens(sample, 2)
    got = {(r.token, r.stem): (r.toxic, r.clean) for r in rows.collect()}
    assert length == 4 and got == dict.fromkeys([("bad", False), ("worse", False), ("bad", True), ("wor", True), ("wors", True), ("worse", True)], (2, 0))
    assert tx._lexicon(rows, 2, 2, 0.5, 1.0) == []  # two of two by chance: not lopsided enough for six tests
    many = spark.createDataFrame([("bad", False, 40, 1), ("even", False, 40, 60), ("few", False, 3, 0)], "token string, stem boolean, toxic long, clean long")
    assert [r.token for r in tx._lexicon(many, 100, 150, 1.0, 0.1)] == ["bad"]


def test_k_is_the_likeliest(spark):
    model = tx.ToxicityModel({"bad": 4.0}, {}, 0.05)
    model.decay = 0.7
    texts = ["fine " * n + "bad " * b for n, b in ((50, 0), (80, 1), (200, 1), (30, 0), (500, 2), (120, 0), (60, 1))]
    log_k = tx._log_k(spark.createDataFrame([(t,) for t in texts], "text string"), model)
    best = [model.best(t) for t in texts]

    def likelihood(log_k):
        k = math.exp(log_k)
        return sum(-k * n * math.exp(-model.decay * s) + (log_k if s > 0 else 0.0) for s, n in best)

    grid = np.linspace(log_k - 2, log_k + 2, 4001)
    assert abs(grid[int(np.argmax([likelihood(g) for g in grid]))] - log_k) < 0.2
