import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from starloom.llm import periodic
from starloom.llm.periodic import Run


def slow(w, min_length=6, min_exponent=4):
    """Every maximal repetition by trying all periods, the smallest first."""
    found, seen = [], set()
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if (i, j + p) not in seen and j + p - i >= 2 * p:
                seen.add((i, j + p))
                found.append(Run(i, j + p - i, p))
            i = j + 1
    return sorted((r for r in found if r.length >= max(min_length, min_exponent * r.period)), key=lambda r: (r.start, r.period))


sequence = st.lists(st.integers(0, 3), max_size=70) | st.builds(lambda head, root, k, cut, tail: head + root * k + root[:cut] + tail, *[st.lists(st.integers(0, 2), min_size=i, max_size=6) for i in (0, 1)], st.integers(2, 9), st.integers(0, 4), st.lists(st.integers(0, 2), max_size=6))


@settings(max_examples=400, deadline=None)
@given(st.lists(sequence, max_size=4), st.sampled_from([(6, 4), (6, 4), (1, 2), (6, 3), (10, 5)]))
def test_runs_of_several_sequences(sequences, limits):
    got = periodic.find_runs([np.array(s, np.int64) for s in sequences], *limits)
    assert got == [slow(s, *limits) for s in sequences]


@pytest.mark.parametrize("w", [[0] * 3000, [0] + [1] * 3000, list(range(700)) * 4, [0, 1] * 900 + [1, 0] * 900, ([0] * 30 + [1]) * 50, list(range(400)) * 2])
def test_long_repeats(w):
    assert periodic.find_runs([np.array(w, np.int64)]) == [slow(w)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=50), st.data())
def test_common_prefixes(w, data):
    a = np.array(w, np.int64)
    s = periodic.Suffixes(a, np.zeros(len(w), np.int64), np.full(len(w), len(w)))
    assert [w[i:] for i in s.order.tolist()] == sorted(w[i:] for i in range(len(w)))
    i = data.draw(st.integers(0, len(w) - 1))
    j = data.draw(st.integers(0, len(w) - 1))
    if i != j:
        want = next((k for k in range(len(w)) if max(i, j) + k >= len(w) or w[i + k] != w[j + k]), 0)
        assert s.common(np.array([min(i, j)]), np.array([max(i, j)])).tolist() == [want]


def test_the_work_is_linear_but_for_sorting():
    import time

    def took(n):
        w = [np.array(([0] * 40 + [1]) * (n // 41), np.int64), np.r_[0, np.ones(n, np.int64)]]
        return min((lambda t: (periodic.find_runs(w), time.perf_counter() - t)[1])(time.perf_counter()) for _ in range(3))

    assert took(160_000) < 8 * took(40_000)


def expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = slow(w)
    gone = {i for r in runs for i in range(r.start + r.period, r.start + r.length)}
    best = min(runs, key=lambda r: (-(r.length * 10**9 // r.period), r.start, r.period), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    digests = sha("".join(f"{r.start},{r.length},{r.period}\n" for r in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))
    return doc_id, len(runs), *((best.start, best.length, best.period, 1000 * best.length // best.period) if best else (None,) * 4), *digests


def test_documents_and_odd_rows(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect() if len(r.text or "") < 6000]
    docs += [(None, None), (None, "a b " * 20), (7, ""), (7, " \t\n"), (900, "Ü é\x0bÜ é\x85 " * 9), (900, "Ü é\x0bÜ é\x85 " * 9), (901, "x " * 5), (902, "x " * 6), (903, "x x x x x x y " * 8)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as runs", "'p' as period", "2 as b")
    got = periodic.summary(periodic.detect(df, rewrite=periodic.looped))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = sorted((expected(*d) for d in docs), key=str)
    assert sum(r[1] for r in want) > 20
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert periodic.summary(periodic.detect(df.limit(0))).count() == 0


def test_texts_as_they_are(spark):
    df = spark.createDataFrame([(1, "go " + "la la lo " * 5 + "end"), (2, "la la lo la la lo la la lo")], "doc_id long, text string")
    got = {r.doc_id: r for r in periodic.detect(df).collect()}
    assert [tuple(x) for x in got[1].runs] == [(1, 15, 3)]
    assert got[1].text == "go la la lo end"
    assert got[2].runs == [] and got[2].text == "la la lo la la lo la la lo"
    assert [tuple(x) for x in periodic.detect(df, min_exponent=3).where("doc_id = 2").first().runs] == [(0, 9, 3)]


def test_pieces_cut_between_documents_only(spark, monkeypatch):
    monkeypatch.setattr(periodic, "PIECE_BYTES", 50)
    texts = [(i, "a b c d " * (i % 40)) for i in range(60)]
    pieces = list(periodic._pieces(texts, None))
    assert [w for p in pieces for w in p] == [t.encode().split() for _, t in texts]
    assert len(pieces) > 30
