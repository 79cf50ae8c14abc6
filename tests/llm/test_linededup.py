import collections
import hashlib
import random

import numpy as np
import pytest

from starloom.llm import linededup
from starloom.llm.linededup import PerfectHash, Shard

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow(docs, min_chars=20, min_docs=3):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    at = lambda i: -(2**63) if i is None else i
    held = collections.defaultdict(list)
    for i, t in docs:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                held[k].append(at(i))
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(h := held.get(key(x), [])) < min_docs or max(h) <= at(i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 5000])
def test_the_perfect_hash_is_minimal(n):
    rng = np.random.default_rng(n)
    high, low = rng.integers(0, 2**63, n).astype(np.uint64), rng.integers(0, 2**63, n).astype(np.uint64)
    high[: n // 2] = 7  # halves may repeat, as long as the pairs differ
    h = PerfectHash.of(high, low)
    assert sorted(h.index(high, low).tolist()) == list(range(n))
    assert len(h.words) * 64 < 6 * n + 640
    shard = Shard.unpacked(*Shard.of(high, low, np.arange(n) + 1, np.arange(n) * 3).packed())
    counts, owners = shard.probe(high, low)
    assert counts.tolist() == list(range(1, n + 1)) and owners.tolist() == list(range(0, 3 * n, 3))
    other = rng.integers(0, 2**63, 1000).astype(np.uint64)
    assert not shard.probe(other, other + np.uint64(1))[0].any()


@pytest.fixture(scope="module")
def odd(spark, sf):
    rng = random.Random(3)
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    shared = ["A line that many documents share", " a LINE that many documents share\t", "nineteen characters", "twenty characters ok", "éééééééééé éééééééééé", "ÉÉÉÉÉÉÉÉÉÉ ÉÉÉÉÉÉÉÉÉÉ", "ééééé ééééé", "", " padded with a wide blank "]
    docs += [(rng.choice([None, *range(500, 530)]), "\n".join(rng.choices(shared, k=rng.randint(0, 6)))) for _ in range(80)]
    return docs + [(None, None), (7, None), (7, ""), (8, "\n\n"), (531, "A line that many documents share\r\nother\r"), (2**63 - 1, "twenty characters ok")]


@pytest.mark.parametrize("options", [{}, {"probe_keys": 40, "hot_keys": 20}, {"probe_keys": 0, "hot_keys": 0}, {"probe_keys": 0, "hot_keys": 0, "min_docs": 2, "min_chars": 5}])
def test_against_plain_counting(spark, odd, options):
    df = spark.createDataFrame(odd, "doc_id long, text string").selectExpr("*", "1 as gone", "'x' as t1", "2 as high", "3 as shard")
    got = linededup.summary(linededup.drop_lines(df, **options))
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    want = slow(odd, **{k: v for k, v in options.items() if k.startswith("min")})
    assert sum(r[2] for r in want) > 100
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_several_shards(spark, odd, monkeypatch):
    monkeypatch.setattr(linededup, "SHARD_KEYS", 7)
    df = spark.createDataFrame(odd, "doc_id long, text string")
    for options in ({}, {"probe_keys": 5, "hot_keys": 10}):
        assert sorted(map(tuple, linededup.summary(linededup.drop_lines(df, **options)).collect()), key=str) == slow(odd)


def test_empty_and_texts(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert linededup.drop_lines(none).count() == 0
    docs = [(1, "keep me\nthis line is in all of them"), (2, "this line is in all of them"), (3, "this line is in all of them\nx"), (4, None)]
    got = {r.doc_id: r.text for r in linededup.drop_lines(spark.createDataFrame(docs, "doc_id int, text string")).collect()}
    assert got == {1: "keep me", 2: "", 3: docs[2][1], 4: None}
    with pytest.raises(ValueError, match="two documents"):
        linededup.drop_lines(none, min_docs=1)
