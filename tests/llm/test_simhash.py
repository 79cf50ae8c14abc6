import random

import pytest
from pyspark.sql import functions as F

from starloom.llm import simhash
from xxhash import xxh64_intdigest


def slow_simhash(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    sh = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hs = [xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows, bits=3):
    """rows: (id, fp) -> component id of each row by breadth-first search over all pairs."""
    fps = sorted({fp for _, fp in rows})
    root = {}
    for f in fps:
        if f in root:
            continue
        root[f], todo = f, [f]
        while todo:
            x = todo.pop()
            for y in fps:
                if y not in root and bin(x ^ y).count("1") <= bits:
                    root[y] = f
                    todo.append(y)
    low = {}
    for i, fp in rows:
        if i is not None:
            low[root[fp]] = min(low.get(root[fp], i), i)
    return [(i, f"{fp:016x}", low.get(root[fp])) for i, fp in rows]


def test_fingerprint_matches_definition():
    rng = random.Random(1)
    for text in [None, "", " \n", "One", "a B", "a b c", "É é x", "\xa0a b\x1cc d e"] + [" ".join(rng.choice("abcdef") for _ in range(n)) for n in (3, 10, 500)]:
        assert simhash.simhash64(text) == slow_simhash(text)


def test_table_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, slow_simhash(r.text)) for r in docs.collect()]
    got = simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id")
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows))


@pytest.mark.parametrize("bucket", [2, 7, 2048])
def test_links_are_exact_at_any_bucket_size(spark, bucket):
    rng = random.Random(bucket)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(60):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << b
            fps.add(x)
    rows = [(i, f) for i, f in enumerate(sorted(fps))]
    df = spark.createDataFrame([((f ^ 1 << 63) - (1 << 63),) for _, f in rows], "fp long")
    comp = {r.node & (1 << 64) - 1: r.root for r in simhash.components(simhash.links(df, bucket=bucket)).collect()}
    want = {}
    for i, fp, c in brute(rows):
        want.setdefault(c, set()).add(int(fp, 16))
    got = {}
    for f in fps:
        got.setdefault(comp.get(f, ("alone", f)), set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "same text here now"), (3, "same text here now"), (None, "same text here now"), (4, "x" * 100_000), (5, "word " * 50_000), (None, "only null"), (None, "only null")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("key", F.lit(1))
    got = simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute([(i, slow_simhash(t)) for i, t in rows])))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id or 0), r.text or "") for r in kept.collect()) == [(0, "only null"), (1, ""), (3, "same text here now"), (4, "x" * 100_000), (5, "word " * 50_000)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.keep_one(docs.limit(0)).count() == 0
