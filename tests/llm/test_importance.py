import collections
import hashlib
import math
import re
import zlib

import pytest

from starloom.llm import importance

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow(docs, items, ngram=1, buckets=10_000, percent=10):
    def features(text):
        w = WORDS.findall((text or "").translate(FOLD))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, ngram + 1) for i in range(len(w) - n + 1)]

    raw, want = collections.Counter(), collections.Counter()
    read = [(i, *features(t)) for i, t in docs]
    for _, _, f in read:
        raw.update(f)
    for _, t in items:
        want.update(features(t)[1])
    s_all, t_all = raw.total(), want.total()
    gain = [math.floor(1000 * math.log((want[b] + 1) * (s_all + buckets) / ((raw[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    rows = []
    for i, n, f in read:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    fit = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = collections.Counter()
    out = []
    for k, r in enumerate(fit):
        out.append((*r[:4], k + 1 if k < percent * len(fit) // 100 else None))
        ranks[id(r)] += 1
    return sorted(out + [(*r[:4], None) for r in rows if r[4] < 20], key=str)


def rows(df):
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def odd(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(None, None), (None, "x y " * 15), (7, ""), (7, ""), (900, "Ünï-ÇÖDE w0rd " * 40), (900, "Ünï-ÇÖDE w0rd " * 40), (901, "." * 500), (902, "q" * 300 + " b" * 30)]
    return docs


@pytest.mark.parametrize("options", [{}, {"hot_rows": 40}, {"hot_rows": 0}, {"ngram": 2, "buckets": 97}, {"percent": 60}])
def test_against_plain_counting(spark, sf, odd, options):
    # columns named like those that the operator makes itself
    docs = spark.createDataFrame(odd, "doc_id long, text string").selectExpr("*", "1 as row", "'x' as feature", "2 as place", "3 as score", "4 as _p")
    items = spark.read.parquet(f"{sf}/benchmark.parquet").selectExpr("*", "7 as bucket")
    asked = {k: v for k, v in options.items() if k != "hot_rows"}
    assert rows(importance.resample(docs, items, **options)) == slow(odd, [(None, r.text) for r in items.collect()], **asked)


def test_empty_tables(spark, odd):
    docs = spark.createDataFrame(odd[:30], "doc_id long, text string")
    none = docs.where("false")
    assert rows(importance.resample(docs, none)) == slow(odd[:30], [])
    assert rows(importance.resample(none, docs)) == []


def test_drawn_documents(spark, odd):
    docs = spark.createDataFrame(odd[:100], "doc_id long, text string").selectExpr("*", "'s' as source", "0 as rank")
    got = importance.draw(docs, docs.limit(3), percent=50)
    want = {r[0]: r[4] for r in slow(odd[:100], [(None, t) for _, t in odd[:3]], percent=50) if r[4]}
    assert {r["doc_id"]: r["rank"] for r in got.collect()} == want
    assert got.columns == ["doc_id", "text", "source", "rank", "score"]


def test_ties_go_to_repeated_rows_in_turn(spark):
    docs = [(5, "a b c d e f g h i j k l m n o p q r s t")] * 40
    got = rows(importance.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("a",)], "text string")))
    assert sorted(r[4] for r in got if r[4]) == [1, 2, 3, 4]
    assert len({r[:4] for r in got}) == 1
