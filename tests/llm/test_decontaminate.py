import hashlib
import random
import re

import pytest

from starloom.llm import decontaminate as dc

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORDS.findall((text or "").translate(FOLD))


def slow(docs, items, n=10):
    out = []
    for i, text in docs:
        w, hit, named, any_hit = words(text), set(), set(), False
        for item, t in items:
            b = words(t)
            for win in {tuple(b[k : k + n]) for k in range(max(1, len(b) - n + 1))} if b else ():
                for s in range(len(w) - len(win) + 1):
                    if tuple(w[s : s + len(win)]) == win:
                        hit |= set(range(s, s + len(win)))
                        any_hit = True
                        if item is not None:
                            named.add(str(item))
        out.append((i, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), any_hit))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [3, 100_000])
def test_small_alphabet(spark, block):
    rng = random.Random(block)
    pick = lambda n: " ".join(rng.choice(["a", "B", "é", "É", "the"]) for _ in range(n))
    items = [(i, pick(rng.choice([1, 2, 3, 5, 9, 10, 11, 14]))) for i in range(12)] + [(3, "the a"), (None, "a é"), (77, None), (78, " .,"), (10, "b b")]
    docs = [(i, pick(rng.choice([0, 1, 4, 12, 60]))) for i in range(60)] + [(1, None), (1, "the a"), (1, "the a"), (None, "x The-A y"), (None, items[0][1])]
    docs += [(100 + k, f"{pick(3)}, {t}! {pick(2)}") for k, (_, t) in enumerate(items) if t]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as id", "2 as n_hit", "'x' as ws")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, dc.contamination(d, b, block_windows=block).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)
    assert got == slow(docs, items)
    kept = dc.drop_contaminated(d, b, block_windows=block)
    assert kept.columns == d.columns
    bad = {(r[0], t) for (r, t) in ((slow([x], items)[0], x[1]) for x in docs) if r[5]}
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted((str(i), str(t)) for i, t in docs if (i, t) not in bad)


def test_table(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = sorted(map(tuple, dc.contamination(docs, items).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)
    grams = {}
    for r in items.collect():
        w = words(r.text)
        for k in range(max(1, len(w) - 9)):
            grams.setdefault(tuple(w[k : k + 10]), set()).add(str(r.item_id))
    want = []
    for r in docs.collect():
        w, hit, named = words(r.text), set(), set()
        for size in {len(g) for g in grams}:
            for s in range(len(w) - size + 1):
                if (found := grams.get(tuple(w[s : s + size]))) is not None:
                    hit |= set(range(s, s + size))
                    named |= found
        want.append((r.doc_id, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    assert got == sorted(want, key=str)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert [r.contaminated for r in dc.contamination(d, b.limit(0)).collect()] == [False] and dc.drop_contaminated(d, b.limit(0)).count() == 1
    assert dc.contamination(d.limit(0), b).count() == 0 and dc.drop_contaminated(d.limit(0), b).count() == 0
    assert [r.n_hit for r in dc.contamination(d, b).collect()] == [3]


def test_one_window_in_many_items_and_documents(spark):
    """Items are named once for a set of windows, not once a document."""
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(i, f"{text} {'x' * (i % 5)}") for i in range(3000)], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"{text} y{i}") for i in range(3000)], "item_id long, text string")
    out = dc.contamination(docs, items)
    named = hashlib.sha256(",".join(sorted(map(str, range(3000)))).encode()).hexdigest()
    assert {tuple(r) for r in out.select("n_hit", "n_items", "items_sha256", "contaminated").distinct().collect()} == {(10, 3000, named, True)}
    assert out.count() == 3000
    made = dc._named(spark.createDataFrame([(1, 0, [7, 8]), (2, 0, [7])], "s1 long, s2 long, wids array<long>"), spark.createDataFrame([(7, ["a", "b"]), (8, ["b", "c"])], "wid long, items array<string>"))
    assert sorted((r.s1, r.n_items) for r in made.collect()) == [(1, 3), (2, 2)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted(map(tuple, dc.contamination(docs, none).collect()), key=str) == [(1, 2, 0, 0, empty, False), (None, 0, 0, 0, empty, False)]
    assert dc.drop_contaminated(docs, none).count() == 2
    assert dc.contamination(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id")).count() == 0
