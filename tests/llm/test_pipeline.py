import re
from collections import defaultdict

import pytest

import corpus_pipeline as cp
from starloom.llm import langid, pii
from tests.llm.test_mixing import slow_targets
from tests.llm.test_simhash import brute, slow_simhash

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def windows(text, n=10):
    w = WORDS.findall((text or "").translate(FOLD))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """(name, input rows, output rows) of every stage, each written and read again."""
    root, docs, out = tmp_path_factory.mktemp("pipe"), spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in cp.STAGES:
        got = stage(spark, docs, sf)
        assert name == "mixing" or got.columns == docs.columns
        got.write.parquet(f"{root}/{name}")
        after = spark.read.parquet(f"{root}/{name}")
        out.append((name, docs.collect(), after.collect()))
        docs = after
    return {name: (before, after) for name, before, after in out}


def test_language_stage(spark, sf, stages):
    before, after = stages["language_id"]
    model = langid.train(spark.read.parquet(f"{sf}/documents.parquet"))
    want = {r.doc_id for r in before if (p := model.predict(r.text))[0] != "und" and p[1] >= 0.5}
    assert {r.doc_id for r in after} == want and len(after) >= 0.99 * len(before)


def test_dedup_stage(stages):
    before, after = stages["near_dedup"]
    rows = brute([(r.doc_id, slow_simhash(r.text)) for r in before])
    assert sorted(r.doc_id for r in after) == sorted({c for _, _, c in rows})


def test_decontamination_stage(spark, sf, stages):
    before, after = stages["decontamination"]
    items = set().union(*(windows(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()))
    assert all(len(w) == 10 for w in items)
    assert {r.doc_id for r in after} == {r.doc_id for r in before if not windows(r.text) & items} and len(after) < len(before)


def test_pii_stage(stages):
    before, after = stages["pii"]
    model = pii.redactor()
    text = {r.doc_id: r for r in after}
    assert len(after) == len(before)
    for r in before:
        assert text[r.doc_id].text == model.redact(r.text) and text[r.doc_id].n_chars == len(text[r.doc_id].text)
    assert any(text[r.doc_id].text != r.text for r in before)


def test_mixing_stage(stages):
    before, after = stages["mixing"]
    size = {r.doc_id: len(r.text.split()) for r in before}
    by_source = defaultdict(int)
    for r in before:
        by_source[r.source] += size[r.doc_id]
    goal = slow_targets(dict(by_source))
    words, docs, text = defaultdict(int), defaultdict(int), {r.doc_id: r.text for r in before}
    for r in after:
        n = len(r.text.split())
        assert n == r.words and (n < r.size or r.text == text[r.doc_id])
        words[r.source] += n
        docs[r.doc_id] += n
    assert all(abs(words[s] - goal[s]) <= 0.5 for s in goal)
    assert sum(r.text != text[r.doc_id] for r in after) <= len(goal)
    assert all(docs[d] <= 3 * size[d] for d in docs)


def test_run(spark, sf, stages):
    got = cp.run(spark, sf)
    assert sorted((r.doc_id, r.repetition, r.text) for r in got.collect()) == sorted((r.doc_id, r.repetition, r.text) for r in stages["mixing"][1])


def test_odd_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size int, __score string, __u int"
    prose = "the quick brown fox jumps over the lazy dog again and again until it sleeps"
    rows = [(1, prose, "en", "a", 75, 9, "x", 1), (1, prose, "en", "a", 75, 9, "x", 1), (2, None, None, None, None, 9, "x", 1), (3, "", "en", None, 0, 9, "x", 1), (None, prose + " call a@b.c", None, None, None, 9, "x", 1), (4, "12 34", "en", "b", 5, 9, "x", 1)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(None, None), (1, ""), (2, "never seen here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = cp.run(spark, str(tmp_path))
    assert {"doc_id", "__score", "__u", "taken", "repetition"} <= set(got.columns)
    found = [r.text for r in got.collect()]
    assert found and all(set((t or "").split()) <= set(f"{prose} call [EMAIL]".split()) for t in found), found
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
