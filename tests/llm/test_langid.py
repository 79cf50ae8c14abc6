import numpy as np

from starloom.llm import langid
from starloom.llm.common import fold_of_value


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = langid.identify(docs).collect()
    assert len(rows) == docs.count() and all(r.held_out == (fold_of_value(r.doc_id) == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.98


def test_held_out_rows_and_other_columns_never_teach(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    changed = docs.selectExpr("doc_id", "text", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 'xx', lang) as lang", "'s' as source")
    assert sorted(map(tuple, langid.identify(docs).collect())) == sorted(map(tuple, langid.identify(changed).collect()))


def test_chunks_cover_the_text():
    rng = np.random.default_rng(1)
    model = langid.LanguageModel(["a", "b"], rng.normal(size=(2, 1 << langid.BITS)).astype(np.float32), np.zeros(2))
    text = "".join(rng.choice(list("abcdeé ß"), langid.CHUNK + 1000))
    ids = np.concatenate([langid.ngram_ids(text[: langid.CHUNK]), langid.ngram_ids(text[langid.CHUNK :])])
    logits = np.array([w[ids].mean(dtype=np.float64) for w in model.weights])
    assert model.predict(text)[1] == np.float64(1 / (1 + np.exp(-abs(logits[0] - logits[1])))) or abs(model.predict(text)[1] - 1 / (1 + np.exp(-abs(logits[0] - logits[1])))) < 1e-6


def test_ftrl_is_sparse_and_separates():
    rng = np.random.default_rng(0)
    rows, y = [], rng.integers(0, 3, 300)
    for c in y:
        ids = np.unique(np.concatenate([[c], rng.integers(10, 200, 12)]))
        rows.append((ids, np.full(len(ids), 1 / len(ids))))
    w, sparse = langid.fit_ftrl(rows, y, 3, 256, l1=0.0), langid.fit_ftrl(rows, y, 3, 256, l1=0.5)
    assert (sparse[:, 10:200] == 0).mean() > 0.7 > (w[:, 10:200] == 0).mean()
    assert np.mean([np.argmax(w[:, i] @ x) == c for (i, x), c in zip(rows, y, strict=True)]) > 0.95


def test_number_signs_are_no_letters():
    model = langid.LanguageModel(["a", "b"], np.ones((2, 1 << langid.BITS), np.float32), np.zeros(2))
    for text in ("²", "½", "Ⅷ", "①", "½ ² 3", "\u0301", "_", "½" * 100_000):
        assert not langid.has_letter(text) and model.predict(text) == ("und", 0.0)
    for text in ("½a", "ª", "ß", "字", "x²"):
        assert langid.has_letter(text) and model.predict(text)[0] == "a"


def test_prediction_against_plain_counting(spark, sf):
    """The same score from a dictionary of n-grams, one at a time."""
    wrap, golden = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def column(gram):
        h = (ord(gram[0]) + 1) * golden & wrap
        if len(gram) == 1:
            return h >> (64 - langid.BITS)
        for c, (shift, factor) in zip(gram[1:], ((29, 0xBF58476D1CE4E5B9), (31, 0x94D049BB133111EB)), strict=False):
            h = ((h ^ h >> shift) * factor + (ord(c) + 1) * golden) & wrap
        return (h * 0xD6E8FEB86659FD93 & wrap) >> (64 - langid.BITS)

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs)
    for r in docs.limit(30).collect():
        if not r.text or len(r.text) > 3000 or not any(c.isalpha() for c in r.text):
            continue
        padded = f" {r.text.lower()} "
        grams = [padded[i : i + size] for size in (1, 2, 3) for i in range(len(padded) - size + 1)]
        total = sum(model.weights[:, column(g)].astype(float) for g in grams) / len(grams)
        p = np.exp(total - total.max())
        assert model.languages[int(p.argmax())] == model.predict(r.text)[0]
        assert abs(p.max() / p.sum() - model.predict(r.text)[1]) < 1e-6


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "en"), (4, "", "de"), (5, "12 !?", "en"), (None, "the the", None), (7, "the cat " * 40_000, "en"), (7, "the cat " * 40_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "2 as lang_pred")
    got = langid.identify(docs).collect()
    assert [r.lang_pred for r in got][2:5] == ["und"] * 3 and [r.score for r in got][2:5] == [0.0] * 3 and len(got) == len(rows)
    kept = langid.keep_identified(docs, min_score=0.0)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    assert langid.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}
