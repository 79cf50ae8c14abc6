"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Every text is lower-cased and cut into character n-grams (one to three characters), which are hashed into ``2**bits``
columns. Weights are trained online with the follow-the-regularised-leader rule and an elastic-net penalty, which keeps
most of them at exactly zero, on a bounded sample: at most ``per_language`` labelled documents a language and
``max_rows`` in all, drawn by a seeded hash of the id. A fifth of the sample is kept apart and sets the temperature that
the logits are divided by. Prediction reads every whole text, map-side, in one pass.

Edge cases: a null text, or one without any letter, is ``und`` with score 0; a table without learnable labels makes
every prediction ``und``; repeated rows are predicted one by one; rows with a null id or language are predicted but
teach only if they have a language; an empty table gives an empty result; of equally likely languages the first in order is given; very long
texts are read whole. Other columns, whatever they are called, are never inputs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import fold_of, hashed_below, map_arrow, unused

BITS = 16
CHUNK = 1 << 18
WORDLIKE = re.compile(r"[^\W\d_]")
UNDETERMINED = "und"


def has_letter(text: str) -> bool:
    """Whether any character is a letter; number signs such as fractions and Roman numerals are none."""
    return any(m[0].isalpha() for m in WORDLIKE.finditer(text))


def ngram_ids(text: str, bits: int = BITS) -> np.ndarray:
    """Hashed ids of all 1- to 3-grams of the lower-cased text between two spaces, repeats included."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    one = (c + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    two = (one[:-1] ^ (one[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + one[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + one[2:]
    ids = np.concatenate([one, two * np.uint64(0xD6E8FEB86659FD93), three * np.uint64(0xD6E8FEB86659FD93)])
    return (ids >> np.uint64(64 - bits)).astype(np.int64)


def _pieces(text: str):
    """Long texts in blocks that bound the arrays; the blocks cover the whole text."""
    for lo in range(0, len(text), CHUNK):
        yield text[lo : lo + CHUNK]


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # languages x columns; idf and 1/temperature are folded in
    bias: np.ndarray
    bits: int = BITS

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0
        total, n = np.zeros(len(self.languages)), 0
        for piece in _pieces(text):
            ids = ngram_ids(piece, self.bits)
            total += [w[ids].sum(dtype=np.float64) for w in self.weights]
            n += len(ids)
        logits = total / n + self.bias
        p = np.exp(logits - logits.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_classes: int, dim: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 2e-3, l2: float = 1e-3, epochs: int = 4, seed: int = 7) -> np.ndarray:
    """Weights (classes x dim) after ``epochs`` seeded passes of FTRL-proximal over sparse rows (ids, values)."""
    z, n = np.zeros((n_classes, dim)), np.zeros((n_classes, dim))
    rng = np.random.default_rng(seed)

    def weights(z, n):
        return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)

    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, x = rows[i]
            zi, ni = z[:, ids], n[:, ids]
            w = weights(zi, ni)
            g = _softmax(w @ x)
            g[y[i]] -= 1.0
            g = g[:, None] * x[None, :]
            z[:, ids] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[:, ids] = ni + g * g
    return weights(z, n)


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """Temperature of least negative log-likelihood on rows that did not train the weights."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.02), np.log(20), 120))
    losses = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() + 1e-4 * abs(np.log(t)) for t in grid]
    return float(grid[int(np.argmin(losses))])


def train(docs: DataFrame, per_language: int = 600, max_rows: int = 20_000, bits: int = BITS, seed: int = 11) -> LanguageModel:
    """Fit on a bounded, seeded sample of the labelled rows outside the held-out fold."""
    labelled = docs.where((fold_of(F.col("doc_id")) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.zeros((0, 1 << bits), np.float32), np.zeros(0), bits)
    each = max(1, min(per_language, max_rows // len(languages)))
    share = F.element_at(F.create_map(*[F.lit(v) for lang in languages for v in (lang, min(1.0, each / counts[lang]))]), F.col("lang"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            langs, ids, ns = [], [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.zeros(1 << bits, np.uint32)
                for piece in _pieces(text):
                    got += np.bincount(ngram_ids(piece, bits), minlength=1 << bits).astype(np.uint32)
                at = np.flatnonzero(got)
                langs.append(lang), ids.append(at.astype("<u4").tobytes()), ns.append(got[at].astype("<u4").tobytes())
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(ids, pa.binary()), pa.array(ns, pa.binary())], names=["lang", "ids", "ns"])

        return step

    sample = labelled.where(hashed_below(F.col("doc_id"), share, seed)).select("lang", "text")
    got = sorted(tuple(r) for r in map_arrow(sample, make, "lang string, ids binary, ns binary").collect())
    y = np.array([languages.index(lang) for lang, _, _ in got], int)
    ids = [np.frombuffer(b, "<u4").astype(np.int64) for _, b, _ in got]
    tf = [(n := np.frombuffer(b, "<u4")) / max(1, n.sum()) for _, _, b in got]
    seen = np.zeros(1 << bits)
    for at in ids:
        seen[at] += 1
    idf = np.log((1 + len(ids)) / (1 + seen)) + 1
    rows = [(at, x * idf[at] * 10) for at, x in zip(ids, tf, strict=True)]
    order = np.random.default_rng(seed).permutation(len(rows))
    held, used = order[: len(order) // 5], order[len(order) // 5 :]
    w = fit_ftrl([rows[i] for i in used], y[used], len(languages), 1 << bits, seed=seed)
    logits = np.array([w[:, rows[i][0]] @ rows[i][1] for i in held]).reshape(-1, len(languages))
    scale = 10 / fit_temperature(logits, y[held])
    return LanguageModel(languages, (w * idf * scale).astype(np.float32), np.zeros(len(languages)), bits)


def predictions(docs: DataFrame, model: LanguageModel, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of ``docs`` with ``names`` for language and score; one pass over whole texts, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [model.predict(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*batch.schema.names, *names])

        return step

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [f"`{names[0]}` string", f"`{names[1]}` double"])
    return map_arrow(docs, make, schema)


def identify(docs: DataFrame, **training) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``, learned from its own labelled rows."""
    found = predictions(docs.select("doc_id", F.col("text").cast("string").alias("text")), train(docs, **training))
    return found.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = 0.5, **training) -> DataFrame:
    """``docs`` without the rows whose language stays undetermined or is told with a score under ``min_score``."""
    lang, score = unused(docs, "lang", "score")
    found = predictions(docs, train(docs, **training), (lang, score))
    return found.where((F.col(lang) != UNDETERMINED) & (F.col(score) >= min_score)).drop(lang, score)
