"""Toxicity by maximum-scoring segments of token log-odds.

Training draws a bounded, seeded sample of labelled documents (``max_toxic`` and ``max_clean`` of either label), counts
on the executors how many hold each token and each token prefix, and turns the counts into log-odds under a Dirichlet
prior whose pseudo-counts follow a token's share of the sample. Every candidate, however many there are, goes through an
exact binomial test; those that it finds lopsided (at most about ``false_tokens`` expected by chance) enter the lexicon.
A token scores as its longest entry says, so unseen forms of a known stem still count; log-odds that the test cannot
tell from none count as none, and every token pays a constant drift. A linear scan over those scores finds all
maximal-scoring segments of a text. Under Karlin-Altschul statistics a segment of score S in a text of n tokens is
reached by chance about K n exp(-lambda S) times: lambda solves the equation of the clean documents' hit rate, K is the
most likely value for the best segments of the sample's clean documents. The evidence of all significant segments is
added up and a logistic link, fitted on the sample weighted back to all labels, turns it into a probability.

Edge cases: null, empty or wordless texts get the score of no evidence; several labels of one document are averaged;
repeated rows are scored one by one; without labels of both kinds every score is the smoothed rate of toxic labels; an empty
table gives an empty result; very long texts are scanned whole, in time linear in their length; further columns of either
table, whatever they are called, are ignored. Labels, language, source and id are never inputs of a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import fold_of, hashed_below, map_arrow, reliable

TOKEN = re.compile(r"[^\W_]+")
PREFIXES = range(3, 10)
CACHE = 300_000


def maximal_segments(scores: list[float], spans: list[tuple[int, int]]) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments of a score sequence, in linear time: (score, first, last) by the spans' ends."""
    found: list[list[float]] = []  # left total, right total, first item, last item
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        seg = [before, total, i, i]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= seg[0]:
                j -= 1
            if j < 0 or found[j][1] >= seg[1]:
                found.append(seg)
                break
            seg = [found[j][0], seg[1], found[j][2], seg[3]]
            del found[j:]
    return [(r - l, spans[int(a)][0], spans[int(b)][1]) for l, r, a, b in found]


class _Scores(dict):
    """Score of a token by its longest lexicon entry, remembered up to a bound."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        super().__init__()
        self.words, self.stems = words, stems
        self.lengths = sorted({len(x) for x in stems}, reverse=True)

    def __missing__(self, token: str) -> float:
        found = self.words.get(token)
        if found is None:
            found = next((self.stems[token[:n]] for n in self.lengths if token[:n] in self.stems), 0.0)
        if len(self) >= CACHE:
            self.clear()
        if len(token) < 64:
            self[token] = found
        return found


@dataclass
class ToxicityModel:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    drift: float = 0.05
    decay: float = 1.0  # lambda
    log_k: float = math.log(0.1)
    slope: float = 1.0
    offset: float = -2.0

    def __post_init__(self):
        self.known = _Scores(self.words, self.stems)

    def _scan(self, text: str | None) -> tuple[list[tuple[float, int, int]], int]:
        """All maximal-scoring segments as (score, first token, last token), and the number of tokens."""
        tokens = TOKEN.findall(text.lower()) if text else []
        scores: list[float] = []
        spans: list[tuple[int, int]] = []
        at = 0
        for i, s in enumerate(map(self.known.__getitem__, tokens)):
            if s:
                if i > at:
                    scores.append(-self.drift * (i - at)), spans.append((at, i - 1))
                scores.append(s - self.drift), spans.append((i, i))
                at = i + 1
        return maximal_segments(scores, spans), len(tokens)

    def best(self, text: str | None) -> tuple[float, int]:
        """Score of the best segment, 0 without one, and the number of tokens."""
        found, n = self._scan(text)
        return max((s for s, _, _ in found), default=0.0), n

    def segments(self, text: str | None) -> tuple[list[tuple[float, int, int]], int]:
        """Significant toxic passages as (evidence, first token, last token), and the number of tokens."""
        found, n = self._scan(text)
        base = self.log_k + math.log(max(1, n))
        scored = ((self.decay * s - base, a, b) for s, a, b in found)
        return [x for x in scored if x[0] > 0], n

    def evidence(self, text: str | None) -> float:
        return math.log1p(sum(s for s, _, _ in self.segments(text)[0]))

    def score(self, text: str | None) -> float:
        return 1.0 / (1.0 + math.exp(-min(50.0, max(-50.0, self.slope * self.evidence(text) + self.offset))))


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, strength: float = 1.0) -> np.ndarray:
    """Difference of a token's log-odds of standing in toxic and in clean documents, with Dirichlet pseudo-counts."""
    share = (toxic + clean) / (n_toxic + n_clean)
    prior = strength * (0.25 + share)
    return np.log((toxic + prior) / (n_toxic - toxic + strength)) - np.log((clean + prior) / (n_clean - clean + strength))


def log_tail(toxic: int, clean: int, rate: float) -> float:
    """Log of the chance that at least ``toxic`` of toxic + clean documents are toxic at the sample's rate."""
    n = toxic + clean
    terms = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(rate) + (n - k) * math.log1p(-rate) for k in range(toxic, n + 1)]
    top = max(terms)
    return top + math.log(sum(math.exp(t - top) for t in terms))


def _count_tokens(sample: DataFrame, min_docs: int) -> tuple[DataFrame, int]:
    """(token, stem?, toxic documents' count, clean ones') of all candidates, and the length of all clean documents in tokens."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts: dict[tuple[str | None, bool, bool], int] = Counter()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = TOKEN.findall((text or "").lower())
                counts[None, False, toxic] += len(tokens)  # the row of no token holds the lengths
                own = set(tokens)
                counts.update((t, False, toxic) for t in own)
                counts.update((t, True, toxic) for t in {t[:n] for t in own for n in PREFIXES if n <= len(t)})
            keys = list(counts)
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([counts[k] * k[2] for k in keys], pa.int64()), pa.array([counts[k] * (not k[2]) for k in keys], pa.int64())],
                names=["token", "stem", "toxic", "clean"],
            )

        return step

    counted = map_arrow(sample.select("text", "toxic"), make, "token string, stem boolean, toxic long, clean long").groupBy("token", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    kept = reliable(counted.where(F.col("token").isNull() | (F.col("toxic") >= min_docs)))
    return kept.where(F.col("token").isNotNull()), kept.where(F.col("token").isNull()).first()["clean"]


def _lexicon(candidates: DataFrame, n_toxic: int, n_clean: int, least: float, false_tokens: float) -> list:
    """(token, stem?, clean documents' count, log-odds) of the candidates that the test finds lopsided; the test runs on the executors."""
    rate, limit = n_toxic / (n_toxic + n_clean), math.log(false_tokens / max(1, candidates.count()))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            toxic, clean = (batch.column(i).to_numpy().astype(float) for i in (2, 3))
            delta = log_odds(toxic, clean, n_toxic, n_clean)
            good = [i for i in np.flatnonzero(delta >= least).tolist() if log_tail(int(toxic[i]), int(clean[i]), rate) <= limit]
            at = pa.array(good, pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), batch.column(3).take(at), pa.array(delta[good], pa.float64())], names=["token", "stem", "clean", "delta"])

        return step

    return sorted(map_arrow(candidates.select("token", "stem", "toxic", "clean"), make, "token string, stem boolean, clean long, delta double").collect())


def _decay(p_hit: float, mean_score: float, drift: float) -> float:
    """The positive root of E[exp(lambda * score)] = 1 under the clean background."""
    low, high = 1e-6, 50.0 / max(mean_score, 1e-6)
    value = lambda x: p_hit * math.exp(min(700, x * (mean_score - drift))) + (1 - p_hit) * math.exp(-x * drift) - 1
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return (low + high) / 2


def _log_k(clean: DataFrame, model: ToxicityModel) -> float:
    """Log of the likeliest K when the best segment of n tokens is at most S with probability exp(-K n exp(-lambda S)).

    Texts without a segment are censored at 0: they add to the expected number of segments and not to the found ones.
    """

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            best = [model.best(t) for t in batch.column(0).to_pylist()]
            expected = [n * math.exp(-model.decay * s) for s, n in best]
            return pa.RecordBatch.from_arrays([pa.array([float(sum(s > 0 for s, _ in best))]), pa.array([float(sum(expected))])], names=["found", "expected"])

        return step

    found, expected = map_arrow(clean.select("text"), make, "found double, expected double").agg(F.sum("found"), F.sum("expected")).first()
    return math.log(((found or 0.0) + 0.5) / ((expected or 0.0) + 1.0))


def _fit_link(x: np.ndarray, y: np.ndarray, penalty: float = 0.5, weights: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and offset of a ridge-penalised, weighted logistic fit, by Newton's method."""
    w = np.zeros(2)
    each = np.ones(len(x)) if weights is None else weights
    features = np.column_stack([x, np.ones(len(x))])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        grad = features.T @ (each * (p - y)) + penalty * np.array([w[0], 0.0])
        hess = (features * (each * p * (1 - p))[:, None]).T @ features + np.diag([penalty, 1e-6])
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = 3000, max_clean: int = 15_000, min_docs: int = 3, false_tokens: float = 1.0, least: float = 2.5, drift: float = 0.05, seed: int = 23) -> ToxicityModel:
    """Learn from at most about ``max_toxic`` and ``max_clean`` labelled documents outside the held-out fold."""
    known = labels.where((fold_of(F.col("doc_id")) != 0) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg((F.avg("toxic") >= 0.5).alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    shares = {v: min(1.0, most / max(1, counts.get(v, 0))) for v, most in ((True, max_toxic), (False, max_clean))}
    share = F.when(F.col("toxic"), F.lit(shares[True])).otherwise(F.lit(shares[False]))
    chosen = known.where(hashed_below(F.col("doc_id"), share, seed)).withColumnRenamed("doc_id", "_id")
    # the chosen ids are about max_toxic + max_clean at most, so they may be broadcast
    sample = reliable(docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("text", "toxic"))
    n_toxic, n_clean = (sample.where(F.col("toxic") == v).count() for v in (True, False))
    if not n_toxic or not n_clean:
        return ToxicityModel(slope=0.0, offset=math.log((n_toxic + 0.5) / (n_clean + 0.5)))
    candidates, clean_tokens = _count_tokens(sample, min_docs)
    rows = _lexicon(candidates, n_toxic, n_clean, least, false_tokens)
    words = {r["token"]: r["delta"] for r in rows if not r["stem"]}
    stems = {r["token"]: r["delta"] for r in rows if r["stem"]}
    clean_hits = float(sum(r["clean"] for r in rows if not r["stem"]))
    mean = float(np.mean([*words.values(), *stems.values()] or [1.0]))
    model = ToxicityModel(words, stems, drift)
    hit = (clean_hits + 0.5) / max(1, clean_tokens)
    model.decay = _decay(min(hit, 0.5 * drift / (mean + drift)), mean, drift)

    model.log_k = _log_k(sample.where(~F.col("toxic")), model)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([model.evidence(t) for t in batch.column(0).to_pylist()]), batch.column(1)], names=["x", "toxic"])

        return step

    seen = map_arrow(sample, make, "x double, toxic boolean").collect()
    # each sampled row stands for as many labelled ones as its label's share says
    model.slope, model.offset = _fit_link(np.array([r["x"] for r in seen]), np.array([r["toxic"] for r in seen], float), weights=np.array([1.0 / shares[r["toxic"]] for r in seen]))
    return model


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted: one pass over whole texts, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            scores = pa.array([model.score(t) for t in texts], pa.float64())
            return pa.RecordBatch.from_arrays([batch.column(0), scores], names=["doc_id", "score"])

        return step

    idtype = docs.schema["doc_id"].dataType.simpleString()
    found = map_arrow(docs.select("doc_id", F.col("text").cast("string").alias("text")), make, f"doc_id {idtype}, score double")
    return found.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def detect(docs: DataFrame, labels: DataFrame, **training) -> DataFrame:
    return score(docs, train(docs, labels, **training))
