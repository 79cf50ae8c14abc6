"""Personal data: candidate spans scored by gradient-boosted trees.

Base patterns (email, ip, card, phone) are found exactly as the contract words them; their spans always stay. High-recall
generators propose further, overlapping candidates in the same kinds: written-out email addresses, digit groups in phone,
card and address notations. Boosted trees read format and context features of each candidate, and a threshold per kind,
calibrated for precision on examples that did not train the trees, selects the spans to add. The trees are grown here,
on a seeded set of ``n_train`` labelled examples written from templates: formats of personal data against dates, versions,
amounts, identifiers and failed checksums. So the model is a function of its parameters and never of the corpus.

Scanning is map-side over whole texts, linear in their length: every pattern starts at an anchor (an ``@``, a digit that
no digit precedes, a ``+``) and never rescans a run.

Edge cases: null and empty texts have no spans; positions are code points, end exclusive; candidates that touch a base
span or a better candidate of any kind are not added; of equally good ones the one that starts first is; repeated rows are scanned one by one; null ids are carried; an
empty table gives an empty result; very long texts are scanned whole; further columns, also ones named like the results,
are left out by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import map_arrow

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# no match can begin inside a digit run: it would begin at the run's first digit as well
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str | None) -> list[Span]:
    """The contract's spans by kind, then start."""
    found: list[Span] = []
    if not text:
        return found
    if "@" in text:
        end = 0
        at = text.find("@")
        while at >= 0:
            start = at
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at)):
                found.append(("email", start, m.end()))
                end = m.end()
            at = text.find("@", max(at + 1, end))
    if not DIGIT.search(text):
        return found
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = _digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                found.append(("phone", *m.span()))
    return found


# --- candidates -------------------------------------------------------------------------------------------------

WRITTEN_AT = re.compile(r"[\[({<]\x20?(?:at|AT|At)\x20?[\])}>]")
WRITTEN_EMAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?[\[({<]\x20?(?:at|AT|At)\x20?[\])}>]\x20?[A-Za-z0-9-]{1,63}(?:(?:\x20?[\[({<]\x20?(?:dot|DOT|Dot)\x20?[\])}>]\x20?|\.)[A-Za-z0-9-]{1,63}){1,5}")
DIGIT_GROUPS = re.compile(r"(?<![\w.+-])\(?[0-9]++(?:[\x20().\-/]{1,2}[0-9]++){1,9}(?!\w|:[0-9])")
LONG_DIGITS = re.compile(r"(?<![\w.+-])[0-9]{9,19}(?![\w])")
HEX_GROUPS = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![\w:])")


def candidates(text: str) -> list[Span]:
    """High-recall, overlapping proposals; every numeric one is proposed for each kind that its length allows."""
    found: list[Span] = []
    if WRITTEN_AT.search(text):
        found += [("email", *m.span()) for m in WRITTEN_EMAIL.finditer(text)]
    if not DIGIT.search(text):
        return found
    for pattern in (DIGIT_GROUPS, LONG_DIGITS):
        for m in pattern.finditer(text):
            n = len(_digits(m[0]))
            found += [(kind, *m.span()) for kind, low, high in (("ip", 4, 12), ("card", 13, 19), ("phone", 7, 15)) if low <= n <= high and (kind != "ip" or m[0].count(".") == 3)]
    if ":" in text:
        found += [("ip", *m.span()) for m in HEX_GROUPS.finditer(text)]
    return found


CONTEXT = {
    "email": ("mail", "contact", "write", "reach"),
    "ip": ("ip", "host", "server", "addr", "ping", "login"),
    "card": ("card", "visa", "credit", "debit", "pay", "master"),
    "phone": ("tel", "phone", "call", "mobile", "fax", "cell", "dial", "ring"),
}
AGAINST = ("version", "page", "date", "isbn", "order", "invoice", "total", "price", "section", "no.", "id", "on", "from", "$")
FEATURES = 25


def calendar(lengths: list[int], groups: list[str]) -> float:
    """Whether the first three groups read as a day of some calendar, year first or last."""
    if len(groups) < 3:
        return 0.0
    a, b, c = (int(g) if n <= 4 else 10_000 for g, n in zip(groups[:3], lengths[:3], strict=True))
    year_first = lengths[0] == 4 and 1000 <= a <= 2999 and 1 <= b <= 12 and 1 <= c <= 31 and lengths[2] <= 2
    year_last = lengths[2] in (2, 4) and lengths[0] <= 2 and lengths[1] <= 2 and 1 <= min(a, b) <= 12 and 1 <= max(a, b) <= 31 and (lengths[2] == 2 or 1000 <= c <= 2999)
    return float(year_first or year_last)


def features(text: str, span: Span) -> list[float]:
    """Format and context of one candidate."""
    kind, start, end = span
    body = text[start:end]
    before = text[max(0, start - 24) : start].lower()
    groups = re.findall(r"[0-9]+", body)
    digits = "".join(groups)
    lengths = [len(g) for g in groups] or [0]
    words = re.findall(r"[a-z$.]+", before)[-3:]
    near = lambda hints: float(any(w.startswith(h) for w in words for h in hints))
    year = float(any(len(g) == 4 and 1900 <= int(g) <= 2100 for g in groups))
    return [
        float(KINDS.index(kind)), float(len(body)), float(len(digits)), float(len(groups)), float(max(lengths)), float(min(lengths)), float(lengths[0]), float(lengths[-1]),
        float(body.count(".")), float(body.count("-")), float(body.count(" ")), float("(" in body), float(body.count(":")), float("/" in body),
        float(len(digits) >= 13 and luhn(digits)), float(max((int(g) for g in groups if len(g) < 5), default=0)), year, float(digits[:1] == "0"),
        near(CONTEXT[kind]), near(AGAINST), float(sum(c.isalpha() for c in body)), float("at" in body.lower() and "@" not in body),
        calendar(lengths, groups), float(text[end : end + 1] in ("%", "$", "€") or text[end : end + 1] == "," and text[end + 1 : end + 2].isdigit()), float(len(groups) > 2 and max(lengths) <= 3 and len(set(lengths[1:])) == 1),
    ]


# --- boosted trees ----------------------------------------------------------------------------------------------


class BoostedTrees:
    """Gradient boosting for logistic loss: depth-limited trees grown level by level on quantile-binned features."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, min_rows: int = 5, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.min_rows, self.ridge = rounds, depth, rate, bins, min_rows, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.cuts = [np.unique(np.quantile(col, np.linspace(0, 1, self.bins + 1)[1:-1])) for col in x.T]
        binned = self._bin(x)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.prior, self.trees = float(np.log(rate / (1 - rate))), []
        f = np.full(len(y), self.prior)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(binned, y - p, p * (1 - p))
            self.trees.append(tree)
            f += self._leaf_values(tree, binned)
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, col, side="left") for c, col in zip(self.cuts, x.T, strict=True)])

    def _grow(self, b: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> list[tuple[int, int, float]]:
        """A complete tree in heap order: (feature, bin, value); feature -1 marks a leaf."""
        size = 2 ** (self.depth + 1) - 1
        tree = [(-1, 0, 0.0)] * size
        rows = {0: np.arange(len(grad))}
        for node in range(size):
            own = rows.pop(node, None)
            if own is None:
                continue
            g, h = grad[own], hess[own]
            tree[node] = (-1, 0, self.rate * float(g.sum() / (h.sum() + self.ridge)))
            if 2 * node + 2 >= size or len(own) < 2 * self.min_rows:
                continue
            best = (1e-6, -1, 0)
            whole = g.sum() ** 2 / (h.sum() + self.ridge)
            for j in range(b.shape[1]):
                k = len(self.cuts[j]) + 1
                gl, hl, nl = (np.cumsum(np.bincount(b[own, j], w, k))[:-1] for w in (g, h, np.ones(len(own))))
                gain = gl**2 / (hl + self.ridge) + (g.sum() - gl) ** 2 / (h.sum() - hl + self.ridge) - whole
                gain[(nl < self.min_rows) | (len(own) - nl < self.min_rows)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), j, int(gain.argmax()))
            if best[1] >= 0:
                tree[node] = (best[1], best[2], tree[node][2])
                left = b[own, best[1]] <= best[2]
                rows[2 * node + 1], rows[2 * node + 2] = own[left], own[~left]
        return tree

    def _leaf_values(self, tree: list[tuple[int, int, float]], b: np.ndarray) -> np.ndarray:
        feature, cut, value = (np.array(c) for c in zip(*tree, strict=True))
        at = np.zeros(len(b), int)
        for _ in range(self.depth):
            inner = feature[at] >= 0
            right = b[np.arange(len(b)), np.maximum(feature[at], 0)] > cut[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return value[at]

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        return 1 / (1 + np.exp(-(self.prior + sum(self._leaf_values(t, b) for t in self.trees))))


# --- training examples ------------------------------------------------------------------------------------------


def examples(n: int, seed: int) -> list[tuple[str, Span, int]]:
    """Seeded labelled candidates (text, span, 1 if personal data) in made-up sentences."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ta", "re", "mon", "li", "ker", "os", "den", "vi", "shu", "pla"]) for _ in range(rng.randint(1, 4)))
    ds = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    sep = lambda: rng.choice([" ", "-", "."])

    def card(good: bool) -> str:
        body = rng.choice("3456") + ds(14)
        digits = next(body + c for c in "0123456789" if luhn(body + c) == good and (good or rng.random() < 0.9 or c == "9"))
        s = rng.choice([".", "/", "  ", " "])
        return s.join(digits[i : i + 4] for i in range(0, 16, 4))

    def email() -> str:
        a, d = rng.choice([("(at)", "(dot)"), ("[at]", "[dot]"), ("(at)", "."), ("{at}", "."), ("[AT]", "[DOT]")])
        g = rng.choice(["", " "])
        return f"{word()}{rng.choice(['', '.', '_'])}{word()}{g}{a}{g}{word()}{g if d != '.' else ''}{d}{g if d != '.' else ''}{rng.choice(['com', 'org', 'net', 'de', 'fr'])}"

    def phone() -> str:
        s = sep()
        return rng.choice([f"({ds(3)}) {ds(3)}-{ds(4)}", f"{ds(3)}{s}{ds(3)}{s}{ds(4)}", f"00{ds(2)} {ds(2)} {ds(4)} {ds(4)}", f"0{ds(2)} {ds(4)} {ds(4)}", f"0{ds(1)} {ds(2)} {ds(2)} {ds(2)} {ds(2)}", f"1-{ds(3)}-{ds(3)}-{ds(4)}", f"({rng.choice(['0', ''])}{ds(2)}) {ds(4)} {ds(4)}", f"00{ds(2)} {ds(3)} {ds(3)} {ds(3)}", f"{ds(2)} {ds(2)} {ds(4)} {ds(4)}", f"0{ds(3)} {ds(3)} {ds(3)}"])

    def day() -> str:
        y, m, d = f"{rng.choice(['19', '20'])}{ds(2)}", f"{rng.randint(1, 12):02d}", f"{rng.randint(1, 28):02d}"
        s = rng.choice("-/.")
        return rng.choice([s.join((y, m, d)), s.join((d, m, y)), s.join((m, d, y)), s.join((d, m, y[2:]))])

    hexes = lambda k: ":".join(f"{rng.getrandbits(16):x}" for _ in range(k))
    positive = {"email": email, "phone": phone, "card": lambda: card(True), "ip": lambda: rng.choice([hexes(8), f"2001:db8::{rng.getrandbits(16):x}", f"fe80::{hexes(3)}"])}
    negative = {
        "email": lambda: f"{word()} (at) {rng.choice(['1', '5', 'the'])}.{rng.choice(['x', '2', ds(2)])}",
        "phone": lambda: day() if rng.random() < 0.3 else rng.choice([f"20{ds(2)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", f"{rng.randint(1, 28):02d}.{rng.randint(1, 12):02d}.19{ds(2)}", f"{rng.randint(1, 28)}/{rng.randint(1, 12)}/20{ds(2)}", ds(rng.randint(9, 15)), f"978-{ds(1)}-{ds(4)}-{ds(4)}-{ds(1)}", f"1.{ds(2)}.{ds(4)}", f"{ds(5)}-{ds(4)}", f"{ds(1)} {ds(3)} {ds(3)}", f"19{ds(2)}-20{ds(2)}", f"{ds(2)}.{ds(3)}.{ds(3)}", f"{day()} {ds(2)}", f"{day()} {ds(2)}.{ds(2)}", f"{ds(1)} {ds(2)} {ds(2)} {ds(2)}", " ".join(ds(rng.randint(1, 2)) for _ in range(rng.randint(4, 8))), f"{ds(2)}.{ds(4)} {ds(2)}.{ds(4)}", f"{ds(3)} {ds(3)} {ds(3)}", f"{ds(1)}.{ds(3)}.{ds(3)}", f"20{ds(2)}/{ds(2)}/{ds(4)}"]),
        "card": lambda: rng.choice([card(False), ds(rng.randint(13, 19)), f"{ds(4)} {ds(3)} {ds(3)} {ds(3)}", f"978-{ds(1)}-{ds(4)}-{ds(4)}-{ds(1)}"]),
        "ip": lambda: rng.choice([f"{rng.randint(0, 23)}:{ds(2)}:{ds(2)}", f"{rng.randint(256, 999)}.{ds(2)}.{ds(1)}.{ds(3)}", f"{ds(1)}:{ds(2)}:{ds(2)}:{ds(2)}", f"{ds(2)}:{ds(1)}:{ds(1)}"]),
    }
    made = []
    while len(made) < n:
        kind, label = rng.choice(KINDS), rng.randint(0, 1)
        body = (positive if label else negative)[kind]()
        lead = [word() for _ in range(rng.randint(1, 5))]
        if label and rng.random() < 0.5:
            lead.append(rng.choice(CONTEXT[kind]) + rng.choice(["", ":"]))
        elif not label and rng.random() < 0.4:
            lead.append(rng.choice(AGAINST))
        text = " ".join(lead) + " " + body + rng.choice([".", ",", " ", ""]) + " " + word()
        start = text.index(body, len(" ".join(lead)))
        made.append((text, (kind, start, start + len(body)), label))
    return made


class Redactor:
    """Base spans and the added ones."""

    def __init__(self, n_train: int = 6000, seed: int = 5, precision: float = 0.99):
        rows = examples(n_train, seed)
        x, y = np.array([features(t, s) for t, s, _ in rows]), np.array([label for _, _, label in rows], float)
        kind = x[:, 0].astype(int)
        cut = len(rows) * 2 // 3
        self.trees = BoostedTrees().fit(x[:cut], y[:cut])
        p = self.trees.predict(x[cut:])
        self.thresholds = {k: self._threshold(p[kind[cut:] == i], y[cut:][kind[cut:] == i], precision) for i, k in enumerate(KINDS)}

    @staticmethod
    def _threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
        """The least threshold from 0.5 up that keeps the precision on examples that did not train the trees."""
        for t in np.linspace(0.5, 0.999, 200):
            if (chosen := p >= t).any() and y[chosen].mean() >= precision:
                return float(t)
        return 2.0

    def added(self, text: str, base: list[Span]) -> list[Span]:
        proposed = [c for c in candidates(text) if not any(s < c[2] and c[1] < e for _, s, e in base)] if len(base) < 64 else self._clear(candidates(text), base)
        if not proposed:
            return []
        p = self.trees.predict(np.array([features(text, c) for c in proposed]))
        chosen: list[Span] = []
        taken: list[tuple[int, int]] = []
        for score, c in sorted(zip(p.tolist(), proposed, strict=True), key=lambda x: (-x[0], x[1][1], x[1][0])):
            if score >= self.thresholds[c[0]] and not _touches(taken, c[1], c[2]):
                _insert(taken, c[1], c[2])
                chosen.append(c)
        return chosen

    @staticmethod
    def _clear(proposed: list[Span], base: list[Span]) -> list[Span]:
        blocked: list[tuple[int, int]] = []
        for _, s, e in sorted(base, key=lambda b: b[1]):  # overlapping base spans of several kinds become one
            if blocked and s < blocked[-1][1]:
                blocked[-1] = (blocked[-1][0], max(e, blocked[-1][1]))
            else:
                blocked.append((s, e))
        return [c for c in proposed if not _touches(blocked, c[1], c[2])]

    def spans(self, text: str | None) -> tuple[list[Span], list[Span]]:
        """(base, all), each by kind as listed, then start."""
        base = base_spans(text)
        more = self.added(text, base) if text else []
        return base, sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1]))

    def redact(self, text: str | None) -> str | None:
        """The text with every span, overlapping ones as one, replaced by its kind in brackets."""
        if not text:
            return text
        out, end = [], 0
        for kind, s, e in sorted(self.spans(text)[1], key=lambda x: (x[1], -x[2])):
            if s >= end:
                out += [text[end:s], f"[{kind.upper()}]"]
            end = max(end, e)
        return "".join(out) + text[end:] if out else text


def _touches(taken: list[tuple[int, int]], s: int, e: int) -> bool:
    i = bisect_left(taken, (s, e))
    return (i < len(taken) and taken[i][0] < e) or (i > 0 and taken[i - 1][1] > s)


def _insert(taken: list[tuple[int, int]], s: int, e: int) -> None:
    insort(taken, (s, e))


@lru_cache(maxsize=4)
def redactor(n_train: int = 6000, seed: int = 5, precision: float = 0.99) -> Redactor:
    return Redactor(n_train, seed, precision)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, **model) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of the base patterns), base_sha256, spans (all), n_added."""
    shared = docs.sparkSession.sparkContext.broadcast(redactor(**model))
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def make():
        model = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [model.spans(t) for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            digest = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string())
            return pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, pa.array([joined(every) for _, every in found], pa.string()), pa.array([len(every) - len(base) for base, every in found], pa.int64())], names=names)

        return step

    idtype = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {idtype}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return map_arrow(docs.select("doc_id", F.col("text").cast("string").alias("text")), make, schema)


def redact(docs: DataFrame, **model) -> DataFrame:
    """``docs`` with every personal span in ``text`` replaced; all columns and rows stay."""
    shared = docs.sparkSession.sparkContext.broadcast(redactor(**model))

    def make():
        model = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            i = batch.schema.get_field_index("text")
            return batch.set_column(i, "text", pa.array([model.redact(t) for t in batch.column(i).to_pylist()], batch.schema.field(i).type))

        return step

    return map_arrow(docs, make, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields))
