"""Main-text extraction by a recurrent block labeller.

A page is cut into leaf blocks, the text between two block-level tags, each with its path of open block elements. A block is
read as hashed tag-path tokens (tags, classes, ids and roles of its ancestors), hashed words and a few counts; a
bidirectional LSTM in numpy runs over all blocks of the page in order, so that every block is labelled with the whole
document as its context. Blocks labelled as main text are joined in page order.

The network is trained here, on seeded made-up pages: articles in many kinds of containers among menus, headers,
footers, sidebars, notices, adverts, forms, share bars and reader comments, nested inside and around each other, with
broken markup. It is a function of its parameters and never of the table, and is trained once per process.

Edge cases: null and empty pages give an empty text; scripts, styles, titles and HTML comments are no blocks; an unclosed
script, style or comment takes the rest of the page, any other element whose content is left out only its own tag;
unclosed and stray tags are tolerated; very long pages are read whole and in linear time, well formed or not; path
features take the eight outermost and eight innermost elements; a block scored exactly 0.5 is main text; repeated rows
are read one by one; null ids and URLs are carried; further columns, also ones named like the results, are left out; an
empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import map_arrow

# fixed values: element kinds of the HTML standard
# elements whose content is no text of the page, and those of them that swallow the rest of the page when unclosed
RAW = frozenset("script style noscript template textarea title iframe svg select".split())
SWALLOWS = frozenset(("script", "style"))
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_LIKE = frozenset("li dt dd td th tr option p".split())

# a tag whose attributes hold no angle brackets, which is nearly every one; ``_Reader.tag_end`` finds the end of the others
TAG = re.compile(r"<(/?)([a-z][a-z0-9:-]*+)((?:[^<>\"']++|\"[^<>\"]*+\"|'[^<>']*+')*+)>", re.I)
OPENING = re.compile(r"<(/?)([a-z][a-z0-9:-]*+)", re.I)
PLAIN = re.compile(r"[^>\"']*+")
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"\w+")
PATH_BINS, WORD_BINS, COUNTS = 8192, 256, 8


@dataclass
class Block:
    text: str
    path: list[str]
    linked: int


class _Reader:
    """Tags, texts and skipped parts of a page in order, in time linear in its length however broken the markup is."""

    def __init__(self, page: str):
        self.page, self.size = page, len(page)
        self.no_end = False  # no ``>`` follows
        self.dead: set[int] = set()  # quotes from which no end of a tag is reached
        self.unclosed: set[str] = set()  # raw elements without a further closing tag

    def tag_end(self, at: int, attributes: int) -> int | None:
        """Where the tag that begins at ``at`` ends: the first ``>`` outside quotes, else the first one at all."""
        if self.no_end:
            return None
        page, pos, opened = self.page, attributes, []
        while (pos := PLAIN.match(page, pos).end()) < self.size and page[pos] != ">" and pos not in self.dead:
            opened.append(pos)
            close = page.find(page[pos], pos + 1)
            pos = (pos if close < 0 else close) + 1
        if pos < self.size and page[pos] == ">":
            return pos
        self.dead.update(opened)
        return self.next_end(at)

    def next_end(self, at: int) -> int | None:
        end = -1 if self.no_end else self.page.find(">", at)
        self.no_end = end < 0
        return None if self.no_end else end

    def raw_end(self, tag: str, at: int) -> int:
        """Where the content of a raw element ends, its closing tag included."""
        if tag not in self.unclosed:
            if m := re.compile(rf"</{tag}(?![a-z0-9:-])[^>]*+>?", re.I).search(self.page, at):
                return m.end()
            self.unclosed.add(tag)
        return self.size if tag in SWALLOWS else at

    def pieces(self):
        """(text,) of a run of text; (closing?, tag, attributes) of a tag; () of a part that is left out."""
        page, pos = self.page, 0
        while pos < self.size:
            at = page.find("<", pos)
            if at != pos:
                yield (page[pos : at if at >= 0 else self.size],)
            if at < 0:
                return
            if page.startswith("<!--", at):
                end = page.find("-->", at + 2)
                pos = end + 3 if end >= 0 else self.size
                continue
            if m := TAG.match(page, at):
                end = m.end() - 1
            elif m := OPENING.match(page, at):
                end = self.tag_end(at, m.end())
            elif page[at + 1 : at + 2] in ("!", "?"):
                end = self.next_end(at)
            else:
                end = None
            if end is None:
                yield ("<",)
                pos = at + 1
                continue
            pos = end + 1
            if m is None:
                continue
            closing, tag, attributes = bool(m[1]), m[2].lower(), page[m.end(2) : end]
            if tag in RAW:
                if not closing and not attributes.endswith("/"):
                    pos = self.raw_end(tag, pos)
                yield ()
            else:
                yield closing, tag, attributes


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks with text in page order.

    A block element ends all inline ones that are open, so inline ones are open only since the last block began or
    ended; as they have no part in paths, their numbers are all that is kept, and closing one looks at nothing else.
    """
    found: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    open_blocks: Counter[str] = Counter()
    open_inline: dict[str, int] = {}
    pieces: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                ends = stack if len(stack) <= 16 else stack[:8] + stack[-8:]
                found.append(Block(text, [t for _, names in ends for t in names], linked))
            pieces.clear()
        linked = 0

    def pop() -> str:
        tag = stack.pop()[0]
        open_blocks[tag] -= 1
        return tag

    for piece in _Reader(page or "").pieces():
        if len(piece) == 1:
            pieces.append(piece[0])
            if open_inline.get("a"):
                linked += len(piece[0])
            continue
        if not piece:
            pieces.append(" ")
            continue
        closing, tag, attributes = piece
        if tag not in BLOCK:
            if closing:
                if open_inline.get(tag):
                    open_inline[tag] -= 1
            elif tag not in VOID and not attributes.endswith("/"):
                open_inline[tag] = open_inline.get(tag, 0) + 1
            elif tag == "br":
                pieces.append(" ")
            continue
        flush()
        if closing:
            if open_blocks[tag]:
                open_inline.clear()
                while pop() != tag:
                    pass
            continue
        open_inline.clear()
        while stack and stack[-1][0] == "p":
            pop()
        if tag in CLOSES_LIKE and stack and stack[-1][0] == tag:
            pop()
        if tag in VOID:
            continue
        names: tuple[str, ...] = (f"<{tag}>",)
        if attributes.strip():
            names += tuple(w for a in NAMES.findall(attributes) for w in re.split(r"[^a-z0-9]+", "".join(a).lower()) if w)
        stack.append((tag, names))
        open_blocks[tag] += 1
    flush()
    return found


class _Bin(dict):
    def __init__(self, bins: int):
        super().__init__()
        self.bins = bins

    def __missing__(self, token: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[token] = n = zlib.crc32(token.encode("utf-8", "replace")) % self.bins
        return n


_path_bin, _word_bin = _Bin(PATH_BINS), _Bin(WORD_BINS)


@dataclass
class Sequence:
    """Features of one page: flat ids with the offsets of each block, and counts."""

    path: np.ndarray
    path_at: np.ndarray
    words: np.ndarray
    words_at: np.ndarray
    counts: np.ndarray


def sequence(page: list[Block]) -> Sequence:
    path, path_at, words, words_at, counts = [], [], [], [], []
    n = len(page)
    for i, b in enumerate(page):
        path_at.append(len(path))
        path += [_path_bin[t] for t in b.path or ("<none>",)]
        words_at.append(len(words))
        own = WORD.findall(b.text.lower()) or [""]
        words += [_word_bin[w] for w in own]
        size = len(b.text)
        counts.append((min(1.0, np.log1p(size) / 8), min(1.0, len(own) / 40), min(1.0, b.linked / size), b.text[-1] in ".!?", i / n, b.text[:1].isupper(), "\xa9" in b.text, 1.0))
    return Sequence(np.array(path, np.int64), np.array(path_at, np.int64), np.array(words, np.int64), np.array(words_at, np.int64), np.array(counts, np.float64).reshape(n, COUNTS))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Labeller:
    """Embedding bags, one LSTM in each direction, a logistic output; Adam on padded batches."""

    def __init__(self, hidden: int = 16, path_dim: int = 16, word_dim: int = 6, seed: int = 3):
        rng = np.random.default_rng(seed)
        d = path_dim + word_dim + COUNTS
        self.hidden = hidden
        self.p = {"path": rng.normal(0, 0.3, (PATH_BINS, path_dim)), "word": rng.normal(0, 0.05, (WORD_BINS, word_dim)), "out": rng.normal(0, 0.2, (2 * hidden + d, 1)), "bias": np.zeros(1)}
        for way in ("f", "b"):
            self.p["x" + way] = rng.normal(0, d**-0.5, (d, 4 * hidden))
            self.p["h" + way] = rng.normal(0, hidden**-0.5, (hidden, 4 * hidden))
            self.p["c" + way] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])

    def _embed(self, s: Sequence) -> np.ndarray:
        path = np.add.reduceat(self.p["path"][s.path], s.path_at)
        size = np.diff(np.append(s.words_at, len(s.words)))[:, None]
        return np.hstack([path, np.add.reduceat(self.p["word"][s.words], s.words_at) / size, s.counts])

    def _batch(self, pages: list[Sequence]) -> tuple[np.ndarray, np.ndarray]:
        xs = [self._embed(s) for s in pages]
        n = np.array([len(x) for x in xs])
        x = np.zeros((len(xs), n.max(), xs[0].shape[1]))
        for i, own in enumerate(xs):
            x[i, : len(own)] = own
        return x, n

    @staticmethod
    def _flip(x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Each page's own steps in reverse, padding left at the end."""
        at = np.arange(x.shape[1])[None, :]
        at = np.where(at < n[:, None], n[:, None] - 1 - at, at)
        return np.take_along_axis(x, at[:, :, None], axis=1)

    def _run(self, x: np.ndarray, way: str, keep: bool):
        k, (size, steps, _) = self.hidden, x.shape
        pre = x @ self.p["x" + way] + self.p["c" + way]
        h = c = np.zeros((size, k))
        out, saved = np.empty((size, steps, k)), []
        for t in range(steps):
            z = pre[:, t] + h @ self.p["h" + way]
            gates, g = _sigmoid(z[:, : 3 * k]), np.tanh(z[:, 3 * k :])
            last = (h, c)
            c = gates[:, k : 2 * k] * c + gates[:, :k] * g
            tc = np.tanh(c)
            h = gates[:, 2 * k :] * tc
            out[:, t] = h
            if keep:
                saved.append((gates, g, tc, *last))
        return out, saved

    def _back(self, x: np.ndarray, way: str, saved: list, dout: np.ndarray, grads: dict[str, np.ndarray]) -> np.ndarray:
        k = self.hidden
        dz = np.empty((*x.shape[:2], 4 * k))
        dh = dc = np.zeros((len(x), k))
        for t in range(x.shape[1] - 1, -1, -1):
            gates, g, tc, h0, c0 = saved[t]
            i, f, o = gates[:, :k], gates[:, k : 2 * k], gates[:, 2 * k :]
            dh = dh + dout[:, t]
            dc = dc + dh * o * (1 - tc * tc)
            dz[:, t, :k], dz[:, t, k : 2 * k], dz[:, t, 2 * k : 3 * k], dz[:, t, 3 * k :] = dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)
            grads["h" + way] += h0.T @ dz[:, t]
            dh, dc = dz[:, t] @ self.p["h" + way].T, dc * f
        flat = dz.reshape(-1, 4 * k)
        grads["x" + way] += x.reshape(-1, x.shape[2]).T @ flat
        grads["c" + way] += flat.sum(axis=0)
        return dz @ self.p["x" + way].T

    def scores(self, pages: list[Sequence]) -> list[np.ndarray]:
        """Probability of main text for every block of every page, pages of like length batched together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i, s in enumerate(pages) if len(s.counts)), key=lambda i: len(pages[i].counts))
        while order:
            size = max(1, min(len(order), 8192 // len(pages[order[-1]].counts)))
            own, order = order[-size:], order[:-size]
            x, n = self._batch([pages[i] for i in own])
            f, _ = self._run(x, "f", False)
            b, _ = self._run(self._flip(x, n), "b", False)
            y = _sigmoid(np.concatenate([f, self._flip(b, n), x], axis=2) @ self.p["out"] + self.p["bias"])[:, :, 0]
            for j, i in enumerate(own):
                out[i] = y[j, : n[j]]
        return out

    def _step(self, pages: list[Sequence], labels: list[np.ndarray]) -> dict[str, np.ndarray]:
        x, n = self._batch(pages)
        back = self._flip(x, n)
        f, saved_f = self._run(x, "f", True)
        b, saved_b = self._run(back, "b", True)
        joined = np.concatenate([f, self._flip(b, n), x], axis=2)
        y = _sigmoid(joined @ self.p["out"] + self.p["bias"])[:, :, 0]
        want = np.zeros(y.shape)
        for i, own in enumerate(labels):
            want[i, : len(own)] = own
        mask = np.arange(x.shape[1])[None, :] < n[:, None]
        dy = ((y - want) * mask / mask.sum())[:, :, None]
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        grads["out"] += joined.reshape(-1, joined.shape[2]).T @ dy.reshape(-1, 1)
        grads["bias"] += dy.sum()
        d, k = dy @ self.p["out"].T, self.hidden
        dx = d[:, :, 2 * k :] + self._back(x, "f", saved_f, d[:, :, :k], grads) + self._flip(self._back(back, "b", saved_b, self._flip(d[:, :, k : 2 * k], n), grads), n)
        wide = self.p["path"].shape[1]
        for i, s in enumerate(pages):
            own = dx[i, : n[i]]
            np.add.at(grads["path"], s.path, np.repeat(own[:, :wide], np.diff(np.append(s.path_at, len(s.path))), axis=0))
            size = np.diff(np.append(s.words_at, len(s.words)))
            np.add.at(grads["word"], s.words, np.repeat(own[:, wide : wide + self.p["word"].shape[1]] / size[:, None], size, axis=0))
        return grads

    def fit(self, pages: list[Sequence], labels: list[np.ndarray], epochs: int, batch: int = 24, rate: float = 0.01, seed: int = 3) -> Labeller:
        rng = np.random.default_rng(seed)
        m, v, t = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(pages))
            # pages of like length share a batch, so that little of it is padding
            near = [sorted(order[lo : lo + 12 * batch], key=lambda i: len(pages[i].counts)) for lo in range(0, len(order), 12 * batch)]
            batches = [own[lo : lo + batch] for own in near for lo in range(0, len(own), batch)]
            for own in (batches[i] for i in rng.permutation(len(batches))):
                t += 1
                for k, g in self._step([pages[i] for i in own], [labels[i] for i in own]).items():
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= rate * (0.5 if epoch > epochs // 2 else 1) * m[k] / (1 - 0.9**t) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return self


# --- made-up training pages -------------------------------------------------------------------------------------

SYLLABLES = ("an", "be", "cor", "de", "el", "fi", "gan", "ho", "in", "ju", "ka", "lor", "men", "no", "or", "pe", "qui", "ra", "sen", "ti", "ur", "va", "wen", "xi", "yo", "zu")
ARTICLE = ("<article>", "<article>", "<article>", "<main>", "<main><article>", '<article class="post">', '<div class="content">', '<div id="article-body">', '<div class="post entry">', '<section class="story">', '<div role="main">', '<div id="main">', '<div class="main">', '<div id="content">', '<div class="text">')
# names that pages give to the parts that are not the article
BESIDE = {
    "ad": ("ad", "ads", "advert", "advertisement", "banner", "promo", "sponsored", "promotion", "adsense"),
    "notice": ("cookie", "cookie-notice", "consent", "gdpr", "notice", "alert", "popup", "modal", "cookie-banner"),
    "aside": ("sidebar", "related", "widget", "trending", "recommended", "aside", "popular", "more-stories"),
    "comments": ("comments", "comment", "reader-comments", "discussion", "replies", "comment-list", "disqus"),
    "share": ("share", "social", "sharing", "follow-us", "share-bar"),
    "menu": ("menu", "nav", "navbar", "breadcrumb", "topbar", "pagination", "navigation", "crumbs"),
    "head": ("header", "masthead", "site-header", "top", "logo"),
    "foot": ("footer", "site-footer", "copyright", "bottom", "legal"),
    "form": ("newsletter", "signup", "subscribe", "search", "login", "contact-form"),
}
SAID = ("cookies", "subscribe", "share", "sign", "up", "newsletter", "reply", "comments", "login", "privacy", "terms", "policy", "copyright", "advertisement", "read", "more", "related", "menu", "search")


def made_up_page(rng: random.Random) -> tuple[str, list[str]]:
    """A page and its main-text blocks."""
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))
    main: list[str] = []
    count = [0]
    # every fifth article has no paragraphs but plain containers
    leaf = "div" if rng.random() < 0.2 else "p"

    def sentence(low: int, high: int, said: float = 0.0) -> str:
        count[0] += 1
        words = [rng.choice(SAID) if rng.random() < said else word() for _ in range(rng.randint(low, high))]
        if rng.random() < 0.2:
            words = [w + rng.choice([",", ".", " |", ""]) for w in words]
        text = " ".join(words)
        return (text.capitalize() if rng.random() < 0.7 else text) + rng.choice([".", ".", "", "!"])

    def tagged(kind: str, body: str) -> str:
        name = rng.choice(BESIDE[kind])
        attr = f"{rng.choice(['class', 'class', 'id'])}={rng.choice(['"', chr(39)])}"
        tag = rng.choice({"aside": ("aside", "div"), "menu": ("nav", "nav", "div"), "head": ("header", "header", "div"), "foot": ("footer", "footer", "div"), "form": ("form", "div"), "comments": ("section", "div", "div")}.get(kind, ("div", "div", "section")))
        if tag in ("nav", "header", "footer", "aside", "form") and rng.random() < 0.6:
            return f"<{tag}>{body}</{tag}>"
        return f"<{tag} {attr}{name}{attr[-1]}>{body}</{tag}>"

    def beside(kind: str) -> str:
        item = lambda: f'<li><a href="/{word()}">{sentence(1, 3)}</a></li>'
        if kind in ("menu", "share"):
            return tagged(kind, f"<ul>{''.join(item() for _ in range(rng.randint(1, 8)))}</ul>")
        if kind == "comments":
            one = lambda: f'<div class="{rng.choice(["comment", "reply", "comment-body"])}"><p>{sentence(2, 25, 0.05)}</p></div>' if rng.random() < 0.7 else f"<p>{sentence(2, 25)}</p>"
            return tagged(kind, (f"<h3>{sentence(1, 2, 0.8)}</h3>" if rng.random() < 0.5 else "") + "".join(one() for _ in range(rng.randint(1, 4))))
        if kind == "form":
            return tagged(kind, f"<label>{sentence(1, 3, 0.5)}</label><input type=text><button>{sentence(1, 2, 0.7)}</button>")
        if kind == "aside" and rng.random() < 0.5:
            return tagged(kind, f"<h4>{sentence(1, 3, 0.4)}</h4><ul>{''.join(item() for _ in range(rng.randint(1, 5)))}</ul>")
        said = {"notice": 0.3, "foot": 0.2}.get(kind, 0.05)
        text = ("&copy; " if kind == "foot" and rng.random() < 0.7 else "") + sentence(1, 16, said)
        return tagged(kind, rng.choice([text, f"<p>{text}</p>", f"<span>{text}</span>", f"<div><p>{text}</p><p>{sentence(1, 12, said)}</p></div>"]))

    def paragraph() -> str:
        text = sentence(1, rng.choice([3, 12, 60]))
        main.append(" ".join(text.split()))
        kind = rng.random()
        if kind < 0.08:
            return f"<h2>{text}</h2>"
        if kind < 0.14:
            return f"<ul><li>{text}</li></ul>"
        if kind < 0.18:
            return f"<blockquote>{text}</blockquote>"
        if kind < 0.3:
            return f"<p><b>{text}<br>"
        if kind < 0.42:
            more = [sentence(1, rng.choice([2, 6])) for _ in range(rng.randint(1, 7))]
            main.extend(" ".join(t.split()) for t in more)
            cells = [text, *more]
            shape = rng.randint(0, 4)
            if shape == 0:
                wide = rng.randint(1, 3)
                head = rng.choice(["th", "th", "td"])
                rows = [cells[i : i + wide] for i in range(0, len(cells), wide)]
                return "<table>" + "".join("<tr>" + "".join(f"<{head if not i else 'td'}>{c}</{head if not i else 'td'}>" for c in row) + "</tr>" for i, row in enumerate(rows)) + "</table>"
            if shape == 1:
                return "<dl>" + "".join(f"<{t}>{c}</{t}>" for c, t in zip(cells, ["dt", "dd"] * len(cells), strict=False)) + "</dl>"
            if shape == 2:
                return f"<figure><img src=x>{''.join(f'<figcaption>{c}</figcaption>' for c in cells)}</figure>"
            kind_of = rng.choice(["ul", "ol"])
            return f"<{kind_of}>{''.join(f'<li>{c}</li>' for c in cells)}</{kind_of}>"
        if kind < 0.46:
            return f"<pre>{text}</pre>"
        return f"<{leaf}>{text}</{leaf}>"

    around = ["menu", "head", "notice", "ad", "aside", "foot", "form", "share", "comments"]
    above = [beside(k) for k in rng.sample(around, rng.randint(0, 4))]
    # a third of the articles stand in containers that say nothing: plain ones, ones with names of no meaning, or none
    opening = rng.choice(ARTICLE) if rng.random() < 0.67 else rng.choice(["", "<div>", "<div><div>", "<section>", f'<div class="{word()}">', f'<div id="{word()}"><div class="{word()}-{word()}">', "<table><tr><td>"])
    closing = "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", opening)))
    inner = []
    if rng.random() < 0.8:
        title = sentence(1, 9)
        main.append(" ".join(title.split()))
        inner.append(f"<h1>{title}</h1>")
    for _ in range(rng.choice([0, 1, 2, 4, 8, 16])):
        inner.append(paragraph())
        if rng.random() < 0.12:
            inner.append(beside(rng.choice(["ad", "share", "aside", "form", "notice"])))
    if rng.random() < 0.25:
        inner.append(beside("comments"))
    below = [beside(k) for k in rng.sample(around, rng.randint(0, 4))]
    if rng.random() < 0.7:
        below.append(beside("foot"))
    wrap = rng.choice([("", ""), ("", ""), ('<div class="wrapper">', "</div>"), ('<div id="page"><div class="container">', "</div></div>"), ('<div id="page">', "</div>"), ('<div class="site"><div id="inner">', "</div></div>")])
    page = f"<html><head><title>{word()}</title><script>var x='<p>';</script></head><body>{wrap[0]}{''.join(above)}{opening}{''.join(inner)}{closing}{''.join(below)}{wrap[1]}"
    return page + rng.choice(["</body></html>", "", ""]), main


def training_set(n: int, seed: int) -> tuple[list[Sequence], list[np.ndarray]]:
    rng = random.Random(seed)
    pages, labels = [], []
    while len(pages) < n:
        page, main = made_up_page(rng)
        found, left = blocks(page), list(main)
        want = []
        for b in found:
            hit = bool(left) and b.text == left[0]
            if hit:
                left.pop(0)
            want.append(float(hit))
        if found and not left:
            pages.append(sequence(found)), labels.append(np.array(want))
    return pages, labels


@lru_cache(maxsize=2)
def labeller(n_train: int = 1600, epochs: int = 10, seed: int = 3) -> Labeller:
    pages, labels = training_set(n_train, seed)
    return Labeller(seed=seed).fit(pages, labels, epochs, seed=seed)


def extract(pages: list[str | None], model: Labeller) -> list[str]:
    """Main text of each page."""
    cut = [blocks(p) for p in pages]
    scores = model.scores([sequence(b) for b in cut])
    return ["\n\n".join(b.text for b, s in zip(own, y, strict=True) if s >= 0.5) for own, y in zip(cut, scores, strict=True)]


def extract_pages(pages: DataFrame, **training) -> DataFrame:
    """page_id, url, text, n_chars for every row; one map-side pass over whole pages."""
    shared = pages.sparkSession.sparkContext.broadcast(labeller(**training))

    def make():
        model = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts: list[str] = []
            for lo in range(0, batch.num_rows, 256):
                texts += extract(batch.column(2).slice(lo, 256).to_pylist(), model)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

        return step

    idtype = pages.schema["page_id"].dataType.simpleString()
    return map_arrow(pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")), make, f"page_id {idtype}, url string, text string, n_chars long")
