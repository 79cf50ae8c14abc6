import html as entities
import re
import time

import numpy as np

from starloom.llm import html


def test_blocks():
    page = '<!doctype html><title>T</title><script>var a = "<p>no</p>";</script><!-- <p>no --><nav class="Main-Menu x"><a href=">">a&amp;b</a></nav><p><b>one<br>two <i>x</i><p>three &lt;p&gt;\n\t 4<style>p{}'
    got = html.blocks(page)
    assert [b.text for b in got] == ["a&b", "one two x", "three <p> 4"]
    assert got[0].path == ["<nav>", "main", "menu", "x"] and got[0].linked == 7 and got[1].path == ["<p>"] and got[2].path == ["<p>"]
    assert html.blocks(None) == html.blocks("") == html.blocks("<p> </p><script>x") == []
    assert [b.text for b in html.blocks("</div>a</p>b < c <d<div>e")] == ["a", "b < c e"]


def test_lost_ends():
    """Raw elements without an end, and marks that close themselves, take no text with them."""
    assert [b.text for b in html.blocks('<article><p>one</p><svg class="i"/><p>two</p><svg/><p>3</p><select/>y<title/>z</article>')] == ["one", "two", "3", "y z"]
    assert [b.text for b in html.blocks("<p>a</p><iframe src=x><p>b</p><svg><p>c</p><script src=x></script>d<style>no")] == ["a", "b", "c", "d"]
    assert [b.text for b in html.blocks('<p title="a>b">c</p><p title="d>e</p>f<p \'g>h')] == ["c", "e", "f", "h"]
    assert [b.text for b in html.blocks("<!-->a<!--b--><?x>c<!d>e<")] == ["ace<"]


def test_broken_markup_takes_linear_time():
    for bad in ('<b "', '<b ">" ', "<!", "<svg>", "<a ", "<a \"'", "<script", '<a href="x>', "</a ", "<", "<div>", "<i>"):
        began = time.process_time()
        html.blocks(bad * (600_000 // len(bad)))
        assert time.process_time() - began < 12, bad
    for parts in (("<a>", "<b>", "</a>"), ("<div>", "<i>", "</div>"), ("<i>", "<div>", "</i>"), ("<p>", "<li>", "</p>"), ("<a>", "<b>", "</a>", "</b>"), ("<td>", "<tr>", "</i>", "</tr>")):
        began = time.process_time()
        html.blocks("".join(p * 40_000 for p in parts))
        html.blocks("".join(parts) * 40_000)
        assert time.process_time() - began < 12, parts


def test_inline_elements_end_with_their_block():
    assert [(b.text, b.linked) for b in html.blocks("<p><a>one<p>two</a> <a><b>three</a>four")] == [("one", 3), ("two threefour", 5)]
    assert [(b.text, b.linked) for b in html.blocks("<div><a>x<a>y</a>z</div>w</a>v")] == [("xyz", 3), ("wv", 0)]


def slow_scores(model, s):
    """One page, one step after another, from the formulas of the network."""
    n, p, k = len(s.counts), model.p, model.hidden
    at = lambda ids, starts, i: ids[starts[i] : starts[i + 1] if i + 1 < n else len(ids)]
    x = [np.concatenate([sum(p["path"][j] for j in at(s.path, s.path_at, i)), sum(p["word"][j] for j in at(s.words, s.words_at, i)) / len(at(s.words, s.words_at, i)), s.counts[i]]) for i in range(n)]
    sig = lambda v: 1 / (1 + np.exp(-v))

    def run(way, order):
        h, c, out = np.zeros(k), np.zeros(k), {}
        for i in order:
            z = x[i] @ p["x" + way] + h @ p["h" + way] + p["c" + way]
            c = sig(z[k : 2 * k]) * c + sig(z[:k]) * np.tanh(z[3 * k :])
            h = out[i] = sig(z[2 * k : 3 * k]) * np.tanh(c)
        return out

    f, b = run("f", range(n)), run("b", range(n - 1, -1, -1))
    return [float(sig(np.concatenate([f[i], b[i], x[i]]) @ p["out"] + p["bias"])[0]) for i in range(n)]


def test_scores_against_single_steps():
    pages, _ = html.training_set(40, 17)
    model = html.labeller()
    for s, y in zip(pages, model.scores(pages), strict=True):
        assert np.allclose(y, slow_scores(model, s), atol=1e-9)


SAID = "The river rose in the night, and by morning the lower town stood under a metre of brown water."
# pages written by hand, in shapes that the training pages do not have: (page, main text)
BY_HAND = [
    (f'<html><body><div id="nav"><ul><li><a href="/">Home</a></li><li><a href="/a">About</a></li></ul></div><div><h1>Flood</h1><p>{SAID}</p><p>{SAID}</p></div><div id="footer">&copy; 2020 The Paper</div></body></html>', ["Flood", SAID, SAID]),
    (f'<body><div class="nav-bar"><a href="/">Start</a> <a href="/b">News</a></div><div>{SAID}<table><tr><th>Place</th><th>Height</th></tr><tr><td>Mill</td><td>3 m</td></tr></table></div>', [SAID, "Place", "Height", "Mill", "3 m"]),
    (f"<h1>Flood</h1><p>{SAID}</p><ol><li>First the mill.</li><li>Then the bridge.</li></ol>", ["Flood", SAID, "First the mill.", "Then the bridge."]),
    (f'<body><header><a href="/">The Paper</a></header><main><p>{SAID}</p><aside class="related"><h4>Related</h4><ul><li><a href="/x">Dry summer</a></li></ul></aside><p>{SAID}</p></main><footer><p>All rights reserved</p></footer>', [SAID, SAID]),
    (f'<body><div class="cookie-consent"><p>We use cookies.</p><button>Accept</button></div><section><h2>Flood</h2><p>{SAID}</p><svg class="icon"/><blockquote>We ran.</blockquote></section><div class="comments"><div class="comment"><p>So sad to read this.</p></div></div>', ["Flood", SAID, "We ran."]),
    (f'<body><div id="nav"><a href="/">Home</a> <a href="/n">News</a></div><div><h1>Flood</h1><div>{SAID}</div><div>Then the bridge went.</div><div>{SAID}</div></div><div class="footer">&copy; 2021 The Paper</div></body>', ["Flood", SAID, "Then the bridge went.", SAID]),
    (f'<body><div id="nav"><ul><li><a href="/">Home</a></li></ul></div><h1>Flood</h1><div>{SAID}</div><div>{SAID} {SAID}</div><div>{SAID}</div><div class="footer"><div>Contact us</div></div></body>', ["Flood", SAID, f"{SAID} {SAID}", SAID]),
    (f'<body><div class="menu"><a href="/">Home</a></div><div class="x1"><div class="x2"><div>{SAID}</div><div>Nobody was hurt.</div></div></div><div id="sidebar"><div>Popular</div><div><a href="/q">Dry summer</a></div></div><div class="footer">All rights reserved</div></body>', [SAID, "Nobody was hurt."]),
    (f'<body><div id="page"><div id="main"><p>{SAID}</p><p>{SAID}</p></div><div id="sidebar"><p>Popular</p><ul><li><a href="/1">One</a></li></ul></div><form class="newsletter"><label>Mail</label><input><button>Go</button></form></div>', [SAID, SAID]),
]


def test_pages_written_by_hand():
    want = ["\n\n".join(main) for _, main in BY_HAND]
    assert html.extract([page for page, _ in BY_HAND], html.labeller()) == want


def test_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "u", f"<p>{SAID}</p>", "old", 7)], "page_id long, url string, html string, text string, n_chars int")
    assert [tuple(r) for r in html.extract_pages(rows).collect()] == [(1, "u", SAID, len(SAID))]


def test_gradients():
    pages, labels = html.training_set(3, 5)
    model = html.Labeller(hidden=3, path_dim=2, word_dim=2, seed=1)
    grads = model._step(pages, labels)

    def loss():
        y, want = np.concatenate(model.scores(pages)), np.concatenate(labels)
        return -(want * np.log(y) + (1 - want) * np.log(1 - y)).mean()

    rng = np.random.default_rng(0)
    for name, p in model.p.items():
        flat, own = p.reshape(-1), grads[name].reshape(-1)
        for i in rng.choice(np.flatnonzero(own), min(5, np.count_nonzero(own)), replace=False):
            old, eps = flat[i], 1e-5
            flat[i] = old + eps
            up = loss()
            flat[i] = old - eps
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * eps) - own[i]) < 1e-6, name


def test_held_out_pages():
    pages, labels = html.training_set(200, 4711)
    scores = html.labeller().scores(pages)
    wrong = sum(((s >= 0.5) != (w > 0.5)).sum() for s, w in zip(scores, labels, strict=True))
    assert wrong / sum(map(len, labels)) < 0.005


def test_table_and_odd_rows(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in html.extract_pages(pages).collect()}
    for r in pages.collect():
        article = re.search(r"(?s)<article>(.*)</article>", r.html)[1]
        want = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert got[r.page_id].text == "\n\n".join(x for x in want if x) and got[r.page_id].n_chars == len(got[r.page_id].text)
    long = "<article>" + "<p>word word word.</p>" * 20_000 + "</article>"
    odd = spark.createDataFrame([(1, None, None, "t"), (None, "u", "", "t"), (1, "u", long, "t"), (1, "u", long, "t"), (2, "u", "<div>" * 5000 + "x", "t")], "page_id long, url string, html string, text string")
    rows = html.extract_pages(odd).collect()
    assert [r.n_chars for r in rows[:2]] == [0, 0] and rows[2].text == rows[3].text == "\n\n".join(["word word word."] * 20_000)
    assert html.extract_pages(odd.limit(0)).count() == 0
