import random
import re

import pytest

from starloom.llm import urlfilter as uf


def test_split():
    assert uf.split_url("HTTP://WWW.Example.ORG/En/1?x#y") == ("www.example.org", "/En/1")
    assert uf.split_url("a://h?q=/x") == ("h", "") and uf.split_url("a://h#/x") == ("h", "") and uf.split_url("a://h") == ("h", "")
    assert uf.split_url("//h/p") == uf.split_url(None) == uf.split_url("") == ("", "")
    assert uf.split_url("x://a/b://c") == ("a", "/b://c") and uf.split_url("x://ÉÄ.De/") == ("ÉÄ.de", "/")


def test_contract_rules():
    judge = lambda u: uf.UrlFilter().judge(u)[2:]
    assert judge("http://a.example.org/es/1") == ("example.org/es/", "block")
    assert judge("http://example.org/en/19") == ("example.org/en/1", "block")
    assert judge("http://example.org/en/2") == ("org/", "allow")
    assert judge("http://badexample.org/es/1") == ("org/", "allow")
    assert judge("http://x.com/fr/1") == ("com/fr/", "allow") and judge("http://x.com/de/") == ("com/de/", "block")
    assert judge("http://x.com/en/") == (None, "allow") and judge("http://org") == (None, "allow")
    assert judge("http://a-spam.b.net/en") == (None, "block") and judge(None) == (None, "allow")


def test_index_agrees_with_running_every_rule():
    rng = random.Random(3)
    words = ["spam", "casino", "ads", "click", "banner", "x", "a1", "login", "wp", "php", "utm", "medium", "popunder", "porn"]
    rules = list(uf.PATTERN_RULES) + [uf.PatternRule(rf"(?<![a-z0-9]){a}[./-]{b}(?![a-z0-9])", (a, b), rng.choice(["block", "allow"])) for a in words for b in words if rng.random() < 0.3]
    f = uf.UrlFilter((), rules, "default")
    for _ in range(3000):
        url = "http://" + "".join(rng.choice(words) + rng.choice("./-?&=_#") for _ in range(rng.randint(0, 8)))
        hit = {r.verdict for r in rules if re.search(r.pattern, url)}
        assert f.pattern_verdict(url) == ("block" if "block" in hit else "allow" if "allow" in hit else "default"), url


def test_required_tokens_are_proved():
    for pattern, want in ((r"spam", ()), (r"\bspam\b", ("spam",)), (r"^spam/", ("spam",)), (r"(?<![a-z0-9])a1[./-]b2(?![a-z0-9])", ("a1", "b2")), (r"x?spam.", ()), (r"(?:a|b)spam/", ()), (r"[^a-z0-9]spam[/]", ("spam",)), (r"/(?:x/)*spam(?:$|/)", ("spam",)), (r"/spam\d*/", ()), (r"/spam[^/]", ())):
        assert uf.required_tokens(pattern) == want, pattern
    for pattern, literals in ((r"spam", ()), (r"/spam/", ("ham",)), (r"/[a-z]+/", ())):
        with pytest.raises(ValueError):
            uf.PatternRule(pattern, literals)
    rng = random.Random(8)
    for rule in uf.PATTERN_RULES:
        for _ in range(300):
            url = "http://" + "".join(rng.choice(["spam", "ads/", "click", "/wp-login.php", "casino", rule.literals[0], rng.choice("./-?&=_#"), "a", "?utm_medium=popup"]) for _ in range(6))
            if re.search(rule.pattern, url):
                assert set(rule.literals) <= set(uf.TOKEN.findall(url)), (rule, url)


def test_anchors_and_flags():
    for pattern, want in ((r"\Bspam[./]", ()), (r"\bspam\B", ()), (r"/spam\b", ("spam",)), (r"(?i)://spam\.", ()), (r"(?ia)://spam\.", ("spam",)), (r"/(?i:spam)/", ()), (r"/(?:x|(?i:y))/spam/", ()), (r"/\Bspam/", ("spam",)), (r"-(?=x)\Bspam/", ("spam",))):
        assert uf.required_tokens(pattern) == want, pattern
    assert re.search(r"\Bspam[./]", "http://antispam.com/") and re.search(r"(?i)://spam\.", "http://\u017fpam.com/")


def random_pattern(rng, depth=2):
    parts = ["spam", "ad", "k1", "[./-]", "[^a-z0-9]", "[a-z]", r"\b", r"\B", "^", "$", "/", r"\.", "x?", "[0-9]*", r"\d", r"\w", r"\W", "(?<![a-z0-9])", "(?![a-z0-9])", "(?=[./])", "(?<=/)", "."]
    out = []
    for _ in range(rng.randint(1, 5)):
        kind = rng.random()
        if depth and kind < 0.15:
            out.append(f"(?:{random_pattern(rng, depth - 1)}|{random_pattern(rng, depth - 1)})" + rng.choice(["", "", "?", "*"]))
        elif depth and kind < 0.22:
            out.append(f"({random_pattern(rng, depth - 1)})" + rng.choice(["", "?", "+"]))
        elif depth and kind < 0.27:
            out.append(f"(?i:{random_pattern(rng, depth - 1)})")
        else:
            out.append(rng.choice(parts))
    return "".join(out)


def test_random_patterns_never_lose_a_match():
    """Every URL that a pattern matches holds the tokens by which the pattern is filed."""
    rng = random.Random(12)
    pieces = ["spam", "ad", "k1", "k", "x", "1", "/", ".", "-", "_", "\u017f", "\u212a", "\u00e9", "pam", "S".lower(), "\n"]
    urls = ["http://" + "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) for _ in range(4000)]
    proved = matched = 0
    edge = ["", "/", "[./-]", r"\b", r"\B", "^", "$", "(?<![a-z0-9])", "(?![a-z0-9])", "(?:[^a-z]|$)", r"\W", "[./]?", "(?:-|x)"]
    for _ in range(12_000):
        around = [random_pattern(rng) if rng.random() < 0.4 else "" for _ in range(2)]
        core = rng.choice(edge) + rng.choice(edge) + rng.choice(["spam", "ad", "k1", "k"]) + rng.choice(edge) + rng.choice(edge)
        pattern = rng.choice(["", "", "", "(?i)", "(?ia)"]) + around[0] + core + around[1]
        tokens = uf.required_tokens(pattern)
        if not tokens:
            continue
        proved += 1
        find = re.compile(pattern)
        for url in rng.sample(urls, 150):
            if find.search(url):
                matched += 1
                assert set(tokens) <= set(uf.TOKEN.findall(url)), (pattern, tokens, url)
    assert proved > 100 and matched > 500


def test_odd_rows(spark):
    rows = [(1, None, "h"), (1, None, "h"), (None, "http://example.org/es/", "h"), (2, "http://a/" + "b" * 200_000, "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = uf.judge_pages(pages).collect()
    assert [(r.page_id, r.host, r.rule, r.verdict) for r in got] == [(1, "", None, "allow"), (1, "", None, "allow"), (None, "example.org", "example.org/es/", "block"), (2, "a", None, "allow")]
    assert uf.judge_pages(pages.limit(0)).count() == 0
