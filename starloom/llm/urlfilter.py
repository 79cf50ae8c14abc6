"""URL filters: exact host/path rules, and pattern rules that are indexed by their rarest literal token.

Host/path rules decide where one fits: the longest one does. Every other URL is judged by pattern rules. From a rule's
pattern the literal tokens are derived that any URL it matches must hold as whole tokens (``required_tokens``); the rule
is filed under the one that the fewest rules share, and a pattern from which no token follows is refused. A URL is cut into tokens once, its tokens fetch the candidate rules, and only the candidates' regular
expressions run. Block rules win over allow rules; a URL that no rule matches gets ``default``.

The rules are parameters of the job, not data: at most ``MAX_RULES`` of each kind, checked, are sent to the executors.

Edge cases: null URLs and URLs without ``://`` have an empty host and path and get ``default``; very long URLs are
judged whole; repeated rows are judged one by one; null ids are carried; an empty table gives an empty result; further
columns, also ones named like the results, are left out; of equally long host/path rules the first in order decides.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import map_arrow

try:  # the parser of the re module, whose place depends on the version of Python
    from re import _parser as pattern_parser
except ImportError:
    import sre_parse as pattern_parser

MAX_RULES = 200_000
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TOKEN = re.compile(r"[a-z0-9]+")
TOKEN_CHARACTERS = "abcdefghijklmnopqrstuvwxyz0123456789"


@dataclass(frozen=True)
class HostRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def _edges(parsed) -> tuple[bool, bool, bool]:
    """Of all texts that a parsed pattern can take up: (some is empty, none begins with a token character, none ends with one)."""
    parts = [_edge(op, value) for op, value in parsed]

    def side(order, which: int) -> bool:
        for p in order:
            if not p[which]:
                return False
            if not p[0]:
                return True
        return True

    return all(p[0] for p in parts), side(parts, 1), side(reversed(parts), 2)


def _edge(op, value) -> tuple[bool, bool, bool]:
    name = str(op)
    if name == "LITERAL":
        return (False, *[not TOKEN.match(chr(value))] * 2)
    if name == "IN":
        return (False, *[not any(_in_set(value, ord(c)) for c in TOKEN_CHARACTERS)] * 2)
    if name == "SUBPATTERN":
        return _edges(value[3])
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        empty, first, last = _edges(value[2])
        return empty or value[0] == 0, first, last
    if name == "BRANCH":
        edges = [_edges(way) for way in value[1]]
        return any(e[0] for e in edges), all(e[1] for e in edges), all(e[2] for e in edges)
    if name == "AT" and str(value) == "AT_NON_BOUNDARY":
        return True, True, True  # says nothing about what stands there, so one looks past it
    if name == "AT" or name == "ASSERT_NOT" and len(value[1]) == 1 and str(value[1][0][0]) == "IN" and all(_in_set(value[1][0][1], ord(c)) for c in TOKEN_CHARACTERS):
        return False, True, True  # beside a token character these stand where a token ends
    return (True, True, True) if name.startswith("ASSERT") else (False, False, False)


def _in_set(items, c: int) -> bool:
    """Whether a parsed character set may hold a character; categories are taken to."""
    hit = any(str(op) == "LITERAL" and v == c or str(op) == "RANGE" and v[0] <= c <= v[1] or str(op) == "CATEGORY" for op, v in items)
    negated = str(items[0][0]) == "NEGATE"
    return (not hit or any(str(op) == "CATEGORY" for op, _ in items)) if negated else hit


def _folds_beyond_ascii(parsed, flags: int) -> bool:
    """Whether some literal also stands for a letter beyond ASCII, such as the long s or the Kelvin sign."""
    if flags & re.IGNORECASE and not flags & re.ASCII:
        return True
    for op, value in parsed:
        name = str(op)
        if name == "SUBPATTERN":
            inner = [(value[3], (flags | value[1]) & ~value[2])]
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            inner = [(value[2], flags)]
        elif name == "BRANCH":
            inner = [(way, flags) for way in value[1]]
        elif name in ("ASSERT", "ASSERT_NOT"):
            inner = [(value[1], flags)]
        elif name == "ATOMIC_GROUP":
            inner = [(value, flags)]
        elif name == "GROUPREF_EXISTS":
            inner = [(way, flags) for way in value[1:] if way is not None]
        else:
            continue
        if any(_folds_beyond_ascii(*i) for i in inner):
            return True
    return False


def required_tokens(pattern: str) -> tuple[str, ...]:
    """Tokens that every text in which ``pattern`` is found holds as whole tokens, proved from the parsed pattern.

    Runs of token characters that the pattern always takes up count if what stands before and after them can only be
    another character or an end; parts that may be left out are looked past. Nothing is proved where case is ignored
    beyond ASCII, as a letter may then stand for one that is no token character; URLs are folded anyway.
    """
    tree = pattern_parser.parse(pattern)
    if _folds_beyond_ascii(tree, tree.state.flags):
        return ()
    flat: list[tuple] = []

    def flatten(parsed) -> None:
        for op, value in parsed:
            if str(op) == "SUBPATTERN":
                flatten(value[3])
            else:
                flat.append((op, value))

    flatten(tree)
    character = [chr(v) if str(op) == "LITERAL" and TOKEN.match(chr(v)) else None for op, v in flat]
    edges = [_edge(op, v) for op, v in flat]

    def closed(order, which: int) -> bool:
        for i in order:
            if not edges[i][which]:
                return False
            if not edges[i][0]:
                return True
        return False  # the text may go on beyond the pattern

    found, i = [], 0
    while i < len(flat):
        j = i
        while j < len(flat) and character[j]:
            j += 1
        if j > i and closed(range(i - 1, -1, -1), 2) and closed(range(j, len(flat)), 1):
            found.append("".join(character[i:j]))
        i = j + 1
    return tuple(dict.fromkeys(found))


@dataclass(frozen=True)
class PatternRule:
    """``pattern`` is searched in the folded URL; ``literals`` are tokens of every matching URL, all derived ones if not given."""

    pattern: str
    literals: tuple[str, ...] = ()
    verdict: str = "block"

    def __post_init__(self):
        proved = required_tokens(self.pattern)
        if not proved or not set(self.literals) <= set(proved):
            raise ValueError(f"{self.pattern}: a pattern rule needs literal tokens to be indexed by, proved are {proved}")
        object.__setattr__(self, "literals", self.literals or proved)


HOST_RULES = (
    HostRule("org", "/", "allow"),
    HostRule("example.org", "/es/", "block"),
    HostRule("example.org", "/en/1", "block"),
    HostRule("com", "/fr/", "allow"),
    HostRule("com", "/de/", "block"),
)
# fixed values: labels of hosts and names of folders that training data leave out
HOST_WORDS = (
    "spam", "casino", "casinos", "poker", "betting", "bet", "slots", "jackpot", "lottery", "roulette", "porn", "porno", "xxx", "sex", "adult", "escort", "escorts", "nude", "hentai", "camgirls",
    "malware", "phishing", "virus", "trojan", "botnet", "exploit", "ransomware", "viagra", "cialis", "pharmacy", "pills", "replica", "payday", "loans", "warez", "torrent", "torrents", "crack", "cracks", "keygen", "nulled", "doorway", "linkfarm", "clickbait",
)
PATH_WORDS = ("click", "banner", "popup", "popunder", "redirect", "track", "tracker", "impression", "doubleclick")
PATTERN_RULES = (
    *(PatternRule(rf"://(?:[^/?#]*[.-])?{w}[.-]") for w in HOST_WORDS),
    *(PatternRule(rf"/(?:ads?|adserver)/(?:[^?#]*/)?{w}(?:[^a-z0-9]|$)") for w in PATH_WORDS),
    *(PatternRule(rf"[?&]utm_medium={w}(?:[&#]|$)") for w in ("popunder", "popup", "spam")),
    PatternRule(r"/wp-login\.php(?:[?#]|$)"),
    PatternRule(r"/wp-admin/(?:[^?#]*/)?install\.php(?:[?#]|$)"),
    PatternRule(r"/(?:cgi-bin|scripts)/(?:[^?#]*/)?redirect\.(?:php|cgi|pl)(?:[?#]|$)"),
    PatternRule(r"[?&](?:phpsessid|jsessionid|sid)=[0-9a-f]{16,}[^#]*&ref=spam(?:[&#]|$)"),
)


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): the host A-Z lower-cased; both empty without ``://``."""
    if not url or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    head = re.split(r"[?#]", rest, maxsplit=1)[0]
    host, slash, path = head.partition("/")
    return host.translate(FOLD), slash + path


@lru_cache(maxsize=MAX_RULES)
def compiled(pattern: str) -> re.Pattern:
    """A pattern, compiled when a URL first needs it and kept by the process."""
    return re.compile(pattern)


class UrlFilter:
    """An indexed rule set."""

    def __init__(self, host_rules: Sequence[HostRule] = HOST_RULES, pattern_rules: Sequence[PatternRule] = PATTERN_RULES, default: str = "allow"):
        if max(len(host_rules), len(pattern_rules)) > MAX_RULES:
            raise ValueError(f"more than {MAX_RULES} rules: split the rule set and judge in turns")
        self.default = default
        self.by_host: dict[str, list[HostRule]] = {}
        for rule in host_rules:
            self.by_host.setdefault(rule.host.translate(FOLD), []).append(rule)
        shared = Counter(t for rule in pattern_rules for t in set(rule.literals))
        self.by_token: dict[str, list[tuple[int, str, str]]] = {}
        for rank, rule in enumerate(pattern_rules):
            rarest = min(rule.literals, key=lambda t: (shared[t], -len(t), t))
            self.by_token.setdefault(rarest, []).append((rank, rule.pattern, rule.verdict))

    def host_rule(self, host: str, path: str) -> HostRule | None:
        """The longest rule for the host or a parent domain whose path begins the URL's."""
        best, name = None, host
        while name:
            for rule in self.by_host.get(name, ()):
                if path.startswith(rule.path) and (best is None or len(rule.name) > len(best.name)):
                    best = rule
            name = name.partition(".")[2]
        return best

    def candidates(self, url: str) -> list[tuple[int, str, str]]:
        return sorted({c for t in set(TOKEN.findall(url)) & self.by_token.keys() for c in self.by_token[t]}, key=lambda c: c[0])

    def pattern_verdict(self, url: str | None) -> str:
        folded = (url or "").translate(FOLD)
        if "://" not in folded:
            return self.default
        verdicts = {verdict for _, pattern, verdict in self.candidates(folded) if compiled(pattern).search(folded)}
        return "block" if "block" in verdicts else "allow" if "allow" in verdicts else self.default

    def judge(self, url: str | None) -> tuple[str, str, str | None, str]:
        """(host, path, rule, verdict)."""
        host, path = split_url(url)
        rule = self.host_rule(host, path)
        return host, path, rule and rule.name, rule.verdict if rule else self.pattern_verdict(url)


@lru_cache(maxsize=4)
def url_filter(host_rules: tuple[HostRule, ...], pattern_rules: tuple[PatternRule, ...], default: str) -> UrlFilter:
    return UrlFilter(host_rules, pattern_rules, default)


def judge_pages(pages: DataFrame, host_rules: Sequence[HostRule] = HOST_RULES, pattern_rules: Sequence[PatternRule] = PATTERN_RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row; one map-side pass over the url column."""
    given = (tuple(host_rules), tuple(pattern_rules), default)
    url_filter(*given)  # wrong rules fail here, not on an executor
    shared = pages.sparkSession.sparkContext.broadcast(given)

    def make():
        rules = url_filter(*shared.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [rules.judge(u) for u in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[i] for f in found], pa.string()) for i in range(4))], names=["page_id", "host", "path", "rule", "verdict"])

        return step

    idtype = pages.schema["page_id"].dataType.simpleString()
    return map_arrow(pages.select("page_id", F.col("url").cast("string").alias("url")), make, f"page_id {idtype}, host string, path string, rule string, verdict string")
