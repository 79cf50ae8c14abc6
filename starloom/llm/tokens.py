"""Token counts of a byte-level BPE vocabulary with a whole-token shortcut.

A text is split at the tokenizer's special strings, and the rest into pre-tokens by the vocabulary's pattern. Which
vocabulary strings the merges encode as one token of their own is proved once and offline, before any text is read, by running the merge procedure on each
of them; a pre-token among those counts one without any merging. Only the other pre-tokens are merged, and their counts
are remembered up to a bound. Prediction is map-side over whole texts.

Edge cases: null and empty texts have 0 bytes and 0 tokens; very long runs without a break are merged with a heap in
n log n steps; repeated rows are counted one by one; a null id is carried; an empty table gives an empty result;
further columns, also ones named like the results, are left out.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import map_arrow

# fixed values: the pre-token pattern of the byte-level vocabularies and the limit of the contract
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LIMIT = 1024
REMEMBERED = 400_000


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies: printable Latin-1 is itself, the rest follows 255."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Merged(dict):
    """Token counts of pre-tokens, merged when first met; whole tokens come first.

    Two generations are remembered: when the young one is full, it becomes the old one, from which what is met again
    moves back. So a memory that overflows forgets what is rare and keeps what is common.
    """

    def __init__(self, counter: TokenCounter):
        super().__init__()
        self.counter, self.old = counter, {}

    def __missing__(self, piece: str) -> int:
        if piece in self.counter.whole:
            n = 1
        elif (n := self.old.get(piece)) is None:
            n = self.counter.merged(piece)
        if len(self) >= REMEMBERED // 2:
            self.old = dict(self)
            self.clear()
        if len(piece) < 256:
            self[piece] = n
        return n


class TokenCounter:
    """Counts tokens as the tokenizers library does for a byte-level BPE file without normaliser."""

    def __init__(self, path: str, whole: frozenset[str] | None = None):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True):
            raise ValueError(f"{path}: not a plain byte-level BPE")
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {tuple(p): i for i, p in enumerate(pairs)}
        self.alphabet = byte_alphabet()
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.split = regex.compile(PATTERN).findall
        self.whole = self._proved(model["vocab"]) if whole is None else whole
        self.known = _Merged(self)

    def _proved(self, vocab: dict[str, int]) -> frozenset[str]:
        """Vocabulary strings that merging turns into one token; those that are no pre-token are never asked for."""
        back = {c: b for b, c in self.alphabet.items()}
        found = set()
        for token in vocab:
            try:
                text = bytes(back[c] for c in token).decode("utf-8")
            except (KeyError, UnicodeDecodeError):
                continue
            if self._merge(list(token)) == 1:
                found.add(text)
        return frozenset(found)

    def _merge(self, parts: list[str]) -> int:
        """Number of tokens left when the best-ranked adjacent pairs have been merged, leftmost first."""
        n = len(parts)
        if n < 2:
            return n
        left, right, alive, ranks = [*range(-1, n - 1)], [*range(1, n), -1], n, self.ranks
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i] if parts[i] == a else -1
            if j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, ""
            right[i] = k = right[j]
            alive -= 1
            if k >= 0:
                left[k] = i
                if (r := ranks.get((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[k]))
            if (h := left[i]) >= 0 and (r := ranks.get((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (r, h, parts[h], parts[i]))
        return alive

    def merged(self, piece: str) -> int:
        return self._merge([self.alphabet[b] for b in piece.encode("utf-8", "replace")])

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not (marks := len(self.special.findall(text))):
            return sum(map(self.known.__getitem__, self.split(text)))
        return marks + sum(sum(map(self.known.__getitem__, self.split(part))) for part in self.special.split(text))


@lru_cache(maxsize=4)
def counter(path: str, whole: frozenset[str] | None = None) -> TokenCounter:
    return TokenCounter(path, whole)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; ``path`` is a vocabulary file that every executor has."""

    # proved once, in the driver: at most as many strings as the vocabulary has
    proved = docs.sparkSession.sparkContext.broadcast(counter(path).whole)

    def make():
        count = counter(path, proved.value).count

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = [count(t) for t in batch.column(2).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

        return step

    text = F.col("text").cast("string")
    idtype = docs.schema["doc_id"].dataType.simpleString()
    sized = docs.select("doc_id", F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    return map_arrow(sized, make, f"doc_id {idtype}, n_bytes long, n_tokens long").select("*", (F.col("n_tokens") > limit).alias("over_limit"))
