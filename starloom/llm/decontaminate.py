"""Benchmark decontamination by a prefix-filtered set join; DataFrame functions only.

A window of ``window`` consecutive item words is a set of shingles. Shingles are ordered by rarity, counted over all
documents and all windows. As a whole window has to be contained, a prefix of one shingle is enough: a document can
hold a window only if it holds the window's rarest shingle. Document shingles at every position are probed against
those prefix shingles; the position of a hit fixes where the window would have to begin, so the length and positional
bounds leave one alignment, and the words there are compared with the window's, first by one hash and then one by one.

Documents are read twice, once to count shingles and once to probe them; shingles of all lengths are made in one pass.
The probed side is a broadcast of at most ``block_windows`` rows of five numbers; a larger benchmark is worked off in
blocks of that size against all documents, so nothing that grows is broadcast. Windows with their words are broadcast
to their hits if all of them have no more than ``broadcast_chars`` characters, and else joined by a shuffle. Documents
are never shuffled, only hits and digests. Hits are gathered per document, whose length bounds them; the items of a set
of windows are named once for all documents that hold just that set.

Edge cases: null texts have no words; an item with fewer words than a window, but not none, is one window; an item
without words is none; repeated items count once per item_id; items with a null id mark hits but are not named; rows
that repeat an id and a text get the same result each; an empty benchmark leaves all documents clean, and an empty table
of documents gives an empty result; a very long text is read whole by one task. Further columns of the documents are
ignored by ``contamination`` and kept by ``drop_contaminated``, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import reliable, unused

WINDOW = 10
SHINGLE = 3
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """A-Z lower-cased, split at ASCII characters other than letters and digits; no words for null."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    folded = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(folded, BREAK), "")


def _shingle(words: str, pos: Column, k: int) -> Column:
    """Hash of ``k`` words from ``pos`` (0-based), seeded with k; null beyond the end."""
    return F.when(pos + k <= F.size(words), F.xxhash64(F.lit(k), *[F.get(F.col(words), pos + i) for i in range(k)]))


def _few(df: DataFrame) -> DataFrame:
    """A table of hits or of the benchmark, checkpointed in no more files than there are cores."""
    return reliable(df.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism)))


def windows(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per distinct window: wid, words w, length m, shingle length k, and the item ids that hold it."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("ws")).where("size(ws) > 0")
    cut = items.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("ws") - window + 1, F.lit(1))), lambda i: F.slice("ws", i, window))).alias("w"))
    return cut.groupBy("w").agg(F.collect_set("item").alias("items")).select(F.xxhash64("w").alias("wid"), "w", "items", F.size("w").alias("m"), F.least(F.size("w"), F.lit(shingle)).alias("k"))


def _shingles(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """(id, th, ws, p, s): the shingles of all ``lengths`` at every position."""
    at = docs.select("id", "th", "ws", F.posexplode("ws").alias("p", "_w"))
    hashed = [_shingle("ws", F.col("p"), k) for k in lengths]
    if len(lengths) == 1:
        return at.select("id", "th", "ws", "p", hashed[0].alias("s"))
    return at.select("id", "th", "ws", "p", F.explode(F.array(*hashed)).alias("s"))


def _blocks(side: DataFrame, n: int, block: int, key: str) -> list[DataFrame]:
    parts = max(1, -(-n // block))
    return [side if parts == 1 else side.where(F.pmod(key, F.lit(parts)) == i) for i in range(parts)]


def _united(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _probes(wins: DataFrame, docs: DataFrame, block: int, lengths: list[int]) -> DataFrame:
    """The windows with the offset o and the hash s_ of their rarest shingle."""
    at = wins.select("wid", "w", "m", "k", F.explode(F.sequence(F.lit(0), F.col("m") - F.col("k"))).alias("o"))
    hashed = F.coalesce(*[F.when(F.col("k") == k, _shingle("w", F.col("o"), k)) for k in lengths])
    at = at.select("wid", "m", "o", hashed.alias("s"))
    wanted = _few(at.groupBy("s").agg(F.count("*").alias("in_windows")))
    seen = [_shingles(docs, lengths).join(F.broadcast(side), F.col("s") == F.col("s_")).groupBy("s").agg(F.count("*").alias("n")) for side in _blocks(wanted.select(F.col("s").alias("s_")), wanted.count(), block, "s_")]
    rare = wanted.join(_united(seen), "s").select("s", (F.col("n") * F.col("in_windows")).alias("cost"))
    # a window whose rarest shingle no document has cannot occur
    best = at.join(rare, "s", "left").groupBy("wid", "m").agg(F.min(F.struct(F.coalesce("cost", F.lit(0)).alias("cost"), "s", "o")).alias("b"))
    return _few(best.where("b.cost > 0").select("wid", "m", F.col("b.s").alias("s_"), F.col("b.o").alias("o")))


def occurrences(docs: DataFrame, wins: DataFrame, block_windows: int = 100_000, broadcast_chars: int = 16_000_000) -> DataFrame | None:
    """(id, th, start, m, wid): every place where one of ``wins`` occurs in a document; None if there is no window.

    ``docs`` has id, the hash th of the text and its words ws.
    """
    lengths = [r[0] for r in wins.select("k").distinct().orderBy("k").collect()]  # at most as many as a shingle has words
    if not lengths:
        return None
    probes = _probes(wins, docs, block_windows, lengths)
    found = []
    for side in _blocks(probes, probes.count(), block_windows, "wid"):
        hit = _shingles(docs, lengths).join(F.broadcast(side), F.col("s") == F.col("s_"))
        hit = hit.where((F.col("p") >= F.col("o")) & (F.col("p") - F.col("o") + F.col("m") <= F.size("ws")))
        # the optimiser may cut the words before it tests the bounds, so the cut has to be valid there, too
        hit = hit.withColumn("there", F.slice("ws", F.greatest(F.col("p") - F.col("o") + 1, F.lit(1)), F.col("m"))).where(F.xxhash64("there") == F.col("wid"))
        found.append(hit.select("id", "th", (F.col("p") - F.col("o")).alias("start"), "m", "wid", "there"))
    words = wins.select(F.col("wid").alias("wid_"), "w")
    size = words.agg(F.sum(F.length(F.array_join("w", " ")))).first()[0] or 0
    same = (F.col("wid") == F.col("wid_")) & (F.col("there") == F.col("w"))
    return _united(found).join(F.broadcast(words) if size <= broadcast_chars else words, same).select("id", "th", "start", "m", "wid")


def _digest_docs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit("")), F.length("text")).alias("th"), words_of(F.col("text")).alias("ws"))


def _covered(spans: Column) -> Column:
    """Number of words in a sorted array of (start, m), each counted once."""
    first = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(done: Column, span: Column) -> Column:
        stop = span["start"] + span["m"]
        new = F.greatest(stop - F.greatest(span["start"], done["end"]), F.lit(0))
        return F.struct(F.greatest(done["end"], stop).alias("end"), (done["n"] + new).alias("n"))

    return F.aggregate(spans, first, step)["n"]


def _named(sets: DataFrame, wins: DataFrame) -> DataFrame:
    """(s1, s2, n_items, items_sha256): the items of every set of windows (wids), which goes by two hashes s1 and s2."""
    each = sets.select("s1", "s2", F.explode("wids").alias("wid")).join(wins.select("wid", "items"), "wid").select("s1", "s2", F.explode("items").alias("item"))
    named = each.groupBy("s1", "s2").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return named.select("s1", "s2", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_windows: int = 100_000, broadcast_rows: int = 200_000) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row per row of ``docs``."""
    cut = _digest_docs(docs)
    clean = F.sha2(F.lit(""), 256)
    wins = _few(windows(benchmark, window, shingle))
    hits = occurrences(cut, wins, block_windows)
    sized = cut.select("id", "th", F.size("ws").cast("long").alias("n_words"))
    if hits is None:
        nothing = F.lit(0).cast("long")
        return sized.select(F.col("id").alias("doc_id"), "n_words", nothing.alias("n_hit"), nothing.alias("n_items"), clean.alias("items_sha256"), F.lit(False).alias("contaminated"))
    # a document's hits are no more than its words
    per_doc = hits.groupBy("id", "th").agg(F.sort_array(F.collect_set(F.struct("start", "m"))).alias("spans"), F.sort_array(F.collect_set("wid")).alias("wids"))
    found = _few(per_doc.select(F.col("id").alias("id_"), F.col("th").alias("th_"), _covered(F.col("spans")).cast("long").alias("n_hit"), "wids", F.xxhash64("wids").alias("s1"), F.xxhash64(F.lit(1), "wids").alias("s2")))
    names = _few(_named(found.select("s1", "s2", "wids").dropDuplicates(["s1", "s2"]), wins))
    # beyond that many rows of fixed size, plain shuffles, whose hot keys adaptive execution splits
    side = lambda df: F.broadcast(df) if df.count() <= broadcast_rows else df
    found = found.join(side(names), ["s1", "s2"], "left").select("id_", "th_", "n_hit", "n_items", "items_sha256")
    out = sized.join(side(found), F.col("id").eqNullSafe(F.col("id_")) & (F.col("th") == F.col("th_")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", clean).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_windows: int = 100_000, broadcast_rows: int = 200_000) -> DataFrame:
    """``docs`` without the rows that hold any benchmark window; kept texts are not shuffled up to ``broadcast_rows`` hits."""
    _id, _th = unused(docs, "id", "th")
    hits = occurrences(_digest_docs(docs), _few(windows(benchmark, window, shingle)), block_windows)
    if hits is None:
        return docs
    bad = _few(hits.select(F.col("id").alias(_id), F.col("th").alias(_th)).distinct())
    side = F.broadcast(bad) if bad.count() <= broadcast_rows else bad
    th = F.xxhash64(F.coalesce("text", F.lit("")), F.length("text"))
    return docs.join(side, F.col("doc_id").eqNullSafe(F.col(_id)) & (th == F.col(_th)), "left_anti")
