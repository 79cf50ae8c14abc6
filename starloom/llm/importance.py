"""Target-distribution importance resampling with a dictionary of distinct features.

Features are word n-grams, hashed to buckets; a bucket's gain is the log ratio of its share in the target texts to its
share in the raw documents, and a document's weight the sum of the gains of its features. Documents are drawn without
replacement by the Gumbel trick: seeded noise is added to the weight and the highest scores are taken.

Every n-gram string is counted globally first, with partial counts in every task; each distinct string of that
dictionary is hashed once, and buckets are sums over the dictionary. Gains then go back to the strings, and the strings
back to the feature counts of each document: the most frequent strings (counted to be at most ``hot_rows``, none longer
than ``hot_bytes``) are broadcast and looked up where the document is read, and only the others, each of which is rare,
are joined by a shuffle on the string. No string that many documents hold is ever a join key. Ranks come from range
partitions of the scores and the sizes of those partitions.

Edge cases: a null text has no words, weight 0 and no rank; a null id counts as the empty text in the noise and comes
after every other id in a tie; repeated rows are documents of their own, ranked one after the other; an empty target
makes gains negative or zero, which is no special case; an empty table of documents gives an empty result; very long
texts are one document in one task and are counted whole. Further columns of either input are ignored, whatever they
are called.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import frequent, map_arrow, reliable, unused
from starloom.operators.tables import row_index

BUCKETS = 10_000
SEED = 2024
#: ASCII bytes that are no letter or digit end a word; A-Z are lower-cased; all bytes beyond ASCII belong to words
FOLD = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(FOLD).split() if text else []


def features_of(words: list[bytes], ngram: int) -> list[bytes]:
    """All runs of 1 to ``ngram`` consecutive words, joined by one space."""
    found = words
    for n in range(2, ngram + 1):
        found = found + [*map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))]
    return found


def feature_counts(texts: DataFrame, ngram: int, held: int = 200_000) -> DataFrame:
    """(feature, n): partial counts of the features of column ``text``; a task holds about ``held`` strings at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def drain() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["feature", "n"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                counts.update(features_of(words_of(text.as_py()), ngram))
                if len(counts) >= held:
                    yield drain()
        yield drain()

    return texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "feature binary, n long")


def dictionary(docs: DataFrame, target: DataFrame, ngram: int, buckets: int) -> DataFrame:
    """(feature, s, t, bucket): every distinct feature with its number in the documents and in the target texts."""
    nothing = F.lit(0).cast("long")
    both = feature_counts(docs, ngram).select("feature", F.col("n").alias("s"), nothing.alias("t"))
    both = both.unionByName(feature_counts(target, ngram).select("feature", nothing.alias("s"), F.col("n").alias("t")))
    return both.groupBy("feature").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).withColumn("bucket", F.crc32("feature") % buckets)


def bucket_gains(entries: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of at most ``buckets`` rows from the dictionary."""
    sums = reliable(entries.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))
    total = sums.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    ratio = (F.col("t") + 1.0) * F.lit(float(total["s"] + buckets)) / ((F.col("s") + 1.0) * F.lit(float(total["t"] + buckets)))
    return sums.select("bucket", F.floor(1000.0 * F.log(ratio)).cast("long").alias("gain"))


def noise(doc_id: Column, seed: int) -> Column:
    """Seeded Gumbel noise in thousandths, rounded down."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000.0 * F.log(-F.log(u))).cast("long")


def _looked_up(gains: dict[bytes, int], ngram: int) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """Per document: its numbers of words and features, the weight of the features in ``gains``, and the other features."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("feature", pa.binary()), ("n", pa.int64())]))]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        for text in batch.column(1):
            words = words_of(text.as_py())
            counts = Counter(features_of(words, ngram))
            weight, rest = 0, []
            for f, n in counts.items():
                gain = gains.get(f)
                if gain is None:
                    rest.append((f, n))
                else:
                    weight += gain * n
            rows.append((len(words), counts.total(), weight, rest))
        columns = zip(*rows, strict=True) if rows else ([],) * 4
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_words", "n_features", "weight", "rest"])

    return step


def weights(docs: DataFrame, target: DataFrame, ngram: int = 1, buckets: int = BUCKETS, hot_rows: int = 150_000, hot_bytes: int = 64) -> DataFrame:
    """doc_id, n_words, n_features, weight: one row per row of ``docs``."""
    entries = reliable(dictionary(docs, target, ngram, buckets))
    entries = entries.join(F.broadcast(bucket_gains(entries, buckets)), "bucket")
    short = F.octet_length("feature") <= hot_bytes
    often = short & frequent(entries.where(short), F.col("s"), hot_rows)
    known = docs.sparkSession.sparkContext.broadcast({bytes(f): g for f, g in entries.where(often).select("feature", "gain").collect()})
    read = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = map_arrow(read, lambda: _looked_up(known.value, ngram), f"doc_id {kind}, n_words long, n_features long, weight long, rest array<struct<feature:binary,n:long>>")
    rows = reliable(rows.withColumn("row", F.monotonically_increasing_id()))
    rare = entries.where(~often).select("feature", "gain")
    rest = rows.select("row", F.explode("rest").alias("f")).select("row", "f.feature", "f.n").join(rare, "feature").groupBy("row").agg(F.sum(F.col("n") * F.col("gain")).alias("more"))
    return rows.drop("rest").join(rest, "row", "left").select("doc_id", "n_words", "n_features", (F.col("weight") + F.coalesce("more", F.lit(0))).alias("weight"), "row")


def resample(docs: DataFrame, target: DataFrame, ngram: int = 1, buckets: int = BUCKETS, min_words: int = 20, percent: int = 10, seed: int = SEED, **options) -> DataFrame:
    """doc_id, n_features, weight, score, rank: rank is null for documents that are not drawn.

    Of the documents with at least ``min_words`` words, ``percent`` in a hundred (rounded down) are drawn.
    """
    scored = weights(docs, target, ngram, buckets, **options).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("fit", F.col("n_words") >= min_words)
    placed = row_index(scored, [F.col("fit").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")], name="place")
    drawn = placed.where("fit").count() * percent // 100
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank"))


def draw(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents themselves with rank and score: ``docs`` joined with the ranks on the id, which has to be unique."""
    _id = unused(docs, "id")[0]
    picked = resample(docs, target, **options).where("rank IS NOT NULL").select(F.col("doc_id").alias(_id), "rank", "score")
    keep = [c for c in docs.columns if c.lower() not in ("rank", "score")]
    return docs.select(*keep).join(picked, F.col("doc_id") == F.col(_id)).drop(_id)
