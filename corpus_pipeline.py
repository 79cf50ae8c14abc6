"""Corpus pipeline: language ID, near-dedup, benchmark decontamination, PII redaction, source mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the documents are written as Parquet in
the shared checkpoint folder and read again, so a lost executor repeats a part of one stage at most.

1. language_id: rows whose language is undetermined, or told with a score under 0.5, go.
2. near_dedup: one document of each SimHash group (three-word shingles, three bits) stays, the one with the smallest id.
3. decontamination: documents that hold any ten-word window of a benchmark item go.
4. pii: every personal span in the text is replaced by its kind; n_chars follows the new text.
5. mixing: documents are repeated to the capped target of their source; a row per repetition, one document a source cut.

Edge cases: null and blank texts have no language and go in the first stage, as does every text without a letter; rows
with a null id or source stay as long as their texts do, a null source being a source of its own; repeated rows fall into
one SimHash group, of which one row stays, ties going to the smallest id; an empty table gives an empty result, and an
empty benchmark leaves all documents clean; very long texts are read whole in every stage. Further columns are carried,
whatever they are called, but for those that the last stage adds or replaces (size, source_size, target, taken,
repetition, words).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm import decontaminate, langid, mixing, pii, simhash
from starloom.llm.common import table
from starloom.operators.checkpoints import scratch_folder


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars as the length of the text, where there is a text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(pii.redact(docs))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(mixing.repeat_rows(docs))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii_redaction), ("mixing", source_mixing)]

#: language identification and PII candidates are models, which SQL cannot express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
