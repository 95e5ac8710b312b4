"""The corpus pipeline: toxicity, quality, near-duplicates, mix, encoding; each stage's table is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidencelake.llm import minhash, mixing, quality_model, sentencepiece, toxicity
from evidencelake.llm.common import materialize

#: SQL can express neither the learnt models nor the schedule; the stages are tested against brute force in tests/llm.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity classifier doesn't reject, each judged by its own text.

    Null and repeated doc_ids play no part; null and empty texts are judged as texts without hits; an empty table gives an empty one.
    """
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier accepts, each judged by its own text.

    Null and repeated doc_ids play no part; null and empty texts are judged as texts without words; an empty table gives an empty one.
    """
    return quality_model.keep_accepted(docs, quality_model.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8 or more), that with the smallest doc_id.

    Rows without doc_id and texts without words stay; rows that repeat a doc_id are judged by their own texts; an empty table
    gives an empty one.
    """
    return minhash.keep_first(docs, percent=80).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, in its order, once for each pass over their source in which it takes words of them.

    Rows with null or repeated doc_ids are mixed as the rows they are; rows without words are never taken; null sources are
    one source; an empty table gives an empty one.
    """
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids, round_trip of every row of the mix; null and empty texts have no ids, null doc_ids stay null; an empty table gives an empty one."""
    return sentencepiece.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_low_quality),
    ("minhash near-dedup", drop_near_duplicates),
    ("source mixing", mix_sources),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
