"""From documents to training tokens: five stages, each written as Parquet and read again by the next.

1. quality: documents that the quality classifier rejects go.
2. lines: later copies of passages of 50 words or more are deleted from the texts.
3. near duplicates: one document of each class of similar ones stays.
4. mixture: sources are repeated or thinned towards their target weights.
5. tokens: texts become piece ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reminisce.llm import linededup, mixing, ngramjoin, pieces, quality
from reminisce.llm.common import cut, small_batches


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of at least 0.3, by a model fitted on labels of documents that aren't held out."""
    small_batches(spark)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accept(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of passages, and their new n_chars. Every document stays, some with an empty text."""
    small_batches(spark)
    return linededup.passages(docs, counted=None).withColumn("n_chars", F.length("text").cast("long"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: five-word shingles, Jaccard similarity 0.8 or more."""
    small_batches(spark)
    return ngramjoin.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture that fills as many tokens as there are, no source repeated more than 1.25 times."""
    small_batches(spark)
    return mixing.mixture(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, ids, n_tokens and round_trip of each row."""
    small_batches(spark)
    return pieces.encode(docs, pieces.Pieces.load())


STAGES = [("quality", keep_quality), ("line dedup", drop_repeated_lines), ("near duplicates", keep_one_of_each), ("mixture", mix_sources), ("tokens", to_tokens)]

#: A trained classifier, MinHash and piece encoding are not for SQL to express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stages make of the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
