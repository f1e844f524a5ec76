"""The queries opN_<name> over the tables of a folder, and their SQL where it can express them."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from reminisce.llm import licenses, linededup, media, mixing, neighbours, ngramjoin, pieces, quality, secrets, toxicity
from reminisce.llm.common import small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.passages(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), pieces.Pieces.load())


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "source", "n_tokens", "weight", "copies")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "text_id", "n_links", "n_texts")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.grade(docs.select("doc_id", "text"), toxicity.fit(docs, _table(spark, sf_dir, "labels"))).drop("text")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_table(spark, sf_dir, "embeddings"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs.select("doc_id", "text"), quality.fit(docs, _table(spark, sf_dir, "labels"))).drop("text")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(docs))


def queries() -> dict:
    return {"op1_line_dedup": op1_line_dedup, "op2_pieces": op2_pieces, "op3_licenses": op3_licenses, "op4_mixing": op4_mixing, "op5_ngram_join": op5_ngram_join, "op6_toxicity": op6_toxicity, "op7_neighbours": op7_neighbours, "op8_media": op8_media, "op9_quality": op9_quality, "op10_secrets": op10_secrets, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": mixing.SQL}
