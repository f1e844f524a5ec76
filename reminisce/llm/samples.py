"""Bounded samples of labelled documents, on which the classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def bounded(df: DataFrame, key: str, rows: int) -> DataFrame:
    """Up to `rows` rows of df: those of the smallest hashes of key, the same at every run and by one rule at every size.

    The hashes are spread evenly, so those beyond twice the share wanted needn't be sorted; should too few lie within it,
    all are.
    """
    place = F.xxhash64(key)
    n = df.count()
    if n > 2 * rows:
        near = df.filter(place < F.lit(-(2**63) + 2**64 * 2 * rows // n))
        df = near if near.count() >= rows else df
    return df.orderBy(place, key).limit(rows)


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """doc_id, text, y (the mean of its labels) of up to `rows` labelled documents that aren't held out.

    The sample is the labels of the smallest hashes of doc_id: the same at every run. Its size is what is broadcast,
    so the documents are not shuffled. Null labels and ids are left out.
    """
    known = labels.select("doc_id", F.col(label).cast("double").alias("y")).filter(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = bounded(known.groupBy("doc_id").agg(F.avg("y").alias("y")), "doc_id", rows)
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
