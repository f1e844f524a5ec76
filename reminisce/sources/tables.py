"""The canonical tables, seen through the files of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reminisce.functions.text import estimate_tokens, identity_hash

#: Message ids leave room for this many messages of a conversation, so they need no global order.
IDS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of `conversations`. Times are made up: an hour a conversation from 2024-01-01, a minute a turn."""
    c = table(spark, sf_dir, "conversations")
    seq = F.col("turn") + 1
    return c.select(
        (F.col("conv_id") * IDS + seq).alias("message_id"), F.col("conv_id").alias("conversation_id"), seq.alias("seq"), "role", F.col("text").alias("content"),
        estimate_tokens(F.col("text")).alias("token_count"), identity_hash(F.col("role"), F.col("text")).alias("identity_hash"),
        F.timestamp_add("MINUTE", F.col("conv_id") * 60 + F.col("turn"), F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("created_at"),
    )


def large_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as stored files: text by source, a file id from the document's id."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("file_"), F.substring(F.md5(F.col("doc_id").cast("string")), 1, 16)).alias("file_id"), "doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"),
        F.when(F.col("doc_id") % 10 == 9, "application/octet-stream").when(F.col("doc_id") % 10 == 8, F.lit(None)).otherwise("text/plain").alias("mime_type"),
        F.octet_length("text").cast("long").alias("byte_size"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("line_count"), F.col("text").alias("content"),
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a conversation, with made-up sessions: three of four share a key by customer, every fifth is archived."""
    m = messages(spark, sf_dir)
    c = F.col("conversation_id")
    return m.groupBy("conversation_id").agg(F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at")).select(
        "conversation_id", F.concat(F.lit("session-"), c.cast("string")).alias("session_id"),
        F.when(c % 4 == 3, F.lit(None)).when(c % 7 == 0, F.concat(F.lit("agent:main:cron:"), c.cast("string"))).when(c % 7 == 1, F.concat(F.lit("agent:main:subagent:"), c.cast("string"))).otherwise(F.concat(F.lit("agent:main:channel:"), (c % 12).cast("string"))).alias("session_key"),
        (c % 5 != 0).alias("active"), "created_at", "updated_at",
    )
