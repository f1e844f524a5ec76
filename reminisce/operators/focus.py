"""Focus briefs: one active brief stands for a conversation's covered summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def create(briefs: DataFrame, new: DataFrame) -> DataFrame:
    """briefs with new ones; drafts and active ones of their conversations are superseded."""
    replaced = briefs.join(new.select("conversation_id").distinct().withColumn("_n", F.lit(True)), "conversation_id", "left")
    status = F.when(F.col("_n") & F.col("status").isin("draft", "active"), "superseded").otherwise(F.col("status"))
    return replaced.withColumn("status", status).select(*briefs.columns).unionByName(new.select(*briefs.columns))


def active(briefs: DataFrame) -> DataFrame:
    """The newest active brief of each conversation."""
    w = Window.partitionBy("conversation_id").orderBy(F.desc("created_at"), F.desc("brief_id"))
    return briefs.filter("status = 'active'").withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def deactivate(briefs: DataFrame, conversations: DataFrame) -> DataFrame:
    """briefs where the active ones of these conversations are inactive."""
    j = briefs.join(conversations.select("conversation_id").distinct().withColumn("_n", F.lit(True)), "conversation_id", "left")
    return j.withColumn("status", F.when(F.col("_n") & (F.col("status") == "active"), "inactive").otherwise(F.col("status"))).select(*briefs.columns)


def drift(briefs: DataFrame, messages: DataFrame, summaries: DataFrame, hashes: DataFrame) -> DataFrame:
    """brief_id and what came after it: messages after its seq, summaries after its time, whether its sources changed, and whether it is stale."""
    m = briefs.join(messages.select("conversation_id", "seq", "token_count"), "conversation_id").filter(F.col("seq") > F.col("covered_message_seq")).groupBy("brief_id").agg(F.count(F.lit(1)).alias("messages"), F.sum("token_count").alias("message_tokens"))
    s = briefs.select("brief_id", "conversation_id", F.coalesce("covered_latest_at", "created_at").alias("since")).join(summaries.select("conversation_id", "latest_at", F.col("token_count").alias("t")), "conversation_id").filter(F.col("latest_at") > F.col("since")).groupBy("brief_id").agg(F.count(F.lit(1)).alias("summaries"), F.sum("t").alias("summary_tokens"))
    j = briefs.select("brief_id", "conversation_id", "source_context_hash").join(m, "brief_id", "left").join(s, "brief_id", "left").join(hashes, "conversation_id", "left").fillna(0, ["messages", "message_tokens", "summaries", "summary_tokens"])
    changed = (F.trim("source_context_hash") != "") & (F.coalesce("source_hash", F.lit("")) != "") & (F.col("source_hash") != F.col("source_context_hash"))
    return j.select("brief_id", "messages", "summaries", (F.col("message_tokens") + F.col("summary_tokens")).alias("tokens"), changed.alias("changed"), ((F.col("messages") > 0) | (F.col("summaries") > 0) | changed).alias("stale"))


def targets(tokens: int, share: float = 0.1, least: int = 400, most: int = 4000) -> int:
    """Tokens that a new brief may take, from those it stands for."""
    return max(least, min(most, int(tokens * share)))
