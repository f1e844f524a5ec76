"""Finding what a prompt or question needs: recalled identifiers, candidate summaries by conversation, windows of rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Identifiers that name secrets, and texts that look like them.
SENSITIVE_NAME = r"(?i)(?:^|[^A-Za-z0-9])(?:ACCESS_?KEY|API_?KEY|AUTH|CREDENTIALS?|DEPLOY_?KEY|KEY|PASS(?:WORD)?|PRIVATE_?KEY|SECRET|TOKEN)(?=$|[^A-Za-z0-9])"
SENSITIVE_VALUE = r"(?i)(?:-----BEGIN [A-Z ]*PRIVATE KEY-----|\bAKIA[0-9A-Z]{16}\b|\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9_]{10,}\b|\bgithub_pat_[A-Za-z0-9_]{20,}\b|\bxox[baprs]-[A-Za-z0-9-]{10,}\b|\b(?:sk|rk|pk)-[A-Za-z0-9_-]{10,}\b|\b(?:sk|rk|pk)_[A-Za-z0-9_]{10,}\b)"
IDENTIFIER = r"\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\b"


def identifiers(prompt: str, limit: int = 4) -> list[str]:
    """Identifiers in capitals with underscores, each once, without those that name secrets."""
    return [x for x in dict.fromkeys(re.findall(IDENTIFIER, prompt)) if not re.search(SENSITIVE_NAME, x)][:limit]


def sensitive(text: Column) -> Column:
    return text.rlike(SENSITIVE_NAME) | text.rlike(SENSITIVE_VALUE)


def recall(messages: DataFrame, shown: DataFrame, prompt: str, per_identifier: int = 32, limit: int = 4, clip: int = 1200) -> DataFrame:
    """conversation_id, identifier, message_id, snippet: the newest sentences of users and assistants with an identifier of the prompt that the shown texts lack.

    Candidates are the newest messages of each conversation with the identifier, per_identifier at most; sentences that hold sensitive material go.
    """
    names = identifiers(prompt)
    if not names:
        return messages.select("conversation_id", F.lit("").alias("identifier"), "message_id", F.lit("").alias("snippet")).limit(0)
    # an identifier counts where no letter, digit or underscore stands beside it
    alone = lambda text: F.regexp_like(text, F.concat(F.lit(r"(?:^|[^A-Za-z0-9_])"), F.col("identifier"), F.lit(r"(?:$|[^A-Za-z0-9_])")))
    rows = messages.filter(F.col("role").isin("user", "assistant")).select("conversation_id", "message_id", "seq", "content", F.explode(F.array(*map(F.lit, names))).alias("identifier")).filter(F.contains("content", "identifier") & alone(F.col("content")))
    w = Window.partitionBy("conversation_id", "identifier").orderBy(F.desc("seq"))
    rows = rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per_identifier)
    line = F.element_at(F.filter(F.split("content", "\n"), alone), 1)
    sentence = F.element_at(F.filter(F.split(line, r"(?<=[.!?])\s+"), alone), 1)
    rows = rows.withColumn("snippet", F.substring(F.trim(F.regexp_replace(sentence, r"\s+", " ")), 1, clip)).filter(~sensitive(F.col("snippet")))
    covered = rows.select("conversation_id", "identifier").distinct().join(shown.select("conversation_id", F.col("content").alias("s")), "conversation_id").filter(alone(F.col("s"))).select("conversation_id", "identifier").distinct()
    rows = rows.join(covered, ["conversation_id", "identifier"], "left_anti")
    order = Window.partitionBy("conversation_id").orderBy(F.desc("seq"), "identifier")
    return rows.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= limit).select("conversation_id", "identifier", "message_id", "snippet")


def candidates(explicit: DataFrame, summary_hits: DataFrame, message_leaves: DataFrame) -> DataFrame:
    """conversation_id, summary_id, explicit, by_message, matched_at: summaries named, found, or reached from found messages, each once."""
    arm = lambda df, e, m: df.select("conversation_id", "summary_id", F.lit(e).alias("e"), F.lit(m).alias("m"), "matched_at")
    both = arm(explicit, True, False).unionByName(arm(summary_hits, False, False)).unionByName(arm(message_leaves, False, True))
    return both.groupBy("conversation_id", "summary_id").agg(F.bool_or("e").alias("explicit"), F.bool_or("m").alias("by_message"), F.max("matched_at").alias("matched_at"))


def buckets(found: DataFrame) -> DataFrame:
    """Conversations of candidates, ranked: named ones, then number, newest match, message-backed ones, id."""
    g = found.groupBy("conversation_id").agg(F.count_if("explicit").alias("explicit_count"), F.count(F.lit(1)).alias("candidate_count"), F.max("matched_at").alias("newest_at"), F.count_if("by_message").alias("message_count"))
    w = Window.orderBy(F.desc("explicit_count"), F.desc("candidate_count"), F.desc("newest_at"), F.desc("message_count"), "conversation_id")  # a row for each conversation found
    return g.withColumn("rank", F.row_number().over(w).cast("long"))


def window(messages: DataFrame, conversation_id: int, size: int, before: int | None = None, after: int | None = None) -> DataFrame:
    """A window of a conversation's messages, the latest or beside a seq, with whether older and newer ones exist."""
    m = messages.filter(F.col("conversation_id") == conversation_id)
    part = m if before is None else m.filter(F.col("seq") < before)
    part = part if after is None else part.filter(F.col("seq") > after)
    rows = part.orderBy(F.asc("seq") if after is not None else F.desc("seq")).limit(size)
    ends = rows.agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    more = m.join(F.broadcast(ends)).agg(F.coalesce(F.bool_or(F.col("seq") < F.col("lo")), F.lit(False)).alias("has_older"), F.coalesce(F.bool_or(F.col("seq") > F.col("hi")), F.lit(False)).alias("has_newer"))
    return rows.join(F.broadcast(more))


def session_lookup(conversations: DataFrame, sessions: DataFrame) -> DataFrame:
    """session_id, session_key, conversation_id: by key without a topic suffix, else by id; the newest conversation of several."""
    k = conversations.filter("session_key is not null").groupBy("session_key").agg(F.max("conversation_id").alias("by_key"))
    i = conversations.groupBy("session_id").agg(F.max("conversation_id").alias("by_id"))
    s = sessions.withColumn("_key", F.regexp_replace("session_key", r":topic:[^:]+$", ""))
    j = s.join(k.withColumnRenamed("session_key", "_key"), "_key", "left").join(i, "session_id", "left")
    return j.select("session_id", "session_key", F.coalesce("by_key", "by_id").alias("conversation_id"))


def duplicated_elsewhere(summaries: DataFrame, targets: DataFrame) -> DataFrame:
    """summary_id of summaries whose content one of the target conversations holds already."""
    digest = F.sha2("content", 256)
    have = summaries.join(targets.select("conversation_id"), "conversation_id", "left_semi").select(digest.alias("d")).distinct()
    rest = summaries.join(targets.select("conversation_id"), "conversation_id", "left_anti").withColumn("d", digest)
    return rest.join(have, "d", "left_semi").select("summary_id")


def duplicated_anywhere(summaries: DataFrame) -> DataFrame:
    """summary_id of summaries whose content another conversation holds too."""
    digested = summaries.withColumn("d", F.sha2("content", 256))
    shared = digested.groupBy("d").agg(F.min("conversation_id").alias("a"), F.max("conversation_id").alias("b")).filter("a <> b").select("d")
    return digested.join(shared, "d", "left_semi").select("summary_id")
