"""Scans, lookups, filters and pages of conversations, messages and summaries."""

from __future__ import annotations

import base64
import json
import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reminisce.functions.text import one_line


def by_conversation(messages: DataFrame, conversation_id: int, after_seq: int = -1, limit: int | None = None) -> DataFrame:
    """Messages of a conversation after a seq, in order."""
    df = messages.filter((F.col("conversation_id") == conversation_id) & (F.col("seq") > after_seq)).orderBy("seq")
    return df if limit is None else df.limit(limit)


def last(messages: DataFrame, n: int) -> DataFrame:
    """The newest n messages of each conversation."""
    w = Window.partitionBy("conversation_id").orderBy(F.desc("seq"))
    return messages.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def newest(messages: DataFrame) -> DataFrame:
    """conversation_id, and id, role and identity hash of the newest message of each conversation."""
    pick = lambda c: F.max_by(c, "seq").alias(c)
    return messages.groupBy("conversation_id").agg(pick("message_id"), pick("role"), pick("identity_hash"))


def scope(df: DataFrame, conversation_ids: list[int] | None = None, conversation_id: int | None = None) -> DataFrame:
    """A list of conversations, finite and each once, wins over a single one; neither means all."""
    if conversation_ids:
        return df.filter(F.col("conversation_id").isin(sorted({int(x) for x in conversation_ids})))
    return df if conversation_id is None else df.filter(F.col("conversation_id") == conversation_id)


def between(time: Column, since: datetime | None = None, before: datetime | None = None) -> Column:
    """since <= time < before, each if given."""
    out = F.lit(True)
    if since is not None:
        out &= time >= F.lit(since)
    if before is not None:
        out &= time < F.lit(before)
    return out


def time_filter(after: str | None = None, before: str | None = None, between_: str | None = None, recency: str | None = None, as_of: datetime | None = None) -> tuple[datetime | None, datetime | None]:
    """(since, before) of the options: after and before, between as a..b, or recency as N and one of s, m, h, d, w."""
    given = [x for x in (between_, recency) if x]
    if len(given) > 1 or given and (after or before):
        raise ValueError("between, recency and after/before exclude each other")
    parse = lambda s: datetime.fromisoformat(s.replace("Z", "+00:00")).replace(tzinfo=None)
    if recency:
        m = re.fullmatch(r"(\d+)([smhdw])", recency)
        if not m or as_of is None or int(m[1]) <= 0:
            raise ValueError("recency is a number and a unit, as of a time")
        return as_of - timedelta(**{{"s": "seconds", "m": "minutes", "h": "hours", "d": "days", "w": "weeks"}[m[2]]: int(m[1])}), None
    if between_:
        after, _, before = between_.partition("..")
        if not after or not before:
            raise ValueError("between is a..b")
    low, high = parse(after) if after else None, parse(before) if before else None
    if low and high and low >= high:
        raise ValueError("the lower bound must be before the upper")
    return low, high


def encode_cursor(resource: str, timestamp: str, id_: object) -> str:
    return base64.urlsafe_b64encode(json.dumps({"v": 1, "resource": resource, "timestamp": timestamp, "id": id_}, separators=(",", ":")).encode()).decode().rstrip("=")


def decode_cursor(cursor: str, resource: str) -> tuple[str, object]:
    """(timestamp, id) of a cursor of this resource."""
    try:
        x = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        if x["v"] != 1 or x["resource"] != resource:
            raise ValueError("the cursor is of another resource")
        return x["timestamp"], x["id"]
    except (KeyError, TypeError, ValueError) as e:
        raise ValueError("invalid cursor") from e


def page(df: DataFrame, time: str, key: str, size: int, after: tuple | None = None) -> DataFrame:
    """size + 1 rows, newest first, after a (time, key): the extra row tells that more follow."""
    if after is not None:
        t, k = F.lit(after[0]).cast("timestamp"), F.lit(after[1])
        df = df.filter((F.col(time) < t) | ((F.col(time) == t) & (F.col(key) < k)))
    return df.orderBy(F.desc(time), F.desc(key)).limit(size + 1)


def message_list(messages: DataFrame, roles: list[str] | None = None, since: datetime | None = None, before: datetime | None = None) -> DataFrame:
    """Messages with a preview in place of the content."""
    df = messages.filter(between(F.col("created_at"), since, before))
    if roles:
        df = df.filter(F.col("role").isin(roles))
    return df.withColumn("preview", one_line(F.substring("content", 1, 1024))).drop("content")


def summary_list(summaries: DataFrame, edges: DataFrame, links: DataFrame) -> DataFrame:
    """Summaries with their numbers of sources, derived summaries and messages."""
    n = lambda df, key, name: df.groupBy(F.col(key).alias("summary_id")).agg(F.count(F.lit(1)).alias(name))
    out = summaries.join(n(edges, "derived_id", "source_count"), "summary_id", "left").join(n(edges, "source_id", "derived_count"), "summary_id", "left").join(n(links, "summary_id", "message_count"), "summary_id", "left")
    return out.fillna(0, ["source_count", "derived_count", "message_count"])


def resolve(conversations: DataFrame, session_key: str | None, session_id: str | None) -> DataFrame:
    """The conversation of a session: the active one of the key, else the newest of the id, active first."""
    by_key = conversations.filter(F.lit(session_key is not None) & (F.col("session_key") == F.lit(session_key)) & F.col("active")).withColumn("_by", F.lit(0))
    by_id = conversations.filter(F.col("session_id") == F.lit(session_id)).withColumn("_by", F.lit(1))
    return by_key.unionByName(by_id).orderBy("_by", F.desc("active"), F.desc("created_at"), F.desc("conversation_id")).limit(1).drop("_by")


def current(conversations: DataFrame) -> DataFrame:
    """Of each session key, or id where it has none, the active and newest conversation."""
    family = F.coalesce("session_key", "session_id")
    w = Window.partitionBy(family).orderBy(F.desc("active"), F.desc("created_at"), F.desc("conversation_id"))
    return conversations.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def families(conversations: DataFrame) -> DataFrame:
    """conversation_id, family (all conversations of its session, active first, newest first) and its size."""
    c = conversations.withColumn("family_key", F.coalesce("session_key", "session_id"))
    order = F.struct((~F.col("active")).alias("a"), (-F.unix_micros("created_at")).alias("t"), (-F.col("conversation_id")).alias("c"))
    f = c.groupBy("family_key").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: -x["c"]).alias("family"))
    return c.select("conversation_id", "family_key").join(f, "family_key").select("conversation_id", "family", F.size("family").cast("long").alias("family_size"))


def glob(pattern: str) -> str:
    """A session pattern as a regular expression: * stays within a segment, ** crosses colons."""
    return "^" + "".join(".*" if x == "**" else "[^:]*" if x == "*" else re.escape(x) for x in re.split(r"(\*\*|\*)", pattern) if x) + "$"


def matches_any(key: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out |= F.coalesce(key.rlike(glob(p)), F.lit(False))
    return out


def is_cron(key: Column) -> Column:
    """A key agent:X:cron:... of four segments or more."""
    parts = F.split(F.trim(key), ":")
    return F.coalesce((F.size(parts) >= 4) & (parts[0] == "agent") & (F.get(parts, F.lit(2)) == "cron"), F.lit(False))


def channel_scope(key: Column) -> Column:
    """The agent and channel of a key, without thread and memory suffixes; null for a key without a channel."""
    found = F.regexp_extract(key, r"^(.*:channel:[^:]+)(?::thread:[^:]+|:active-memory:[^:]+)*$", 1)
    return F.when(found != "", found)


def point(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.filter(F.col(key) == F.lit(value))


def missing_ids(incoming: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows of incoming whose key isn't stored."""
    return incoming.join(stored.select(key).filter(F.col(key).isNotNull()), key, "left_anti")


def tail_matches(messages: DataFrame, n: int, hashes: DataFrame) -> DataFrame:
    """Of each conversation's newest n rows, those whose identity is among the hashes: the window comes before the test."""
    return last(messages, n).join(hashes.select("identity_hash").distinct(), "identity_hash", "left_semi")
