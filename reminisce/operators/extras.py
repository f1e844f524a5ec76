"""Smaller operators: imports, confined reads, filters on parts, shared caps, depth chunks, rewrites, scopes and rollovers."""

from __future__ import annotations

from datetime import datetime
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reminisce.functions.text import estimate_tokens
from reminisce.operators import dag
from reminisce.operators.compact import Store


def bulk_import(entries: DataFrame, known_files: DataFrame, apply: bool) -> tuple[DataFrame, DataFrame]:
    """(file, messages, status) of each transcript, and the rows to store: none of files known already, none at all unless applied."""
    n = entries.filter("accepted").groupBy("file").agg(F.count(F.lit(1)).alias("messages"))
    files = entries.select("file").distinct().join(n, "file", "left").join(known_files.select("file").distinct().withColumn("_k", F.lit(True)), "file", "left")
    status = F.when(F.col("_k"), "known").when(F.col("messages").isNull(), "empty").when(F.lit(apply), "imported").otherwise("would import")
    report = files.select("file", F.coalesce("messages", F.lit(0)).alias("messages"), status.alias("status"))
    rows = entries.filter("accepted").join(report.filter("status = 'imported'").select("file"), "file", "left_semi")
    return report, rows


def confined(files: DataFrame, root: str) -> DataFrame:
    """Files whose path, without any `..`, lies below the root."""
    path = F.regexp_replace("storage_uri", r"^file:(//)?", "")
    return files.filter(path.startswith(root.rstrip("/") + "/") & ~path.rlike(r"(^|/)\.\.(/|$)"))


def payload(files: DataFrame, messages: DataFrame) -> DataFrame:
    """file_id, content: a file's own content, or that of the message which points to it."""
    m = messages.filter(F.col("large_content").startswith("file_")).groupBy(F.col("large_content").alias("file_id")).agg(F.min_by("content", "seq").alias("mc"))
    return files.join(m, "file_id", "left").select("file_id", F.coalesce("content", "mc").alias("content"))


def same_payload(files: DataFrame) -> DataFrame:
    """file_id, same_as: the smallest id of the files with equal contents, by size and SHA-256; a row a file, however many are equal."""
    keyed = files.select("file_id", F.octet_length("content").alias("size"), F.sha2("content", 256).alias("digest"))
    first = keyed.groupBy("size", "digest").agg(F.min("file_id").alias("same_as"))
    on = keyed["size"].eqNullSafe(F.col("s")) & keyed["digest"].eqNullSafe(F.col("d"))
    return keyed.join(first.select(F.col("size").alias("s"), F.col("digest").alias("d"), "same_as"), on).select("file_id", "same_as")


def newest_reasoned(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """conversation_id, reasoned: whether the newest message has a reasoning part, by type or by its metadata."""
    last = messages.groupBy("conversation_id").agg(F.max_by("message_id", "seq").alias("message_id"))
    thinks = parts.filter((F.col("part_type") == "reasoning") | F.coalesce(F.get_json_object("metadata", "$.type").isin("thinking", "reasoning"), F.lit(False))).select("message_id").distinct().withColumn("_t", F.lit(True))
    return last.join(thinks, "message_id", "left").select("conversation_id", F.coalesce("_t", F.lit(False)).alias("reasoned"))


def storable(messages: DataFrame, roles: tuple[str, ...] = ("system", "user", "assistant", "tool")) -> DataFrame:
    """messages without blank assistant rows that failed or were aborted (stop_reason) and roles that aren't stored."""
    failed = (F.col("role") == "assistant") & (F.trim(F.coalesce("content", F.lit(""))) == "") & F.coalesce(F.col("stop_reason").isin("error", "aborted"), F.lit(False))
    return messages.filter(F.col("role").isin(*roles) & ~failed)


def covered_messages(store: Store) -> DataFrame:
    """summary_id, last_seq of each summary in a context, null without messages of its own."""
    s = store.context_items.filter("summary_id is not null").select("summary_id")
    return s.join(store.summary_messages, "summary_id", "left").join(store.messages.select("message_id", "seq"), "message_id", "left").groupBy("summary_id").agg(F.max("seq").alias("last_seq"))


def markers_by_conversation(marked: DataFrame, kinds: list[str]) -> DataFrame:
    """conversation_id and how many summaries bear each kind of marker."""
    return marked.filter("marker is not null").groupBy("conversation_id").pivot("marker", kinds).count().fillna(0)


def expand_sharing(store: Store, roots: DataFrame, token_cap: int, max_depth: int | None = None) -> DataFrame:
    """request, place, root, node, token_count: several roots of a request (request, position, summary_id) expanded one after another under one cap."""
    tokens = store.summaries.select(F.col("summary_id").alias("node"), "token_count")
    below = dag.walk(store.summary_edges, roots.select("summary_id").distinct(), max_depth, tokens=tokens, token_cap=token_cap).filter("level > 0").join(tokens, "node")
    j = roots.withColumnRenamed("summary_id", "root").join(below, "root")
    w = Window.partitionBy("request").orderBy("position", "places")
    j = j.withColumn("cum", F.sum("token_count").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(w).cast("long"))
    return j.filter(F.col("cum") <= token_cap).select("request", "place", "root", "node", "token_count")


def summary_ids(text: str) -> list[str]:
    """Summary ids named in a text: bare, in brackets or as references; each once."""
    return list(dict.fromkeys(re.findall(r"\bsum_[a-f0-9]{16}\b", text.lower())))


def depth_chunk(items: DataFrame, summaries: DataFrame, depth: int, budget: int) -> DataFrame:
    """conversation_id, ordinal, summary_id of the oldest run of a depth in each context, ended by another item or the budget; the first always."""
    j = items.join(summaries.select("summary_id", "depth", F.col("token_count").alias("t")), "summary_id", "left")
    w = Window.partitionBy("conversation_id").orderBy("ordinal")
    j = j.withColumn("_in", F.coalesce(F.col("depth") == depth, F.lit(False)))
    j = j.withColumn("_run", F.sum(F.when(F.col("_in") & ~F.coalesce(F.lag("_in").over(w), F.lit(False)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = j.filter(F.col("_in") & (F.col("_run") == 1))
    before = F.coalesce(F.sum("t").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # sums only grow, so what fails the test ends the chunk; reaching the budget ends it too
    return run.withColumn("_b", before).filter((F.col("_b") == 0) | ((F.col("_b") + F.col("t") <= budget) & (F.col("_b") < budget))).select("conversation_id", "ordinal", "summary_id")


def rewritten(summaries: DataFrame, contents: DataFrame) -> DataFrame:
    """summaries with new contents (summary_id, new_content) and their token counts."""
    j = summaries.join(contents, "summary_id", "left")
    return j.withColumn("content", F.coalesce("new_content", "content")).withColumn("token_count", F.when(F.col("new_content").isNotNull(), estimate_tokens(F.col("new_content"))).otherwise(F.col("token_count"))).select(*summaries.columns)


def serialized_tokens(content: Column, least: int = 4096, opaque: int = 1600) -> Column:
    """Tokens of serialised content where long base64 strings count a fixed number each."""
    pattern = f"[A-Za-z0-9+/=_-]{{{least},}}"
    return estimate_tokens(F.regexp_replace(content, pattern, "")) + F.regexp_count(content, F.lit(pattern)) * opaque


def granted(df: DataFrame, grants: DataFrame, as_of: str) -> DataFrame:
    """Rows of conversations that a grant (conversation_id, expires_at) still covers."""
    return df.join(grants.filter(F.col("expires_at") > F.lit(as_of).cast("timestamp")).select("conversation_id").distinct(), "conversation_id", "left_semi")


def prompt_time(time: Column, zone: str) -> Column:
    """A UTC time in a zone, with the zone's abbreviation at its offset then; the zone's name where no abbreviation is known."""
    local = F.from_utc_timestamp(time, zone)
    try:
        info = ZoneInfo(zone)
        days = [datetime(year, month, 15, tzinfo=info) for year in range(1972, 2038) for month in (1, 7)]
        names = {int(x.utcoffset().total_seconds()): x.tzname() for x in days}
    except (ZoneInfoNotFoundError, ValueError):
        names = {}
    offset = F.unix_seconds(local) - F.unix_seconds(time)
    known = F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), offset.cast("int")) if names else F.lit(None).cast("string")
    return F.concat(F.date_format(local, "yyyy-MM-dd HH:mm "), F.coalesce(known, F.lit(zone)))


def body(content: Column) -> Column:
    """A user's text without a leading time in brackets and a leading block of conversation metadata."""
    text = F.regexp_replace(content, r"(?s)^Conversation info \(untrusted metadata\):\s*```json\s.*?```\s*", "")
    return F.regexp_replace(text, r"^\[(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)?\s*\d{4}-\d{2}-\d{2} \d{2}:\d{2}(?::\d{2})?(?: [A-Za-z0-9+:/_-]+)?\]\s*", "")


def rollover(stored: DataFrame, incoming: DataFrame, tail: int = 3) -> DataFrame:
    """conversation_id, verdict: `continuation` if incoming holds a stored tail row, `fresh` if it is newer and shares no identity, else `ambiguous`."""
    w = Window.partitionBy("conversation_id").orderBy(F.desc("seq"))
    s = stored.withColumn("_r", F.row_number().over(w))
    ends = s.filter(F.col("_r") <= tail).select("conversation_id", "identity_hash").distinct()
    anchors = incoming.join(ends, ["conversation_id", "identity_hash"], "left_semi").groupBy("conversation_id").agg(F.count(F.lit(1)).alias("anchors"))
    shared = incoming.join(stored.select("conversation_id", "identity_hash").distinct(), ["conversation_id", "identity_hash"], "left_semi").groupBy("conversation_id").agg(F.count(F.lit(1)).alias("shared"))
    times = incoming.groupBy("conversation_id").agg(F.min("created_at").alias("first_at")).join(stored.groupBy("conversation_id").agg(F.max("created_at").alias("last_at")), "conversation_id")
    j = times.join(anchors, "conversation_id", "left").join(shared, "conversation_id", "left").fillna(0, ["anchors", "shared"])
    return j.select("conversation_id", F.when(F.col("anchors") > 0, "continuation").when((F.col("shared") == 0) & (F.col("first_at") > F.col("last_at")), "fresh").otherwise("ambiguous").alias("verdict"))


def backfilled_hashes(messages: DataFrame, hash_of: Column) -> DataFrame:
    """messages whose missing identity hash is computed."""
    return messages.withColumn("identity_hash", F.coalesce("identity_hash", hash_of))


def decorated_matches(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """message_id, index: incoming user rows that equal a stored one but for injected times and metadata, k-th to k-th."""
    w = lambda o: Window.partitionBy("conversation_id", "face").orderBy(o)
    s = stored.filter("role = 'user'").withColumn("face", F.trim(body(F.col("content")))).withColumn("k", F.row_number().over(w("seq"))).select("conversation_id", "face", "k", "message_id")
    i = incoming.filter("role = 'user'").withColumn("face", F.trim(body(F.col("content")))).withColumn("k", F.row_number().over(w("index"))).select("conversation_id", "face", "k", "index")
    return s.join(i, ["conversation_id", "face", "k"]).select("message_id", "index")


def status_change(briefs: DataFrame, ids: list[str], status: str) -> DataFrame:
    return briefs.withColumn("status", F.when(F.col("brief_id").isin(ids), status).otherwise(F.col("status")))


def volatile(content: Column) -> Column:
    """Whether a live input is made by the host for one turn: internal context, or a prompt to try again."""
    low = F.lower(F.trim(content))
    return low.startswith("[internal context]") | low.rlike(r"^(?:please )?(?:continue|retry|try again)\b.{0,80}$")
