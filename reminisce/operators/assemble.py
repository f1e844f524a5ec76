"""What a model is shown: contexts within a budget, rendered summaries, overlays, stubs, tool pairs, live inputs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reminisce.functions.text import estimate_tokens, occurrences
from reminisce.operators import dag, status, tail
from reminisce.operators.compact import Store


def _attribute(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def render(store: Store) -> DataFrame:
    """summary_id, xml: each summary as an element with its attributes, references to its sources and escaped content."""
    refs = store.summary_edges.groupBy(F.col("derived_id").alias("summary_id")).agg(F.array_sort(F.collect_list(F.struct("ordinal", "source_id"))).alias("refs"))
    s = store.summaries.join(refs, "summary_id", "left")
    when = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    head = F.concat(
        F.lit('<summary id="'), _attribute(F.col("summary_id")), F.lit('" kind="'), F.col("kind"), F.lit('" depth="'), F.col("depth").cast("string"), F.lit('" descendant_count="'), F.col("descendant_count").cast("string"), F.lit('" trust="untrusted"'),
        F.when(F.col("earliest_at").isNotNull(), F.concat(F.lit(' earliest_at="'), when("earliest_at"), F.lit('"'))).otherwise(""),
        F.when(F.col("latest_at").isNotNull(), F.concat(F.lit(' latest_at="'), when("latest_at"), F.lit('"'))).otherwise(""), F.lit(">"),
    )
    sources = F.when(F.size("refs") > 0, F.concat(F.lit("\n  <parents>\n"), F.array_join(F.transform("refs", lambda r: F.concat(F.lit('    <summary_ref id="'), r["source_id"], F.lit('" />'))), "\n"), F.lit("\n  </parents>"))).otherwise("")
    return s.select("summary_id", F.concat(head, F.when(F.col("kind") == "condensed", sources).otherwise(""), F.lit("\n  <content>\n"), _escaped(F.col("content")), F.lit("\n  </content>\n</summary>")).alias("xml"))


def assemble(store: Store, budget: int, n: int, cap: int | None = None) -> DataFrame:
    """Context items that fit: the protected tail, and of the rest the newest up to the first that doesn't fit."""
    r = status.resolved_context(store).withColumn("seq", F.col("ordinal"))
    return tail.split_budget(r, budget, n, cap).filter("selected").select("conversation_id", "ordinal", "item_type", "message_id", "summary_id", "token_count", "in_tail")


def overlay(store: Store, watermark: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Context items where the summaries up to a conversation's watermark (conversation_id, covered_seq, brief_id) are one item, at the first's place."""
    reach = dag.reachable(store, max_depth).select("summary_id", F.col("last_seq").alias("max_seq"))
    items = store.context_items.join(reach, "summary_id", "left").join(watermark, "conversation_id", "left").withColumn("covered", F.coalesce(F.col("max_seq") <= F.col("covered_seq"), F.lit(False)))
    first = items.filter("covered").groupBy("conversation_id", "brief_id").agg(F.min("ordinal").alias("ordinal")).select("conversation_id", "ordinal", F.lit("focus_brief").alias("item_type"), F.lit(None).cast("long").alias("message_id"), F.col("brief_id").alias("summary_id"))
    return items.filter("not covered").select("conversation_id", "ordinal", "item_type", "message_id", "summary_id").unionByName(first)


def watermarks(store: Store, summary_ids: DataFrame, max_depth: int | None = None) -> DataFrame:
    """summary_id, covered_latest_at, covered_message_seq over all that the summary reaches."""
    nodes = dag.closure(store.summary_edges, summary_ids, max_depth=max_depth).select(F.col("root").alias("summary_id"), "node")
    t = nodes.join(store.summaries.select(F.col("summary_id").alias("node"), "latest_at"), "node").groupBy("summary_id").agg(F.max("latest_at").alias("covered_latest_at"))
    q = nodes.join(store.summary_messages.withColumnRenamed("summary_id", "node"), "node").join(store.messages.select("message_id", "seq"), "message_id").groupBy("summary_id").agg(F.max("seq").alias("covered_message_seq"))
    return t.join(q, "summary_id", "left")


def source_hash(store: Store) -> DataFrame:
    """conversation_id, source_hash: a digest of its context's items in order."""
    x = store.context_items.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", F.coalesce(F.col("message_id").cast("string"), F.col("summary_id")).alias("v")))).alias("x"))
    return x.select("conversation_id", F.sha2(F.array_join(F.transform("x", lambda i: i["v"]), "|"), 256).alias("source_hash"))


def stub(rows: DataFrame) -> DataFrame:
    """rows (content, role, large_content, in_tail) where tool results outside the tail that were stored as files are their reference."""
    stored = (F.col("role") == "tool") & ~F.col("in_tail") & F.col("large_content").startswith("file_")
    return rows.withColumn("content", F.when(stored, F.concat(F.lit("[Stored tool result: "), F.col("large_content"), F.lit("]"))).otherwise(F.col("content")))


def externalize(messages: DataFrame, least_bytes: int) -> tuple[DataFrame, DataFrame]:
    """messages with long tool results replaced by a pointer, and the files they went to."""
    large = (F.col("role") == "tool") & (F.octet_length("content") >= least_bytes)
    file_id = F.concat(F.lit("file_"), F.substring(F.sha2("content", 256), 1, 16))
    files = messages.filter(large).select(file_id.alias("file_id"), "conversation_id", F.octet_length("content").cast("long").alias("byte_size"), "content")
    return messages.withColumn("large_content", F.when(large, file_id)).withColumn("content", F.when(large, F.concat(F.lit("[file "), file_id, F.lit("]"))).otherwise(F.col("content"))), files


def unpaired(calls: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls without a later result, results without an earlier call) of (conversation_id, call_id, ordinal)."""
    c, r = calls.withColumnRenamed("ordinal", "c"), results.withColumnRenamed("ordinal", "r")
    pairs = c.join(r, ["conversation_id", "call_id"]).filter("r > c")
    return calls.join(pairs, ["conversation_id", "call_id"], "left_anti"), results.join(pairs, ["conversation_id", "call_id"], "left_anti")


def repair_pairs(items: DataFrame) -> DataFrame:
    """items (conversation_id, ordinal, role, call_ids, call_id, content) with each call's result right after it.

    Results move behind their calls, repeated ones go after the first, missing ones are made, and results without a call go.
    Order matters within a conversation, so this is a fold over each, and a conversation must fit in a task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ordinal")
        results: dict[str, dict] = {}
        for r in pdf[pdf["role"] == "tool"].to_dict("records"):
            results.setdefault(r["call_id"], r)
        out = []
        for r in pdf[pdf["role"] != "tool"].to_dict("records"):
            out.append(r)
            for call in r["call_ids"] if r["call_ids"] is not None else ():
                out.append(results.pop(call, None) or {**r, "role": "tool", "call_ids": None, "call_id": call, "content": "[missing tool result]"})
        table = pd.DataFrame(out, columns=list(pdf.columns))
        table["ordinal"] = range(len(table))
        return table

    return items.groupBy("conversation_id").applyInPandas(run, items.schema)


def drop_blank(rows: DataFrame) -> DataFrame:
    """rows without blank assistant messages."""
    return rows.filter((F.col("role") != "assistant") | (F.trim(F.coalesce("content", F.lit(""))) != ""))


def clamp(rows: DataFrame, budget: int) -> DataFrame:
    """The newest rows within nine tenths of the budget, without tool results at the front, and the newest user message first if it fell out."""
    t = tail.running(rows).withColumn("_fits", F.col("cum") <= int(budget * 0.9))
    w = Window.partitionBy("conversation_id")
    start = F.min(F.when(F.col("_fits") & (F.col("role") != "tool"), F.col("seq"))).over(w)
    user = F.max(F.when(F.col("role") == "user", F.col("seq"))).over(w)
    t = t.withColumn("_start", start).withColumn("_user", user)
    return t.filter((F.col("_fits") & (F.col("seq") >= F.col("_start"))) | (F.col("seq") == F.col("_user"))).drop("_fits", "_start", "_user", "rank", "cum")


def live_coverage(live: DataFrame, shown: DataFrame) -> DataFrame:
    """live inputs (conversation_id, seq, content) that the shown texts hold fewer times than they come, oldest covered first."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    need = live.withColumn("face", flat(F.col("content")))
    faces = need.select("conversation_id", "face").distinct()
    have = faces.join(shown.select("conversation_id", flat(F.col("content")).alias("text")), "conversation_id").groupBy("conversation_id", "face").agg(F.sum(occurrences(F.col("text"), F.col("face"))).alias("have"))
    w = Window.partitionBy("conversation_id", "face").orderBy("seq")
    return need.withColumn("k", F.row_number().over(w)).join(have, ["conversation_id", "face"], "left").filter(F.col("k") > F.coalesce("have", F.lit(0))).select(*live.columns)


def fair_split(buckets: DataFrame, cap: int) -> DataFrame:
    """buckets (query_id, bucket) with the share of a token cap: even, the remainder one each to the first."""
    w = Window.partitionBy("query_id")
    n, r = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy("bucket"))
    return buckets.withColumn("share", (F.floor(F.lit(cap) / n) + F.when(r <= F.lit(cap) % n, 1).otherwise(0)).cast("long"))


def distill(expanded: DataFrame, store: Store) -> DataFrame:
    """root, text: what an expansion found, a line for each item in order, with its id."""
    s = store.summaries.select(F.col("summary_id").alias("node"), F.col("content").alias("sc"))
    m = store.messages.select("message_id", F.col("content").alias("mc"), "role")
    line = F.when(F.col("message_id").isNotNull(), F.concat("role", F.lit(": "), F.substring("mc", 1, 200))).otherwise(F.concat(F.lit("["), "node", F.lit("] "), F.substring("sc", 1, 200)))
    j = expanded.join(s, "node", "left").join(m, "message_id", "left").groupBy("root").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("x"))
    return j.select("root", F.array_join(F.transform("x", lambda i: i["line"]), "\n").alias("text"))


def fallback_summary(text: Column, target_tokens: int, note: str = "[Fallback summary; truncated for context management]") -> Column:
    """The default summariser: the text's head within four characters a token, 256 at least, and a note where it was cut."""
    limit = max(256, max(1, int(target_tokens)) * 4)
    clean = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.length(clean) <= limit, clean).otherwise(F.concat(F.rtrim(F.substring(clean, 1, limit)), F.lit("\n"), F.lit(note)))


def truncate_tokens(text: Column, tokens: int) -> Column:
    """The longest head whose estimate stays within the tokens; characters that cost more are looked for only where there are any."""
    low = F.least(F.length(text), F.lit(tokens * 4))
    head = F.substring(text, 1, tokens * 4)
    plain = estimate_tokens(head) <= tokens
    fits = F.filter(F.sequence(F.lit(0), low), lambda n: estimate_tokens(text.substr(F.lit(1), n)) <= tokens)
    return F.when(plain, head).otherwise(text.substr(F.lit(1), F.array_max(fits)))


def escalate(rows: DataFrame, summarize, target: int, cap_factor: int = 3) -> DataFrame:
    """rows (summary_id, text) with content and level: a summariser's result, its aggressive one if that isn't smaller, else the fallback.

    summarize(text, aggressive) is any Python function; it runs on batches of rows. No result exceeds cap_factor times the target.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, text in zip(batch["summary_id"], batch["text"], strict=True):
                for level, aggressive in (("normal", False), ("aggressive", True)):
                    made = summarize(text, aggressive)
                    if made and made.strip() and len(made) < len(text):
                        break
                else:
                    made, level = text[: max(256, target * 4)], "fallback"
                out.append((key, made[: target * 4 * cap_factor], level))
            yield pd.DataFrame(out, columns=["summary_id", "content", "level"])

    return rows.select("summary_id", "text").mapInPandas(run, "summary_id string, content string, level string")
