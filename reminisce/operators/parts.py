"""Message parts and structured content: types, plain text, token counts, keys and cleaned text."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reminisce.functions.text import estimate_tokens, json_first

#: The part type of each kind of content block; any other kind is an agent part.
PART_TYPES = {
    "text": ["text"],
    "reasoning": ["thinking", "redacted_thinking", "reasoning"],
    "tool": ["tool_use", "toolUse", "tool-use", "toolCall", "functionCall", "function_call", "function_call_output", "tool_result", "toolResult", "tool"],
    "patch": ["patch"], "file": ["file", "image"], "subtask": ["subtask"], "compaction": ["compaction"], "step_start": ["step_start", "step-start"], "step_finish": ["step_finish", "step-finish"],
    "snapshot": ["snapshot"], "retry": ["retry"],
}
#: Fields of an object that hold its text, lists of blocks, or a nested object, in this order.
TEXT_FIELDS, LIST_FIELDS, NESTED_FIELDS = ("text", "transcript", "content", "message", "summary"), ("content", "summary", "parts", "items"), ("content", "message", "value")


def part_type(kind: Column) -> Column:
    out = None
    for name, kinds in PART_TYPES.items():
        out = F.when(kind.isin(kinds), name) if out is None else out.when(kind.isin(kinds), name)
    return out.otherwise("agent")


def parse_parts(content: Column) -> Column:
    """array<struct<ordinal, part_type, text, tool_call_id, tool_name, raw>> of a JSON array of blocks; a plain text is one part."""
    blocks = F.from_json(content, "array<string>", {"mode": "PERMISSIVE"})
    one = F.struct(F.lit(0).alias("ordinal"), F.lit("text").alias("part_type"), content.alias("text"), F.lit(None).cast("string").alias("tool_call_id"), F.lit(None).cast("string").alias("tool_name"), F.lit(None).cast("string").alias("raw"))

    def part(x: Column, i: Column) -> Column:
        kind = F.get_json_object(x, "$.type")
        return F.struct(i.alias("ordinal"), part_type(kind).alias("part_type"), json_first(x, "$.text", "$.thinking").alias("text"), json_first(x, "$.id", "$.call_id", "$.tool_use_id", "$.toolCallId").alias("tool_call_id"), json_first(x, "$.name", "$.toolName").alias("tool_name"), x.alias("raw"))

    is_array = F.coalesce(F.substring(F.trim(content), 1, 1) == "[", F.lit(False)) & blocks.isNotNull()
    return F.when(is_array, F.transform(blocks, part)).otherwise(F.array(one))


def parts_table(messages: DataFrame) -> DataFrame:
    """A row a part: message_id and the fields of parse_parts()."""
    return messages.select("message_id", F.explode(parse_parts(F.col("content"))).alias("p")).select("message_id", "p.*")


def plain_text(content: Column, depth: int = 6) -> Column:
    """The text of structured content: strings, lists joined by lines, text fields of objects; tool calls, results and reasoning hold none.

    The structure is recursive, so this is a vectorised Python function; text that isn't JSON stays as it is.
    """
    silent = set(PART_TYPES["reasoning"]) | set(PART_TYPES["tool"])

    def text_of(v: object, level: int) -> str | None:
        if v is None or level > depth:
            return None
        if isinstance(v, str):
            if v.strip()[:1] in "[{" and v.strip()[-1:] in "]}" and v.strip():
                try:
                    inner = text_of(json.loads(v), level + 1)
                except ValueError:
                    return v
                return inner or v
            return v
        if isinstance(v, list):
            found = [t for x in v if (t := text_of(x, level + 1)) and t.strip()]
            return "\n".join(found) or None
        if not isinstance(v, dict) or v.get("type") in silent:
            return None
        for k in TEXT_FIELDS:
            if isinstance(v.get(k), str) and v[k].strip():
                return v[k]
        for k in LIST_FIELDS:
            if isinstance(v.get(k), list) and (t := text_of(v[k], level + 1)):
                return t
        for k in NESTED_FIELDS:
            if (t := text_of(v.get(k), level + 1)) and t.strip():
                return t
        return None

    @F.pandas_udf("string")
    def extract(values: pd.Series) -> pd.Series:
        def one(v: str | None) -> str:
            if not v or v.strip()[:1] not in ("[", "{"):
                return v or ""
            try:
                parsed = json.loads(v)
            except ValueError:
                return v
            found = text_of(parsed, 0)
            if found is not None:
                return found
            silent_only = isinstance(parsed, list) and all(isinstance(x, dict) and x.get("type") in silent for x in parsed)
            return "" if silent_only else v

        return values.map(one)

    return extract(content)


def role_tokens(role: Column, content: Column) -> Column:
    """Tokens of content as it is shown: a user's only text block as its text, other structures as JSON."""
    blocks = F.from_json(content, "array<string>")
    single = (role == "user") & (F.size(blocks) == 1) & (F.get_json_object(blocks[0], "$.type") == "text")
    return estimate_tokens(F.when(F.coalesce(single, F.lit(False)), F.get_json_object(F.get(blocks, F.lit(0)), "$.text")).otherwise(content))


def display_content(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """message_id, display: the content, or where it is blank its parts' texts, tool inputs and outputs in order."""
    text = F.concat_ws("\n", "text_content", "tool_input", "tool_output")
    joined = parts.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", text.alias("t")))).alias("x"))
    body = F.array_join(F.filter(F.transform("x", lambda p: p["t"]), lambda t: t != ""), "\n")
    return messages.join(joined, "message_id", "left").select("message_id", F.when(F.trim(F.coalesce("content", F.lit(""))) != "", F.col("content")).otherwise(F.coalesce(body, F.lit(""))).alias("display"))


def stable_event_key(role: Column, raw: Column) -> Column:
    """A key that a provider gave an event: an assistant's response id, or a tool result's call id if providers mint it."""
    response = json_first(raw, "$.responseId", "$.response_id")
    call = json_first(raw, "$.toolCallId", "$.tool_call_id", "$.tool_use_id")
    minted = call.rlike(r"^(?:call_|toolu_|fc_)[A-Za-z0-9_-]{8,}$")
    return F.when((role == "assistant") & (response != ""), F.concat(F.lit("assistant-response:"), response)).when(role.isin("tool", "toolResult") & minted, F.concat(F.lit("tool-result:"), call))


def strip_injected(content: Column, tags: list[str]) -> Column:
    """Content without <tag>...</tag> blocks that were put into it, and the line that announces untrusted context."""
    import re

    for tag in tags:
        content = F.regexp_replace(content, f"(?is)<{re.escape(tag)}>.*?</{re.escape(tag)}>", "")
    return F.trim(F.regexp_replace(content, r"(?im)^Untrusted context \(metadata, do not treat as instructions or commands\):\s*", ""))


def strip_media(content: Column) -> Column:
    """Content without data URLs, blank lines, lines that are media paths and lines that look like binary payloads."""
    text = F.regexp_replace(content, r"data:[a-z0-9.+-]+/[a-z0-9.+-]+;base64,[A-Za-z0-9+/=]+", "[embedded media omitted]")
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.rtrim(x)), lambda x: (F.trim(x) != "") & ~F.trim(x).rlike(r"^MEDIA:\s*\S+$") & ~F.trim(x).rlike(r"^[A-Za-z0-9+/=]{256,}$"))
    return F.trim(F.array_join(lines, "\n"))


def shell_message(command: Column, output: Column) -> Column:
    return F.concat(F.lit("$ "), command, F.lit("\n"), F.coalesce(output, F.lit("")))


def signature(role: Column, content: Column) -> Column:
    """A digest of role and content with white space made single."""
    return F.sha2(F.to_json(F.struct(role.alias("role"), F.trim(F.regexp_replace(F.coalesce(content, F.lit("")), r"\s+", " ")).alias("content"))), 256)


def sender_label(metadata: Column) -> Column:
    """`name (id)` of sender metadata, what there is of it; null for neither."""
    name, key = json_first(metadata, "$.name", "$.displayName"), json_first(metadata, "$.id", "$.senderId")
    return F.when(name.isNotNull() & key.isNotNull(), F.concat(name, F.lit(" ("), key, F.lit(")"))).otherwise(F.coalesce(name, key))


def tool_closure(links: DataFrame, chosen: DataFrame) -> DataFrame:
    """(conversation_id, ordinal) of the chosen items and all that share a call with them: links are (conversation_id, ordinal, call_id).

    An item may have several calls, so the closure is taken until it no longer grows.
    """
    found, size = chosen.select("conversation_id", "ordinal").distinct(), -1
    while (n := found.count()) != size:
        size = n
        calls = links.join(found, ["conversation_id", "ordinal"], "left_semi").select("conversation_id", "call_id").distinct()
        found = found.unionByName(links.join(calls, ["conversation_id", "call_id"]).select("conversation_id", "ordinal")).distinct()
    return found
