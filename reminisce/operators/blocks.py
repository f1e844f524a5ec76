"""Stored message parts as the content blocks that a model's provider takes, and what blocks say of tool calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reminisce.functions.text import estimate_tokens, json_first

#: The kinds of blocks that call tools, those that hold results, and those whose calls name their input "arguments".
CALLS = ("function_call", "functionCall", "tool_use", "tool-use", "toolUse", "toolCall")
RESULTS = ("function_call_output", "toolResult", "tool_result")
ARGUMENTS = ("function_call", "functionCall", "toolCall")


def stored_value(text: Column) -> Column:
    """A stored text as a value: what it says in JSON, or the text itself; null for a blank one."""
    parsed = F.try_parse_json(text)
    quoted = F.to_json(F.array(text))
    return F.when(F.trim(text) != "", F.coalesce(parsed, F.try_parse_json(quoted.substr(F.lit(2), F.length(quoted) - 2))))


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


def call_block(kind: Column, part_id: Column, call_id: Column, name: Column, given: Column) -> Column:
    """JSON of a tool call. Every kind but function_call has an id, made from the part's where none is stored."""
    kind = F.when(kind.isin(*CALLS), kind).otherwise("toolCall")
    own, value, plain = kind == "function_call", stored_value(given), F.lit(None).cast("string")
    return F.to_json(F.struct(
        kind.alias("type"), F.when(own, _filled(call_id)).otherwise(plain).alias("call_id"), F.when(~own, F.coalesce(_filled(call_id), F.concat(F.lit("toolu_"), F.coalesce(part_id, F.lit("unknown"))))).alias("id"),
        _filled(name).alias("name"), F.when(kind.isin(*ARGUMENTS), value).alias("arguments"), F.when(~kind.isin(*ARGUMENTS), value).alias("input"),
    ))


def result_block(kind: Column, call_id: Column, name: Column, output: Column, text: Column, failed: Column) -> Column:
    """JSON of a tool's result: the stored output, else the text, else an empty one."""
    kind = F.when(kind.isin(*RESULTS), kind).otherwise("tool_result")
    own = kind == "function_call_output"
    return F.to_json(F.struct(
        kind.alias("type"), _filled(name).alias("name"), F.coalesce(stored_value(output), stored_value(_filled(text)), F.try_parse_json(F.lit('""'))).alias("output"), failed.alias("is_error"),
        F.when(own, _filled(call_id)).alias("call_id"), F.when(~own, _filled(call_id)).alias("tool_use_id"),
    ))


def part_block(role: Column) -> Column:
    """JSON of a row of parts (part_type, part_id, raw_type, text_content, tool_call_id, tool_name, tool_input, tool_output, is_error) of a message of a role."""
    c = F.col
    kind, result = c("raw_type"), c("raw_type").isin(*RESULTS) | (role == "tool") | (c("tool_output").isNotNull() & c("tool_input").isNull())
    tool = F.when(result, result_block(kind, c("tool_call_id"), c("tool_name"), c("tool_output"), c("text_content"), c("is_error"))).otherwise(call_block(kind, c("part_id"), c("tool_call_id"), c("tool_name"), c("tool_input")))
    text = F.coalesce(c("text_content"), F.lit(""))
    thought = F.when(kind == "thinking", F.to_json(F.struct(F.lit("thinking").alias("type"), _filled(text).alias("thinking")))).otherwise(F.to_json(F.struct(F.lit("reasoning").alias("type"), _filled(text).alias("text"))))
    return F.when(c("part_type") == "tool", tool).when(c("part_type") == "reasoning", thought).otherwise(F.to_json(F.struct(F.lit("text").alias("type"), text.alias("text"))))


def resolve(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """message_id, role, blocks (JSON of each part in order), tool_call_id, tool_name, is_error and tokens of each message.

    A message without parts has one text block of its content. A tool message without a call id can't be paired, so its
    role is assistant and its blocks are text; an assistant's that holds results alone is a tool message.
    """
    facts = ("tool_call_id", "tool_name", "is_error")
    p = parts.join(messages.select("message_id", "role"), "message_id").withColumn("block", part_block(F.col("role")))
    g = p.groupBy("message_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "block"))), lambda x: x["block"]).alias("blocks"), *(F.min_by(k, F.when(F.col(k).isNotNull(), F.col("ordinal"))).alias(k) for k in facts),
        F.bool_and(F.coalesce(F.col("raw_type").isin(*RESULTS), F.lit(False))).alias("_results"))
    j = messages.select("message_id", "role", "content").join(g, "message_id", "left")
    own = F.array(F.to_json(F.struct(F.lit("text").alias("type"), F.coalesce("content", F.lit("")).alias("text"))))
    lost = (F.col("role") == "tool") & F.col("tool_call_id").isNull()
    role = F.when(lost, "assistant").when((F.col("role") == "assistant") & F.coalesce("_results", F.lit(False)), "tool").otherwise(F.col("role"))
    out = j.select("message_id", role.alias("role"), F.when(F.col("blocks").isNull() | lost, own).otherwise(F.col("blocks")).alias("blocks"), *facts)
    return out.withColumn("tokens", estimate_tokens(F.array_join("blocks", ",")))


def tool_calls(messages: DataFrame) -> DataFrame:
    """message_id, call_id, name, given: the tool calls in messages whose content is a JSON array of blocks."""
    block = F.explode(F.from_json("content", "array<string>")).alias("b")
    return messages.filter(F.ltrim("content").startswith("[")).select("message_id", block).filter(F.get_json_object("b", "$.type").isin(*CALLS)).select(
        "message_id", json_first(F.col("b"), "$.id", "$.call_id", "$.toolCallId", "$.tool_use_id").alias("call_id"), json_first(F.col("b"), "$.name", "$.toolName").alias("name"), json_first(F.col("b"), "$.input", "$.arguments").alias("given"))


def annotate_media(content: Column, part_types: Column) -> Column:
    """A message's text with a mark for what can't be read in a summary; the mark alone where there is no text."""
    media = F.exists(part_types, lambda x: x.isin("file", "image"))
    return F.when(media & (F.trim(F.coalesce(content, F.lit(""))) == ""), "[media attachment]").when(media, F.concat(content, F.lit(" [with media attachment]"))).otherwise(content)


def prompt_tokens(usage: Column) -> Column:
    """Prompt tokens of a JSON record of a model's usage: a current count, else fresh, read and written ones, else the provider's; null without any."""
    count = lambda *paths: F.coalesce(*(F.when((n := F.get_json_object(usage, p).cast("double")) >= 0, F.floor(n).cast("long")) for p in paths))

    def summed(at: str) -> Column:
        own = [count(f"{at}.{k}") for k in ("input", "cacheRead", "cacheWrite")]
        zero = F.lit(0).cast("long")
        total = F.when(F.coalesce(*own).isNotNull(), sum((F.coalesce(x, zero) for x in own), zero))
        found = F.coalesce(total, count(*(f"{at}.{k}" for k in ("prompt_tokens", "promptTokens", "input_tokens", "inputTokens"))))
        return F.when(found > 0, found)

    return F.coalesce(count("$.currentTokenCount"), summed("$.usage"), summed("$.lastCallUsage"), summed("$.promptCache.lastCallUsage"))


def file_ids(text: Column) -> Column:
    """The ids in a stored JSON array; none for a malformed text."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
